"""Golden values of the numeric kernels, and properties of them."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from causalloom.functions import kernels as K

finite = st.lists(st.floats(-100, 100).map(lambda x: round(x, 3)), min_size=3, max_size=20)


@pytest.mark.parametrize(("x", "y", "want"), [
    ([1, 2, 3, 4], [1, 2, 3, 4], [.13333333, .36666667, .66666667, 1, .66666667, .36666667, .13333333]),
    ([1, 1, 1], [1, 1, 1], [.33333333, .66666667, 1, .66666667, .33333333]),
    ([1, 2, 3], [-1, -1, -1], [-.15430335, -.46291005, -.9258201, -.77151675, -.46291005]),
])
def test_ncc(x, y, want):
    assert np.allclose(K.ncc(np.array(x, float), np.array(y, float)), want)


def test_sbd():
    assert abs(K.sbd([0, 1, 2], [1, 2, 3])[0] - 0.043817112532485103) < 1e-12
    assert abs(K.sbd([1, 2, 3], [0, 1, 2])[0] - 0.043817112532485103) < 1e-12
    assert abs(K.sbd([1, 1, 1], [1, 1, 1])[0]) < 1e-12
    assert K.sbd([0, 0, 0], [0, 0, 0])[0] == 1


def test_shape_extraction():
    rows = np.array([[1, 2, 3], [4, 5, 6]], float)
    centre = np.array([0, 3, 4], float)
    assert np.allclose(K.extract_shape(rows[1:], centre), [-1, 0, 1])
    assert np.allclose(K.extract_shape(np.array([[4, -5, 6.0]]), centre), [-.96836405, 1.02888681, -.06052275])
    two = np.array([[0, 1, 2, 3], [1, 2, 2, 3]], float)
    assert np.allclose(K.extract_shape(two, np.zeros(4)), [-1.2089303, -.19618238, .19618238, 1.2089303])
    three = np.array([[1, 2, 3, 4], [0, 1, 2, 3], [1, 2, 2, 3]], float)
    assert np.allclose(K.extract_shape(three, np.array([-1.2089303, -.19618238, .19618238, 1.2089303]), unset=True), [-1.19623139, -.26273649, .26273649, 1.19623139])
    assert not K.extract_shape(np.empty((0, 4)), np.zeros(4)).any()


def test_kshape_golden():
    x = K.zscore(np.array([[1, 2, 3, 4], [0, 1, 2, 3], [-1, 1, -1, 1], [1, 2, 2, 3]], float), 1)
    labels, centres = K.kshape(x, 2, np.array([0, 1, 1, 0]))
    assert labels.tolist() == [0, 0, 1, 0]
    assert np.allclose(centres[1], [-.8660254, .8660254, -.8660254, .8660254])


def test_eigen_sides_agree():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((12, 10))
    wide = K.extract_shape(x[:6], np.zeros(10))
    b = K.zscore(x[:6], 1)
    v = np.linalg.eigh((b - b.mean(1, keepdims=True)).T @ (b - b.mean(1, keepdims=True)))[1][:, -1]
    assert min(np.abs(wide - K.zscore(v, 1)).max(), np.abs(wide + K.zscore(v, 1)).max()) < 1e-8


@settings(max_examples=60, deadline=None)
@given(finite, finite)
def test_sbd_range_and_symmetry(x, y):
    n = min(len(x), len(y))
    a, b = np.array(x[:n]), np.array(y[:n])
    d = K.sbd(a, b)[0]
    assert -1e-9 <= d <= 2 + 1e-9
    assert abs(d - K.sbd(b, a)[0]) < 1e-9
    assert abs(d - K.sbd_to(b[None], a)[0]) < 1e-9


def test_lag_recovers_shift():
    x = np.sin(np.arange(64) / 5) * np.exp(-((np.arange(64) - 30) / 8.0) ** 2)
    assert K.lag(x, K.shifted(x, 5)) == 5
    assert K.lag(x, K.shifted(x, -7)) == -7


def test_tails():
    assert abs(K.f_tail(3, 2, 10) - 0.0953674316) < 1e-9
    for f, d2 in ((0.5, 7), (2.2, 33), (9.0, 4)):
        assert abs(K.f_tail(f, 2, d2) - (1 + 2 * f / d2) ** (-d2 / 2)) < 1e-9
    assert abs(K.incomplete_beta(2, 3, 0.4) - 0.5248) < 1e-9
    assert abs(K.incomplete_beta(0.5, 0.5, 0.3) - 2 / math.pi * math.asin(math.sqrt(0.3))) < 1e-9


def test_granger_fires_one_way():
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal(500), np.zeros(500)
    for t in range(1, 500):
        y[t] = 0.4 * y[t - 1] + 0.3 * x[t - 1] + 0.5 * rng.standard_normal()
    assert K.granger(y, x, 1)[1] < 1e-6 < 0.01 < K.granger(x, y, 1)[1]


def test_adf_and_shapiro():
    rng = np.random.default_rng(5)
    noise = rng.standard_normal(300)
    assert K.adf(noise)[1] < 0.01 and K.adf(np.cumsum(noise))[1] > 0.05
    assert K.shapiro(noise)[1] > 0.01 and K.shapiro(np.exp(noise))[1] < 1e-6
    with pytest.raises(ValueError):
        K.shapiro(np.ones(20))


def test_silhouette():
    d = np.array([[0, 1, 8, 9], [1, 0, 7, 8], [8, 7, 0, 1], [9, 8, 1, 0]], float)
    assert K.silhouette(d, np.array([0, 0, 0, 0])) == -1 == K.silhouette(d, np.array([0, 1, 2, 3]))
    assert K.silhouette(d, np.array([0, 0, 1, 1])) > 0.8
    assert abs(K.silhouette(d, np.array([0, 0, 0, 1]))) <= 1


# Published examples (the 11 weights of Shapiro and Wilk 1965; tables of F).
def test_shapiro_of_few_values():
    w, p = K.shapiro([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert abs(w - 0.79) < 0.005 and 0.005 < p < 0.008
    w, p = K.shapiro([1, 2, 3])
    assert abs(w - 1) < 1e-12 and abs(p - 1) < 1e-6
    w, p = K.shapiro([0, 0, 1])
    assert abs(w - 0.75) < 1e-12 and abs(p) < 1e-9
    rng = np.random.default_rng(2)
    for n in (4, 5, 7, 11, 12, 40):  # under the null, p is near uniform
        ps = np.array([K.shapiro(rng.standard_normal(n))[1] for _ in range(400)])
        assert abs((ps < 0.1).mean() - 0.1) < 0.05 and abs(np.median(ps) - 0.5) < 0.1


def test_f_tail_of_tables():
    for f, d1, d2, p in ((4.9646, 1, 10, 0.05), (3.4928, 2, 20, 0.05), (4.1708, 1, 30, 0.05), (5.6363, 5, 10, 0.01), (3.8183, 4, 21, 0.0176)):
        assert abs(K.f_tail(f, d1, d2) - p) < 3e-4


def test_granger_by_partial_regression():
    """F from the residuals of effect and lagged causes on the effect's own past, by normal equations; p by integrating the density."""
    from math import lgamma

    rng = np.random.default_rng(3)
    cause = rng.standard_normal(160)
    effect = np.convolve(cause, [0, 0.3, 0.2], "full")[:160] + rng.standard_normal(160)
    for lags in range(1, 6):
        n = 160 - lags
        y = effect[lags:]
        own = np.column_stack([np.ones(n)] + [effect[lags - i : 160 - i] for i in range(1, lags + 1)])
        other = np.column_stack([cause[lags - i : 160 - i] for i in range(1, lags + 1)])
        keep = np.eye(n) - own @ np.linalg.solve(own.T @ own, own.T)
        ry, rx = keep @ y, keep @ other
        gain = ry @ rx @ np.linalg.solve(rx.T @ rx, rx.T @ ry)
        dof = n - 2 * lags - 1
        want = gain / lags / ((ry @ ry - gain) / dof)
        x = np.linspace(0, want, 200_001)[1:] - want / 400_000
        log = lgamma((lags + dof) / 2) - lgamma(lags / 2) - lgamma(dof / 2) + lags / 2 * np.log(lags / dof) + (lags / 2 - 1) * np.log(x) - (lags + dof) / 2 * np.log1p(lags * x / dof)
        f, p = K.granger(effect, cause, lags)
        assert abs(f - want) < 1e-8 * want and abs(p - (1 - np.exp(log).sum() * want / 200_000)) < 2e-3

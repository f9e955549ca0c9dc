"""Numeric kernels without an SQL form: shape distance, shape extraction, k-Shape, tail probabilities."""

from __future__ import annotations

import math

import numpy as np


def zscore(x: np.ndarray, ddof: int = 0) -> np.ndarray:
    """Rows to mean 0 and deviation 1; constant rows become zeros."""
    x = np.asarray(x, float)
    s = x.std(-1, ddof=ddof, keepdims=True)
    return np.divide(x - x.mean(-1, keepdims=True), s, out=np.zeros_like(x), where=s > 0)


def shifted(x: np.ndarray, by: int) -> np.ndarray:
    """x moved right by `by` places (left if negative), zeros in the gap."""
    out, n = np.zeros_like(x), len(x)
    if by >= 0:
        out[min(by, n) :] = x[: max(n - by, 0)]
    else:
        out[: max(n + by, 0)] = x[min(-by, n) :]
    return out


def ncc(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cross-correlation at shifts 1-n..n-1 over the product of norms; zeros if a norm is 0."""
    n = len(x)
    size = 1 << (2 * n - 1).bit_length()
    cc = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size)), size)
    cc = np.concatenate([cc[size - n + 1 :], cc[:n]]) if n > 1 else cc[:1]
    norm = float(np.linalg.norm(x) * np.linalg.norm(y))
    return cc / norm if norm else np.zeros(2 * n - 1)


def ncc_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """ncc() of each row of x with the same row of y, by transforms of whole matrices."""
    m, n = x.shape
    size = 1 << (2 * n - 1).bit_length()
    cc = np.fft.irfft(np.fft.rfft(x, size, axis=1) * np.conj(np.fft.rfft(y, size, axis=1)), size, axis=1)
    cc = np.concatenate([cc[:, size - n + 1 :], cc[:, :n]], 1) if n > 1 else cc[:, :1]
    norm = (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))[:, None]
    return np.divide(cc, norm, out=np.zeros((m, 2 * n - 1)), where=norm > 0)


def sbd(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Shape-based distance 1 - max NCC, and y moved to where it fits x best."""
    c = ncc(np.asarray(x, float), np.asarray(y, float))
    at = int(np.argmax(c))
    return 1 - float(c[at]), shifted(np.asarray(y, float), at - (len(x) - 1))


def lag(x: np.ndarray, y: np.ndarray) -> int:
    """Steps by which y trails x."""
    return len(x) - 1 - int(np.argmax(ncc(np.asarray(x, float), np.asarray(y, float))))


def sbd_to(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Distances of all rows to one centre, in one batch of transforms."""
    m, n = rows.shape
    size = 1 << (2 * n - 1).bit_length()
    cc = np.fft.irfft(np.fft.rfft(rows, size, axis=1) * np.conj(np.fft.rfft(centre, size)), size, axis=1)
    top = np.maximum(cc[:, :n].max(1), cc[:, size - n + 1 :].max(1) if n > 1 else cc[:, :n].max(1))
    norm = np.linalg.norm(rows, axis=1) * np.linalg.norm(centre)
    return 1 - np.divide(top, norm, out=np.zeros(m), where=norm > 0)


#: Longest series whose shifts are compared by matrix products; longer ones go through Fourier transforms.
SHORT = 128

#: Rows and columns of one block of distances, and numbers of one stack of correlations: such as stay in the cache.
TILE, STACK = (128, 256), 1 << 17


def moved(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """shifted() of each row by its own number of places, less than its length."""
    m, n = x.shape
    wide = np.zeros((m, 3 * n))
    wide[:, n : 2 * n] = x
    return np.lib.stride_tricks.sliding_window_view(wide, n, axis=1)[np.arange(m), n - by]


def correlations(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Cross-correlation of each centre with each row at shifts 1-n..n-1, not normalised: [centre, shift, row]."""
    (m, n), k = rows.shape, len(centres)
    if n <= SHORT:
        wide = np.zeros((k, 3 * n - 2))
        wide[:, n - 1 : 2 * n - 1] = centres
        stack = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wide, n, axis=1)).reshape(-1, n)
        return (stack @ rows.T).reshape(k, 2 * n - 1, m)
    size = 1 << (2 * n - 1).bit_length()
    cc = np.fft.irfft(np.fft.rfft(centres, size, axis=1)[:, None] * np.conj(np.fft.rfft(rows, size, axis=1)), size, axis=2)
    return np.concatenate([cc[:, :, size - n + 1 :], cc[:, :, :n]], 2).transpose(0, 2, 1)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: the nearest centre (least index on ties), the shift at which the row fits it, and the distance."""
    (m, n), k = x.shape, len(centres)
    label, by, distance = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m)
    norms, step = np.linalg.norm(centres, axis=1)[:, None], max(1, STACK // (k * 2 * n))
    for lo in range(0, m, step):
        rows = x[lo : lo + step]
        cc = correlations(rows, centres)
        norm = norms * np.linalg.norm(rows, axis=1)
        d = 1 - np.divide(cc.max(1), norm, out=np.zeros(norm.shape), where=norm > 0)
        at = np.arange(len(rows))
        best = d.argmin(0)
        label[lo : lo + step], distance[lo : lo + step] = best, d[best, at]
        by[lo : lo + step] = cc[best, :, at].argmax(1) - (n - 1)
    return label, by, distance


def tiles(x: np.ndarray, y: np.ndarray, lags: bool = False, upper: bool = False):
    """(first row of x, first row of y, ncc, lag) block by block: the largest NCC of each row of x with each of y, and on demand the lag.

    Of equal NCCs the first shift counts, as in ncc(). A norm of 0 gives 0. Series have one
    length. upper: only blocks with a pair whose row of y has the larger index.
    """
    n = x.shape[1]
    x, y = np.asarray(x, float), np.asarray(y, float)
    norm_x, norm_y = np.linalg.norm(x, axis=1)[:, None], np.linalg.norm(y, axis=1)
    if n > SHORT:
        size = 1 << (2 * n - 1).bit_length()
        fx = np.fft.rfft(x, size, axis=1)
        height, width = 1, max(1, STACK // size)
    else:
        xt, yt = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
        height, width = TILE
    for j in range(0, len(y), width):
        fy = np.conj(np.fft.rfft(y[j : j + width], size, axis=1)) if n > SHORT else None
        for i in range(0, min(len(x), j + width - 1) if upper else len(x), height):
            shape = len(x[i : i + height]), len(y[j : j + width])
            top, at = np.full(shape, -np.inf if n else 0.0), np.full(shape, 1 - n if n else 0, np.int32)
            if n > SHORT:
                cc = np.fft.irfft(fx[i] * fy, size, axis=1)
                cc = np.concatenate([cc[:, size - n + 1 :], cc[:, :n]], 1)
                top[0], at[0] = cc.max(1), cc.argmax(1) - (n - 1)
            else:
                d, more = np.empty(shape), np.empty(shape, bool)
                for s in range(1 - n, n):
                    np.matmul(xt[max(s, 0) : n + min(s, 0), i : i + height].T, yt[max(-s, 0) : n - max(s, 0), j : j + width], out=d)
                    if lags:
                        np.copyto(at, s, where=np.greater(d, top, out=more))
                    np.maximum(top, d, out=top)
                at[~np.isfinite(top)] = 1 - n
            norm = norm_x[i : i + height] * norm_y[j : j + width]
            yield i, j, np.divide(top, norm, out=np.zeros(shape), where=norm > 0), -at if lags else None


def _shape(aligned: np.ndarray) -> np.ndarray:
    y = zscore(aligned, 1)
    b = y - y.mean(1, keepdims=True)
    if len(b) <= b.shape[1]:
        v = b.T @ np.linalg.eigh(b @ b.T)[1][:, -1]
        v = v / np.linalg.norm(v) if np.linalg.norm(v) > 0 else v
    else:
        v = np.linalg.eigh(b.T @ b)[1][:, -1]
    if np.linalg.norm(aligned[0] - v) > np.linalg.norm(aligned[0] + v):
        v = -v
    return zscore(v, 1)


def extract_shape(members: np.ndarray, centre: np.ndarray, unset: bool | None = None) -> np.ndarray:
    """Centroid of the members: top eigenvector of their centred scatter after alignment to the centre.

    With m members of length n, the n x n problem has the same top vector as the m x m one
    of the centred rows, mapped back; m is the cheaper side for short lists of long series.
    """
    members = np.asarray(members, float)
    if not len(members):
        return np.zeros_like(centre, dtype=float)
    unset = not np.any(centre) if unset is None else unset
    return _shape(members if unset else moved(members, nearest(members, np.asarray(centre, float)[None])[1]))


def kshape(x: np.ndarray, k: int, start: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centroids: refine all centroids, assign each row to its nearest (least index on ties), until stable."""
    return kshape_fit(x, k, start, rounds)[:2]


def kshape_fit(x: np.ndarray, k: int, start: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """kshape(), and each row's distance to its centroid.

    A round's assignment also tells at which shift a row fits its centre, and so how the next
    round aligns it.
    """
    x, labels = np.asarray(x, float), np.asarray(start).copy()
    centres, by, distance = np.zeros((k, x.shape[1])), np.zeros(len(x), np.int64), np.zeros(len(x))
    for _ in range(rounds):
        before, unset = labels, ~centres.any(1)
        aligned = moved(x, np.where(unset[labels], 0, by))
        centres = np.array([_shape(aligned[labels == j]) if (labels == j).any() else np.zeros(x.shape[1]) for j in range(k)])
        labels, by, distance = nearest(x, centres)
        if np.array_equal(before, labels):
            break
    return labels, centres, distance


def silhouette(distance: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette over a distance matrix; -1 for one cluster or as many as rows; singletons give 0."""
    names = np.unique(labels)
    n = len(labels)
    if len(names) < 2 or len(names) >= n:
        return -1.0
    sums = np.array([distance[:, labels == c].sum(1) for c in names]).T
    size = np.array([(labels == c).sum() for c in names])
    own = np.searchsorted(names, labels)
    rows = np.arange(n)
    a = sums[rows, own] / np.maximum(size[own] - 1, 1)
    means = sums / size
    means[rows, own] = np.inf
    b = means.min(1)
    s = np.divide(b - a, np.maximum(a, b), out=np.zeros(n), where=np.maximum(a, b) > 0)
    return float(np.where(size[own] > 1, s, 0.0).mean())


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + term * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + term / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f) for an F distribution with d1 and d2 degrees of freedom."""
    if not math.isfinite(f):
        return 0.0 if f > 0 else float("nan")
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def residual_square(x: np.ndarray, y: np.ndarray) -> float:
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    r = y - x @ beta
    return float(r @ r)


def granger(effect: np.ndarray, cause: np.ndarray, lags: int) -> tuple[float, float]:
    """F statistic and p value that `lags` past values of cause improve the regression of effect on its own past."""
    n = len(effect) - lags
    dof = n - 2 * lags - 1
    if dof <= 0:
        raise ValueError("too few points")
    if np.ptp(effect) == 0 or np.ptp(cause) == 0:
        raise ValueError("constant series")
    y = effect[lags:]
    own = [effect[lags - i : len(effect) - i] for i in range(1, lags + 1)]
    other = [cause[lags - i : len(cause) - i] for i in range(1, lags + 1)]
    small = residual_square(np.column_stack([np.ones(n), *own]), y)
    full = residual_square(np.column_stack([np.ones(n), *own, *other]), y)
    if full <= 1e-12 * max(small, 1e-300) or small == 0:
        raise ValueError("perfect fit")
    f = (small - full) / lags / (full / dof)
    return f, f_tail(max(f, 0.0), lags, dof)


# Coefficients of the published MacKinnon (1994) response surface for one
# series, by regression: upper bound, least, split statistic; then the polynomials.
MACKINNON = {
    "c": (2.74, -18.83, -1.61, [2.1659, 1.4412, 0.038269], [1.7339, 0.93202, -0.12745, -0.010368]),
    "ct": (0.70, -16.18, -2.89, [3.2512, 1.6047, 0.049588], [2.5261, 0.61654, -0.37956, -0.060285]),
    "ctt": (0.63, -17.17, -3.21, [4.0003, 1.658, 0.048288], [3.0778, 0.49529, -0.41477, -0.059359]),
}


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def adf(x: np.ndarray, regression: str = "c") -> tuple[float, float]:
    """Augmented Dickey-Fuller statistic and p value; the lag order minimises AIC up to 12 (n / 100)^(1/4)."""
    x = np.asarray(x, float)
    order = {"c": 0, "ct": 1, "ctt": 2}[regression]
    most = min(int(math.ceil(12 * (len(x) / 100) ** 0.25)), len(x) // 2 - order - 2)
    if most < 0 or np.ptp(x) == 0:
        raise ValueError("too short or constant")
    d = np.diff(x)

    def design(p: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(d) - first
        past = [d[first - i : len(d) - i] for i in range(1, p + 1)]
        trend = [np.arange(1, n + 1, dtype=float) ** j for j in range(order + 1)]
        return np.column_stack([x[first:-1], *past, *trend]), d[first:]

    def aic(p: int) -> float:
        a, y = design(p, most)
        n = len(y)
        return n * (math.log(2 * math.pi) + math.log(max(residual_square(a, y), 1e-300) / n) + 1) + 2 * a.shape[1]

    best = min(range(most + 1), key=lambda p: (aic(p), p))
    a, y = design(best, best)
    s2 = residual_square(a, y) / (len(y) - a.shape[1])
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    stat = float(beta[0] / math.sqrt(s2 * np.linalg.pinv(a.T @ a)[0, 0]))
    high, low, split, small, large = MACKINNON[regression]
    if stat > high:
        return stat, 1.0
    if stat < low:
        return stat, 0.0
    return stat, normal_cdf(sum(c * stat**i for i, c in enumerate(small if stat <= split else large)))


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse of the normal distribution, by bisection to double precision."""
    lo, hi = np.full_like(p, -40.0), np.full_like(p, 40.0)
    cdf = np.vectorize(normal_cdf)
    for _ in range(80):
        mid = (lo + hi) / 2
        up = cdf(mid) < p
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


# Polynomials of Royston's (1992, 1995) approximation to the Shapiro-Wilk test.
ROYSTON_LAST = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
ROYSTON_NEXT = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
ROYSTON_FEW = ([0.5440, -0.39978, 0.025054, -0.0006714], [1.3822, -0.77857, 0.062767, -0.0020322], (-2.273, 0.459))
ROYSTON_MANY = ([-1.5861, -0.31082, -0.083751, 0.0038915], [-0.4803, -0.082676, 0.0030302])


def _poly(c: list[float], x: float) -> float:
    return sum(k * x**i for i, k in enumerate(c))


def _shapiro_weights(n: int) -> np.ndarray:
    if n == 3:
        return np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    m = normal_quantile((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    mm, u = float(m @ m), 1 / math.sqrt(n)
    last = m[-1] / math.sqrt(mm) + _poly(ROYSTON_LAST, u)
    if n <= 5:
        a = m * math.sqrt((1 - 2 * last**2) / (mm - 2 * m[-1] ** 2))
    else:
        prev = m[-2] / math.sqrt(mm) + _poly(ROYSTON_NEXT, u)
        a = m * math.sqrt((1 - 2 * last**2 - 2 * prev**2) / (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2))
        a[-2], a[1] = prev, -prev
    a[-1], a[0] = last, -last
    return a


def shapiro(x: np.ndarray) -> tuple[float, float]:
    """Shapiro-Wilk W and p value for 3 values or more: exact for 3, by one normalising transform up to 11, by another beyond."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        raise ValueError("too few or constant values")
    a = _shapiro_weights(n)
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) @ (x - x.mean()))))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        mean, dev, (g0, g1) = ROYSTON_FEW
        gap = g0 + g1 * n - y
        if gap <= 0:
            return w, 1e-19
        return w, 1 - normal_cdf((-math.log(gap) - _poly(mean, n)) / math.exp(_poly(dev, n)))
    z = math.log(n)
    mean, dev = ROYSTON_MANY
    return w, 1 - normal_cdf((y - _poly(mean, z)) / math.exp(_poly(dev, z)))

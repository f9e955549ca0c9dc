"""Distances and clusters of large groups: block by block, against plain loops."""

import numpy as np
import pytest

from causalloom.functions import kernels as K
from causalloom.operators import clustering, distance
from causalloom.plans import catalog

rng = np.random.default_rng(11)


def rows_of(count, n, service="s"):
    x = rng.integers(-2, 3, (count, n)).astype(float)  # small integers: many equal correlations
    x[1], x[count // 2] = 0, x[2]
    return [(service, f"m{(i * 37) % 101:03d}", x[i].tolist()) for i in range(count)]


@pytest.fixture(scope="module")
def series(spark):
    data = rows_of(40, 6) + rows_of(9, 5, "t") + [("u", "alone", [1.0, 2.0, 3.0])]
    return data, spark.createDataFrame(data, "service string, metric string, v array<double>")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tiles_take_the_first_of_equal_shifts():
    x, y = rng.integers(-2, 3, (140, 7)).astype(float), rng.integers(-2, 3, (300, 7)).astype(float)
    x[0], x[1, 2] = 0, np.nan
    seen = 0
    for i, j, top, lag in K.tiles(x, y, True):
        seen += top.size
        for p in range(0, len(top), 11):
            for q in range(0, top.shape[1], 7):
                c = np.correlate(x[i + p], y[j + q], "full")
                norm = np.linalg.norm(x[i + p]) * np.linalg.norm(y[j + q])
                want, at = (c.max() / norm, c.argmax()) if norm > 0 else (0, 0)
                assert abs(top[p, q] - want) < 1e-12 and lag[p, q] == 6 - at
    assert seen == 140 * 300


def test_tiles_of_long_series():
    x = rng.standard_normal((5, K.SHORT + 30))
    got = {(i + p, j + q): (top[p, q], lag[p, q]) for i, j, top, lag in K.tiles(x, x, True) for p in range(len(top)) for q in range(top.shape[1])}
    assert len(got) == 25
    assert all(abs(d - K.ncc(x[p], x[q]).max()) < 1e-9 and at == K.lag(x[p], x[q]) for (p, q), (d, at) in got.items())


@pytest.mark.parametrize("n", [24, K.SHORT + 12])
def test_kshape_makes_no_call_for_each_row(monkeypatch, n):
    x = K.zscore(rng.standard_normal((90, n)).cumsum(1))
    start = np.arange(90) % 4
    labels, centres = start, np.zeros((4, n))
    for _ in range(100):  # the plain form: each member moved on its own
        old, members = labels, [[K.sbd(c, r)[1] if c.any() else r for r in x[labels == j]] for j, c in enumerate(centres)]
        centres = np.array([K.extract_shape(np.array(m), np.zeros(n)) if m else np.zeros(n) for m in members])
        labels = np.array([K.sbd_to(x, c) for c in centres]).argmin(0)
        if (old == labels).all():
            break

    def never(*_):
        raise AssertionError("one call for each row")

    monkeypatch.setattr(K, "sbd", never)
    monkeypatch.setattr(K, "ncc", never)
    got, shapes, apart = K.kshape_fit(x, 4, start)
    assert (got == labels).all() and np.allclose(shapes, centres)
    assert np.allclose(apart, [K.sbd_to(x[i : i + 1], shapes[j])[0] for i, j in enumerate(got)])


@pytest.mark.parametrize("block", [7, 1024])
def test_pair_distances_are_those_of_pairs(series, monkeypatch, block):
    monkeypatch.setattr(distance, "BLOCK", block)
    data, df = series
    got = {(r.service, r.a, r.b): r for r in distance.pair_distances(df, ["service"]).collect()}
    want = {(r.service, r.a, r.b): r for r in distance.with_sbd(distance.pairs_within(df, ["service"])).collect()}
    assert got.keys() == want.keys() and len(got) == 40 * 39 // 2 + 9 * 8 // 2
    value = {(s, m): np.array(v) for s, m, v in data}
    for key, r in got.items():
        x, y = value[key[0], key[1]], value[key[0], key[2]]
        assert abs(r.ncc - want[key].ncc) < 1e-12 and abs(r.sbd - want[key].sbd) < 1e-12
        assert r.lag == len(x) - 1 - (np.correlate(x, y, "full").argmax() if x.any() and y.any() else 0)


def test_pair_distances_need_one_length(spark):
    df = spark.createDataFrame([("s", "a", [1.0, 2.0]), ("s", "b", [1.0])], "service string, metric string, v array<double>")
    with pytest.raises(Exception, match="one length"):
        distance.pair_distances(df, ["service"]).collect()


@pytest.mark.parametrize("name", ["ncc_max", "sbd_pairs", "sbd_lag"])
def test_no_pair_carries_its_series(spark, sf_dir, name):
    text = plan(catalog.QUERIES[name](spark, sf_dir))
    assert "Join" not in text and "FlatMapGroupsInArrow" in text


def test_silhouette_joins_no_pairs(spark, sf_dir):
    assert "MapInArrow" not in plan(catalog.QUERIES["silhouette"](spark, sf_dir)).replace("FlatMapGroupsInArrow", "")


@pytest.mark.parametrize("block", [7, 1024])
def test_series_silhouette_is_that_of_the_pairs(spark, series, monkeypatch, block):
    monkeypatch.setattr(distance, "BLOCK", block)
    data, df = series
    marks = [(s, k, m, None if m == "m037" and k == 3 else int(m[1:]) % k if m != "alone" else 0) for s, m, _ in data for k in (1, 2, 3, 60)]
    labels = spark.createDataFrame(marks, "service string, set int, key string, cluster int")
    got = {(r.service, r.set): r for r in distance.series_silhouette(df, labels, ["service"], ("set",)).collect()}
    pairs = distance.pair_distances(df, ["service"])
    for k in (1, 2, 3, 60):
        for r in distance.silhouette(pairs, labels.where(f"set = {k}"), ["service"]).collect():
            g = got.pop((r.service, k))
            assert (g.n, g.k) == (r.n, r.k) and abs(g.silhouette - r.silhouette) < 1e-9
    assert not got


@pytest.mark.parametrize("block", [7, 1024])
def test_kshape_silhouette_of_padded_series(spark, monkeypatch, block):
    monkeypatch.setattr(distance, "BLOCK", block)
    data = [("s", f"m{i:02d}", rng.standard_normal(12 - i % 2).tolist()) for i in range(30)]
    df = spark.createDataFrame(data, "service string, metric string, v array<double>")
    x = K.zscore(np.array([np.pad(v, (0, 12 - len(v))) for _, _, v in data]))
    apart = np.array([K.sbd_to(x, r) for r in x])
    np.fill_diagonal(apart, 0)
    got = clustering.kshape(clustering.start_labels(df, [2, 3])).toPandas()
    for _, part in got.groupby("k"):
        part = part.sort_values("metric")
        assert len(part) == 30 and part["silhouette"].nunique() == 1
        assert abs(part["silhouette"].iloc[0] - K.silhouette(apart, part["cluster"].to_numpy())) < 1e-9


def test_gap_statistic_draws_one_sequence_in_separate_tasks(spark):
    data = [("s", f"m{i:02d}", rng.standard_normal(10).tolist()) for i in range(12)] + [("t", f"m{i}", rng.standard_normal(10).tolist()) for i in range(3)]
    df = spark.createDataFrame(data, "service string, metric string, v array<double>")
    out = clustering.gap_statistic(df, [5, 2, 3], references=4)
    assert "MapInPandas" in plan(out).replace("FlatMapGroupsInPandas", "")
    got = {(r.service, r.k): r.gap for r in out.collect()}
    want = {}
    for s in ("s", "t"):
        x, random = K.zscore(np.array([v for t, _, v in data if t == s])), np.random.default_rng(7)

        def spread(rows, k):
            labels, centres = K.kshape(rows, k, np.arange(len(rows)) % k, 20)
            return sum(K.sbd_to(rows[labels == j], centres[j]).sum() for j in range(k) if (labels == j).any())

        for k in (5, 2, 3):
            if len(x) > k:
                refs = [spread(K.zscore(random.uniform(x.min(0), x.max(0), x.shape)), k) for _ in range(4)]
                want[s, k] = np.log(np.mean(refs)) - np.log(max(spread(x, k), 1e-12))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)

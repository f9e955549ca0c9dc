"""Operators on small fixtures: classes of series, edges, graphs, versions, formats, streams."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from causalloom.functions import names
from causalloom.operators import causality, clustering, diagnostics, distance, graphs, monitoring, series, versions
from causalloom.sources import readers, writers


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def lines(spark, text):
    return spark.createDataFrame([(x,) for x in text.strip("\n").split("\n")], "value string")


T0 = dt.datetime(2024, 1, 1)


def samples(spark, data):
    return spark.createDataFrame([("s", m, T0 + dt.timedelta(seconds=i), float(v)) for m, vs in data.items() for i, v in enumerate(vs) if v is not None], "service string, metric string, ts timestamp_ntz, value double")


def test_series_classes(spark):
    data = {"flat": [2.0] * 6, "up": [1.0, 2, 2, 3, 4, 9], "down": [6.0, 5, 4, 3, 2, 1], "noise": [1.0, None, 3, 2, None, 5]}
    grid = series.on_grid(series.resample_mean(samples(spark, data), "1 second"), "1 second")
    empty = grid.where("metric = 'flat'").select("service", F.lit("empty").alias("metric"), "bin", F.lit(None).cast("double").alias("value"))
    full = series.interpolate(grid.unionByName(empty))
    assert {(r.metric, r.klass) for r in series.classify(full).collect()} == {("flat", "constant"), ("up", "monotonic"), ("down", "other"), ("noise", "other"), ("empty", "empty")}
    kept = series.prepared(full)
    assert {r.metric for r in kept.select("metric").distinct().collect()} == {"up-diff", "down", "noise"}
    assert [r.value for r in kept.where("metric = 'up-diff'").orderBy("bin").collect()] == [1, 0, 1, 1, 5]
    assert [r.value for r in full.where("metric = 'noise'").orderBy("bin").collect()] == [1, 2, 3, 2, 3.5, 5]


def test_edges_clamp_and_fill(spark):
    data = {"a": [1.0] * 5, "b": [None, 2.0, None, 4.0, None]}
    grid = series.on_grid(series.resample_mean(samples(spark, data), "1 second"), "1 second")
    assert [r.value for r in series.interpolate(grid).where("metric = 'b'").orderBy("bin").collect()] == [2, 2, 3, 4, 4]
    assert [r.value for r in series.fill_both(grid).where("metric = 'b'").orderBy("bin").collect()] == [2, 2, 4, 4, 4]


def test_time_range_boundaries(spark):
    s = samples(spark, {"a": [0.0, 1, 2, 3]})
    assert series.time_range(s, "2024-01-01 00:00:01", "2024-01-01 00:00:03").count() == 2
    assert series.time_range(s, "2024-01-01 00:00:01", "2024-01-01 00:00:03", closed_left=False).count() == 1


def test_pushdown_reaches_scan(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    plan = series.time_range(e, "2024-01-05", "2024-01-06").select("value")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "props" not in plan


def test_names(spark):
    df = spark.createDataFrame([("used-diff",), ("inactive_file",), ("messages_ack",), ("short",), ("cpu_idle-diff",)], "n string")
    got = df.select(names.strip_diff(F.col("n")), names.strip_diff(F.col("n"), True), names.abbreviate(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [
        ("used", "use", "used-diff"), ("inactive_file", "inactive_file", "inact::e_file"), ("messages_ack", "messages_ack", "messa::es_ack"), ("short", "short", "short"), ("cpu_idle", "cpu_idle", "cpu_i::e-diff"),
    ]
    pairs = spark.createDataFrame([("MARTHA", "MARHTA"), ("", "a"), ("DIXON", "DICKSONX"), ("abc", "xyz")], "a string, b string")
    assert [round(r[0], 6) for r in pairs.select(names.jaro(F.col("a"), F.col("b"))).collect()] == [0.944444, 0, 0.766667, 0]
    label = spark.createDataFrame([("nova_api",), ("rabbit_mq",)], "n string").select(names.print_label(F.col("n"))).collect()
    assert [r[0] for r in label] == ["Nova API", "Rabbit MQ"]
    t = spark.createDataFrame([("2016-09-19T14:07:31.350958Z",), ("2016-09-19T14:07:31Z",), ("x",)], "t string").select(names.parse_time(F.col("t"))).collect()
    assert [r[0] for r in t] == [dt.datetime(2016, 9, 19, 14, 7, 31, 350958), dt.datetime(2016, 9, 19, 14, 7, 31), None]
    kv = spark.createDataFrame([("export OS_USER='bob'",), ("# no",)], "l string").select(names.key_value(F.col("l")).alias("x")).select("x.key", "x.value").collect()
    assert tuple(kv[0]) == ("OS_USER", "bob") and kv[1][0] is None
    text = spark.createDataFrame([(["a", "b", "c", "d"],)], "x array<string>").select(names.lines_of(F.col("x"), 3)).first()[0]
    assert text == "a, b, c\nd"


def test_array_and_fourier_distances_agree(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.standard_normal(16).tolist(), rng.standard_normal(16).tolist()) for i in range(6)] + [(9, [0.0] * 16, [1.0] * 16)], "i int, x array<double>, y array<double>")
    a = {r.i: (round(r.sbd, 9), r.lag) for r in distance.with_sbd(df).collect()}
    b = {r.i: (round(r.sbd, 9), r.lag) for r in distance.with_sbd_long(df).collect()}
    assert {k: v for k, v in a.items() if k != 9} == {k: v for k, v in b.items() if k != 9}
    assert a[9][0] == b[9][0] == 1


def test_kshape_separates_shapes(spark):
    t = np.arange(40)
    waves = {f"w{i}": np.sin(2 * np.pi * (t + i) / 20) for i in range(4)} | {f"r{i}": (t > 15 + i).astype(float) for i in range(4)}
    s = spark.createDataFrame([("s", k, v.tolist()) for k, v in waves.items()], "service string, metric string, v array<double>")
    got = clustering.kshape(clustering.start_labels(s, [2])).toPandas()
    assert got.groupby("cluster").metric.apply(lambda x: {m[0] for m in x}).map(len).eq(1).all()
    best = distance.preferred_k(spark.createDataFrame([("s", 2, 0.5), ("s", 3, 0.5), ("t", 2, -1.0)], "service string, k int, silhouette double"), ["service"])
    assert rows(best) == [("s", 2, 0.5), ("t", 0, None)]


def test_warm_start_closes_gaps(spark):
    s = spark.createDataFrame([("s", m, [0.0]) for m in "abcd"], "service string, metric string, v array<double>")
    prev = spark.createDataFrame([("s", "a", 0), ("s", "b", 2), ("s", "c", 2)], "service string, metric string, cluster int")
    assert {(r.metric, r.start, r.k) for r in clustering.warm_start(s, prev).collect()} == {("a", 0, 3), ("b", 1, 3), ("c", 1, 3), ("d", 2, 3)}


def test_hand_over(spark):
    cols = "service string, cluster int, representative string, members array<string>"
    now = spark.createDataFrame([("s", 0, "a", ["a", "b"]), ("s", 1, "x", ["x", "y"])], cols)
    old = spark.createDataFrame([("s", 0, "b", ["a", "b", "z"]), ("s", 1, "q", ["q"])], cols)
    assert rows(clustering.hand_over(now, old)) == [("s", 0, "b", True), ("s", 1, "x", False)]


def test_granger_direction_and_failures(spark):
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal(400), np.zeros(400)
    for i in range(1, 400):
        y[i] = 0.4 * y[i - 1] + 0.4 * x[i - 1] + 0.5 * rng.standard_normal()
    v = spark.createDataFrame([("a", "x", x.tolist()), ("b", "y", y.tolist()), ("b", "flat", [1.0] * 400), ("c", "z", [0.0] * 400)], "service string, metric string, v array<double>")
    calls = spark.createDataFrame([("a", "b")], "svc_x string, svc_y string")
    got = {(r.p_metric, r.c_metric, r.lag): r for r in causality.granger(causality.series_pairs(v, calls), (1, 2)).collect()}
    assert got["x", "y", 1].p_value < 1e-6 < 0.01 < got["y", "x", 1].p_value
    assert got["x", "flat", 1].p_value is None and got["x", "flat", 1].status != "ok"
    assert not any("z" in k for k in got)
    back = {(r.p_metric, r.c_metric): r.p_value for r in causality.granger(causality.series_pairs(v, calls), (1,), "reference").collect()}
    assert back["y", "x"] == got["x", "y", 1].p_value
    steps = spark.createDataFrame([("a", "x", "b", "y", i, float(x[i]), float(y[i])) for i in range(400)], "p_service string, p_metric string, c_service string, c_metric string, t int, cause double, effect double")
    assert abs(causality.granger_lag1(steps).first().f_stat - got["x", "y", 1].f_stat) < 1e-6


def test_edges_of_missing_directions(spark):
    cols = "perpetrator string, consequence string, " + ", ".join(f"p_for_lag_{i} double" for i in range(1, 6))
    hi = [0.9] * 5
    c = spark.createDataFrame([
        ("a|m", "b|n", 0.0, 0.0, 0.9, 0.9, 0.9), ("b|n", "a|m", 0.0, 0.9, 0.9, 0.9, 0.9),
        ("a|m", "c|k", *hi[:4], 0.0), ("d|q", "c|k", 0.0, None, 0.9, 0.0, 0.9),
    ], cols)
    e = graphs.classify_edges(c)
    assert rows(e) == [("a|m", "b|n", 1, "bidir"), ("a|m", "b|n", 2, "forward"), ("a|m", "c|k", 5, "forward"), ("c|k", "d|q", 1, "back"), ("c|k", "d|q", 4, "back")]
    assert rows(graphs.edges(e)) == [("a|m", "b|n", [2], 1), ("a|m", "c|k", [5], 1), ("d|q", "c|k", [1, 4], 2)]
    assert graphs.graph_stats(e).first().asDict() == {"edges": 5, "forward": 2, "back": 2, "bidir": 1, "services": 4}


BULL = """
0 => .2 => 1
0 => .8 => 2
1 => .5 => 2
1 => .5 => 3
2 => 1 => 4
"""


def test_pagerank_golden(spark):
    arcs = readers.parse_arcs(lines(spark, "0 => 1 => 1\n1 => 1 => 0\nno arc\n0 => .3 => 1"))
    assert rows(graphs.distinct_arcs(arcs))[0][:2] == ("0", "1") and graphs.distinct_arcs(arcs).count() == 2
    got = graphs.pagerank(readers.parse_arcs(lines(spark, BULL)), tolerance=3e-2)
    rounds = got.first().iterations
    total = got.agg(F.sum("rank")).first()[0]
    assert 0 < total < 1.5
    a, n = 0.85, 5
    w = {("0", "1"): .2, ("0", "2"): .8, ("1", "2"): .5, ("1", "3"): .5, ("2", "4"): 1.0}
    r = {str(i): float(i == 0) for i in range(n)}
    for k in range(rounds):
        s = sum(r.values()) if k else 1.0
        d = sum(v for i, v in r.items() if i in "34")
        prev = {i: v / s for i, v in r.items()}
        r = {i: a * sum(x * prev[f] for (f, t), x in w.items() if t == i) + a * d / n + (1 - a) / n for i in r}
    assert 2 < rounds < 30 and all(abs(x.rank - r[x.node]) < 1e-9 for x in got.collect())
    with pytest.raises(ValueError):
        graphs.pagerank(readers.parse_arcs(lines(spark, BULL)), alpha=0)


GOLDEN = """
0 => 0.5 => 1
0 => 0.5 => 2
1 => 0.5 => 2
1 => 0.5 => 3
2 => 1.0 => 4
"""


def test_pagerank_published_values(spark):
    got = graphs.pagerank(readers.parse_arcs(lines(spark, GOLDEN)), start="0")
    assert got.first().iterations == 15
    assert {r.node: round(r.rank, 7) for r in got.collect()} == {"0": 0.1138006, "1": 0.1621656, "2": 0.2310865, "3": 0.1827215, "4": 0.3102259}


def test_numeric_nodes(spark):
    assert [r.node for r in graphs.numeric_nodes(readers.parse_arcs(lines(spark, "0 => 1 => 3"))).collect()] == ["0", "1", "2", "3"]


def test_call_graph(spark):
    cap = lines(spark, "0 1 nova_api < 4 h:5672/v2\n0 1 nova_api > 4 h:9292/\n0 1 x > 4 none\n0 1 x > 4 http://h:1/")
    ports = lines(spark, "rabbitmq:5672,x\nglance:9292")
    e = graphs.call_edges(readers.parse_captures(cap), readers.parse_ports(ports))
    assert rows(e) == [("nova_api", "glance"), ("rabbitmq", "nova_api")]
    dot = readers.parse_dot(lines(spark, 'digraph {\n    "b" -> "a"\n"a" -> "b"\n"a" -> "a"\n}'))
    known = spark.createDataFrame([("a",), ("b",), ("nova_x",)], "service string")
    assert rows(graphs.call_pairs(dot, known, queue="rabbitmq")) == [("a", "b"), ("nova_x", "rabbitmq")]


def test_versions_properties(spark, sf_dir):
    from causalloom.plans import catalog

    c = catalog.clusters(spark, sf_dir).cache()
    diff = versions.metric_diff(c).toPandas()
    f = {(r.service, m) for r in c.where("version = 'f'").collect() for m in r.metrics}
    assert {(s, m) for s, m, k in diff.itertuples(index=False) if k in ("new", "unchanged")} == f
    e = versions.edge_diff(catalog.version_edges(c), c)
    assert e.groupBy("basis", "threshold", "p_service", "p_metric", "c_service", "c_metric").count().where("count > 1 and basis = 'novelty'").isEmpty()
    only = c.where("version = 'f'")
    assert {r.change for r in versions.metric_diff(only).collect()} == {"new"}
    assert {(r.best, r.score) for r in versions.cluster_match(only).collect()} == {(None, 0.0)}


def test_demo_edges(spark):
    got = rows(readers.parse_demo_edges(lines(spark, "a.x > b.y|1.0,2.0\na.x <> c.z|3\nnonsense")))
    assert got == [("a", "x", "b", "y", [1, 2]), ("a", "x", "c", "z", [3]), ("c", "z", "a", "x", [3])]


def test_points_round_trip(spark):
    df = spark.createDataFrame([({"b": "2", "a": "x y"},)], "m map<string,string>")
    line = df.select(writers.point_line(F.lit("cpu"), F.col("m")).alias("value"))
    assert line.first()[0] == 'cpu a="x y",b="2"'
    assert rows(readers.parse_points(line)) == [("cpu", "a", "x y", None), ("cpu", "b", "2", 2.0)]
    many = spark.range(1).select(F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: i.cast("string")), F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: i.cast("string"))).alias("m"))
    assert many.select(writers.point_line(F.lit("cpu"), F.col("m"))).first()[0] is None


def test_files_round_trip(spark, tmp_path):
    wide = spark.createDataFrame([("2024-01-01 00:00:00", "cpu-total", 1.0, None), ("2024-01-01 00:00:01", "cpu0", 2.0, 3.0), ("2024-01-01 00:00:02", None, None, 4.0)], "time string, cpu string, a double, b double")
    writers.write_tsv(wide, f"{tmp_path}/w")
    got = readers.read_wide_samples(spark, f"{tmp_path}/w", "svc", ["a", "b", "gone"])
    assert rows(got.select("metric", "value")) == [("a", 1.0), ("b", 4.0)]
    meta = spark.createDataFrame([("m", "s", "e", "svc", "f.tsv.gz", ["t"], ["a"])], "measurement_name string, start string, end string, name string, filename string, tags array<string>, fields array<string>")
    writers.write_metadata(meta, f"{tmp_path}/meta")
    assert readers.read_metadata(spark, f"{tmp_path}/meta").first().name == "svc"
    assert rows(readers.catalog(wide)) == [("a", "field"), ("b", "field"), ("cpu", "tag"), ("time", "tag")]
    writers.write_lines(writers.dot_lines(spark.createDataFrame([("a", "b")], "src string, dst string")), f"{tmp_path}/dot")
    assert rows(readers.parse_dot(spark.read.text(f"{tmp_path}/dot"))) == [("a", "b")]
    writers.write_merged([wide.drop("b"), wide.select("time", "b")], ["a", "b"], ["cpu"], f"{tmp_path}/merged")
    assert readers.read_tsv(spark, f"{tmp_path}/merged").columns == ["a", "b", "cpu", "time"]


def test_reports(spark):
    inv = spark.createDataFrame([("s", 5, 3, 2)], "service string, n_samples long, raw_metrics long, kept_metrics long")
    sc = spark.createDataFrame([("s", 2, 0.25), ("s", 3, 0.5)], "service string, k int, silhouette double")
    assert writers.markdown_report(inv, sc).collect()[1].value == "| s | 3 | 2 | 3 | 0.500 |"
    assert writers.latex_rows(sc).first().value == "s & 2 & 0.25 \\\\"
    cl = spark.createDataFrame([("s", 0, "inactive_file", ["b", "inactive_file"])], "service string, cluster int, representative string, metrics array<string>")
    assert writers.metric_table(cl).first().cell == "inact::e_file:\nb, inact::e_file"
    st = spark.createDataFrame([(True, ""), (False, "boom")], "ok boolean, m string").select(writers.status_line(F.col("ok"), F.col("m")))
    assert [r[0] for r in st.collect()] == ["status okay", "status error boom"]


def test_diagnostics(spark):
    rng = np.random.default_rng(7)
    v = spark.createDataFrame([("s", "n", rng.standard_normal(200).tolist()), ("s", "flat", [1.0] * 200), ("s", "up", np.cumsum(np.abs(rng.standard_normal(200))).tolist())], "service string, metric string, v array<double>")
    got = {(r.metric, r.regression): r.p_value for r in diagnostics.adf(v).collect()}
    assert got["n", "c"] < 0.01 and got["flat", "c"] == -0.1 and got["up", "c"] < 0.05
    assert {r.metric: r.w for r in diagnostics.shapiro(v).collect()}["flat"] is None
    assert diagnostics.sampled_per_bin(diagnostics.adf(v), 1).groupBy("regression", "bin").count().where("count > 1").isEmpty()


def test_name_clusters_follow_chains(spark):
    n = spark.createDataFrame([(f"n{i:02d}",) for i in range(20)], "name string")
    p = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}", 0.1 if i != 9 else 0.9) for i in range(19)], "a string, b string, d double")
    assert {r.label for r in clustering.name_clusters(p, n, 0.5).collect()} == {"n00", "n10"}


def test_gap_is_finite(spark):
    rng = np.random.default_rng(1)
    s = spark.createDataFrame([("s", f"m{i}", rng.standard_normal(16).tolist()) for i in range(6)], "service string, metric string, v array<double>")
    assert all(np.isfinite(r.gap) for r in clustering.gap_statistic(s, [2, 3], 3).collect())


def test_interpolation_takes_linear_time(spark):
    import time

    from pyspark.sql import functions as F

    from causalloom.operators import series

    def seconds(n):
        grid = spark.range(n).select(F.lit("s").alias("service"), F.lit("m").alias("metric"), F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("bin"), F.when(F.col("id") % 7 == 0, F.col("id").cast("double")).alias("value"))
        began = time.time()
        assert series.interpolate(grid).where(F.col("value") != F.least(F.unix_seconds(F.col("bin").cast("timestamp")), F.lit((n - 1) // 7 * 7))).count() == 0
        assert series.fill_both(grid).where(F.col("value").isNull()).count() == 0
        return time.time() - began

    seconds(1000)
    assert seconds(40_000) < 2.5 * seconds(20_000) + 2


def test_names_cut_to_a_number_of_clusters(spark):
    names = spark.createDataFrame([(x,) for x in "abcde"], "name string")
    pairs = spark.createDataFrame([("a", "b", 0.1), ("b", "c", 0.2), ("d", "e", 0.2), ("a", "c", 0.6), ("c", "d", 0.7), ("a", "e", 0.9)], "a string, b string, d double")

    def groups(size):
        got = {}
        for r in clustering.name_clusters_to(pairs, names, size).collect():
            got.setdefault(r.label, []).append(r.name)
        return sorted("".join(sorted(x)) for x in got.values())

    assert groups(5) == list("abcde")
    assert groups(4) == ["ab", "c", "d", "e"]
    assert groups(3) == groups(2) == ["abc", "de"]  # both pairs at 0.2 join at once
    assert groups(1) == ["abcde"]
    assert clustering.name_clusters_to(pairs.limit(0), names, 2).count() == 5
    assert clustering.name_clusters_to(pairs, names.limit(0), 2).count() == 0


def test_files_by_pattern(spark, tmp_path):
    for name in ("a_causality.tsv.gz", "a.tsv.gz", "causality.tsv"):
        (tmp_path / name).write_bytes(b"xyz")
    got = readers.list_files(spark, str(tmp_path)).collect()
    assert [(r.path.rpartition("/")[2], r.length) for r in got] == [("a_causality.tsv.gz", 3)]


def test_merge_keeps_time_order_and_source_order_at_ties(spark):
    a = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2024-01-01 00:00:02.5', 'a1'), (TIMESTAMP_NTZ'2024-01-01 00:00:00', 'a0'), (NULL, 'none') AS t(ts, x)")
    b = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2024-01-01 00:00:02.4', 'b1'), (TIMESTAMP_NTZ'2024-01-01 00:00:00', 'b0') AS t(ts, x)")
    assert [r.x for r in series.merged(a, b).collect()] == ["none", "a0", "b0", "b1", "a1"]
    assert [r.x for r in series.merged(b, a).collect()] == ["none", "b0", "a0", "b1", "a1"]


def test_endpoint_lines(spark):
    rows = spark.createDataFrame([(1, True, 0.0123456), (2, False, 1.0), (3, None, None), (4, True, None)], "i int, up boolean, s double")
    got = {r.i: r.x for r in rows.select("i", monitoring.endpoint_lines(F.lit("api"), F.col("up"), F.col("s")).alias("x")).collect()}
    assert got[1] == ["status okay", "metric api_status uint32 1", "metric api_response_time double 12.346 ms"]
    assert got[2] == got[3] == ["status okay", "metric api_status uint32 0"]
    assert got[4] == ["status okay", "metric api_status uint32 1"]


def test_gauges_take_nulls_for_nothing(spark):
    hosts = spark.createDataFrame([("x", 2, 1), ("x", None, 3), ("y", 4, None)], "g string, total_cpu int, used_cpu int")
    got = {r.g: (r.total, r.used, r.free) for r in monitoring.hypervisor_gauges(hosts, "g", {"cpu": 16.0}).collect()}
    assert got == {"x": (32.0, 4.0, 28.0), "y": (64.0, None, 64.0)}


def test_first_of_tied_arcs(spark):
    arcs = spark.createDataFrame([(1, "a", 3.0, "b"), (1, "a", 2.0, "b"), (0, "c", 9.0, "a"), (2, "c", 1.0, "a")], "line long, src string, w double, dst string")
    assert {(r.src, r.dst): r.w for r in graphs.distinct_arcs(arcs).collect()} == {("a", "b"): 2.0, ("c", "a"): 9.0}
    assert [r.node for r in graphs.first_seen(arcs).orderBy("seen").collect()] == ["c", "a", "b"]

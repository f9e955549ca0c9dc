"""From samples to ranked causes, end to end, on two small versions with a planted change."""

import datetime as dt

import numpy as np

from causalloom.operators import distance
from causalloom.plans import analysis


def make(spark, seed, extra):
    rng = np.random.default_rng(seed)
    n, t0 = 160, dt.datetime(2024, 1, 1)
    drive = rng.standard_normal(n)
    load = np.concatenate([[0], drive[:-1]]) * 0.9 + 0.3 * rng.standard_normal(n)
    wave = np.sin(np.arange(n) / 6)
    data = {
        "api": {"req": drive, "req2": drive + 0.05 * rng.standard_normal(n), "w1": wave, "w2": wave + 0.05 * rng.standard_normal(n), "flat": np.ones(n)},
        "db": {"load": load, "load2": load + 0.05 * rng.standard_normal(n), "v1": -wave, "v2": 0.05 * rng.standard_normal(n) - wave},
    }
    data["db"] |= {m: wave**2 + 0.01 * rng.standard_normal(n) for m in extra}
    rows = [(s, m, t0 + dt.timedelta(seconds=i), float(v)) for s, ms in data.items() for m, vs in ms.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "service string, metric string, ts timestamp_ntz, value double")


def test_two_versions(spark):
    calls = spark.createDataFrame([("api", "db")], "svc_x string, svc_y string")
    sound = analysis.analyse(make(spark, 1, []), calls, "1 second", (2, 3))
    faulty = analysis.analyse(make(spark, 1, ["err"]), calls, "1 second", (2, 3))
    assert not {"flat"} & {r.metric for r in sound.series.select("metric").collect()}
    assert any(r.perpetrator.startswith("api|req") and r.consequence.startswith("db|load") for r in sound.edges.collect())
    report = analysis.compare(faulty, sound)
    assert report.services.first().service == "db"
    assert [tuple(r) for r in report.metrics.where("change <> 'unchanged'").collect()] == [("db", "err", "new")]
    assert report.histogram.count() >= 2 and report.edge_counts.count() >= 0 and report.silhouettes.count() == 2
    warm = analysis.analyse(make(spark, 1, []), calls, "1 second", previous=sound)
    assert warm.clusters.count() > 0


def test_small_helpers(spark):
    from pyspark.sql import functions as F

    x = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>")
    assert [x.select(distance.shifted(F.col("x"), F.lit(k))).first()[0] for k in (1, -1, 5)] == [[0, 1, 2], [2, 3, 0], [0, 0, 0]]
    sc = spark.createDataFrame([("s", 2, 0.1), ("s", 3, 0.4)], "service string, k int, silhouette double")
    assert ("s", "best", 3.0) in [tuple(r) for r in distance.index_table(sc, ["service"]).collect()]
    pk = spark.createDataFrame([("s", 6), ("t", 3), ("u", 7)], "service string, preferred_k int")
    fields = spark.createDataFrame([("s", 10), ("t", 30), ("u", 8)], "service string, n_fields int")
    assert sorted(tuple(r) for r in distance.larger_ks(pk, fields).collect()) == [("s", 8), ("s", 9)]


def test_pagerank_cli(spark, tmp_path, capsys):
    from causalloom.plans import pagerank

    (tmp_path / "g.txt").write_text("0 => 1 => 2\n2 => 1 => 0\n")
    assert pagerank.main([f"file://{tmp_path}/g.txt", "-n", "-m", "3"]) == 0
    assert [x.split(" = ")[0] for x in capsys.readouterr().out.split("\n") if " = " in x] == ["0", "1", "2"]


def test_expire(spark, tmp_path):
    from causalloom.streaming import live

    spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-05")], "x int, day string").write.partitionBy("day").parquet(f"{tmp_path}/p")
    assert live.expire(spark, f"file://{tmp_path}/p", "2024-01-03") == ["2024-01-01"]
    assert spark.read.parquet(f"{tmp_path}/p").count() == 1


def test_shared_folder(spark):
    from causalloom.functions import runtime

    df = runtime.materialize(spark.range(5), "t")
    assert df.count() == 5 and df.inputFiles()[0].startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir")[:7])
    path = runtime.shared_dir(spark, "x")
    assert path.startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))

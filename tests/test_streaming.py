"""Streams driven to completion over Parquet files."""

import time

from pyspark.sql import functions as F

from causalloom.streaming import live


def stream(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("service"), F.concat(F.lit("m"), F.col("user_id") % 6).alias("metric"), "ts", "value")
    e.write.parquet(f"{tmp_path}/in")
    return e, spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")


def drain(q):
    q.processAllAvailable()
    q.stop()


def test_collected_equals_batch(spark, sf_dir, tmp_path):
    e, s = stream(spark, sf_dir, tmp_path)
    drain(live.collected(s, "1 hour", "1 minute").writeStream.format("memory").queryName("collected").outputMode("complete").start())
    want = e.groupBy(F.window("ts", "1 hour"), "service", "metric").count().count()
    assert spark.table("collected").count() == want


def test_statsd(spark, sf_dir, tmp_path):
    _, s = stream(spark, sf_dir, tmp_path)
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("counter", "gauge", "set", "timing")]), F.pmod(F.crc32("metric"), F.lit(4)).cast("int") + 1)
    named = s.select(F.concat("service", "metric").alias("name"), kinds.alias("kind"), "ts", "value")
    drain(live.statsd(named, "1 day").writeStream.format("memory").queryName("statsd").outputMode("complete").start())
    assert spark.table("statsd").count() > 0


def test_moving_average(spark, sf_dir, tmp_path):
    e, s = stream(spark, sf_dir, tmp_path)
    drain(live.moving_average(s, 5).writeStream.format("memory").queryName("moving").outputMode("update").start())
    assert spark.table("moving").select("service", "metric").distinct().count() == e.select("service", "metric").distinct().count()
    assert spark.table("moving").agg(F.max("n")).first()[0] <= 5


def test_deadman_reports_silence(spark, sf_dir, tmp_path):
    _, s = stream(spark, sf_dir, tmp_path)
    q = live.deadman(live.scale(s, 2.0), 500).writeStream.format("memory").queryName("deadman").outputMode("append").start()
    end = time.time() + 40
    while time.time() < end and spark.table("deadman").isEmpty():
        time.sleep(0.5)
    q.stop()
    assert {r.alert for r in spark.table("deadman").collect()} == {"deadman"}


def test_sink_with_retention(spark, sf_dir, tmp_path):
    _, s = stream(spark, sf_dir, tmp_path)
    q = live.run_query(live.scale(s, 1.0), f"{tmp_path}/out", f"{tmp_path}/check", "0 seconds", "ts")
    drain(q)
    assert "day" in spark.read.parquet(f"{tmp_path}/out").columns

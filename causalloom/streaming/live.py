"""Live ingest: tumbling aggregation, absence alerts, running statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def collected(samples: DataFrame, interval: str = "5 seconds", lateness: str = "1 minute") -> DataFrame:
    """Mean and count per series and interval; rows later than the watermark are dropped."""
    rows = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    out = rows.groupBy(F.window("ts", interval), "service", "metric").agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    return out.select("service", "metric", F.col("window.start").alias("bin"), "value", "n")


def statsd(events: DataFrame, interval: str = "10 seconds", lateness: str = "1 minute") -> DataFrame:
    """Counters summed, gauges by their last value, sets by distinct values, timings by their 90th percentile; (name, kind, value) per interval."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    v = F.col("value")
    out = rows.groupBy(F.window("ts", interval), "name", "kind").agg(
        F.sum(v).alias("total"), F.max_by(v, "ts").alias("last"), F.approx_count_distinct(v).cast("double").alias("members"), F.percentile_approx(v, 0.9, 10000).alias("p90"),
    )
    pick = F.when(F.col("kind") == "counter", F.col("total")).when(F.col("kind") == "gauge", F.col("last")).when(F.col("kind") == "set", F.col("members")).otherwise(F.col("p90"))
    return out.select("name", "kind", F.col("window.start").alias("bin"), pick.alias("value"))


def scale(samples: DataFrame, factor: float) -> DataFrame:
    return samples.withColumn("value", F.col("value") * factor)


def deadman(samples: DataFrame, interval_ms: int = 10_000, threshold: float = 0.0) -> DataFrame:
    """An alert for each service that sent no more than `threshold` points during an interval.

    State is a count per service; a processing-time timer fires every interval, so a
    service that falls silent is reported although no row of it arrives.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n = state.get[0] if state.exists else 0
            state.update((0,))
            state.setTimeoutDuration(interval_ms)
            if n <= threshold:
                yield pd.DataFrame({"service": [key[0]], "points": [n], "alert": ["deadman"]})
            return
        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((int(n),))
        state.setTimeoutDuration(interval_ms)

    out = T.StructType.fromDDL("service string, points long, alert string")
    kept = T.StructType.fromDDL("points long")
    return samples.groupBy("service").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.ProcessingTimeTimeout)


def moving_average(samples: DataFrame, size: int = 1000) -> DataFrame:
    """Mean of the last `size` values of each series, emitted per micro-batch; state is at most `size` numbers a series."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for b in batches:
            held = (held + b.sort_values("ts")["value"].tolist())[-size:]
        state.update((held,))
        if held:
            yield pd.DataFrame({"service": [key[0]], "metric": [key[1]], "mean": [sum(held) / len(held)], "n": [len(held)]})

    out = T.StructType.fromDDL("service string, metric string, mean double, n long")
    kept = T.StructType.fromDDL("held array<double>")
    return samples.groupBy("service", "metric").applyInPandasWithState(step, out, kept, "update", GroupStateTimeout.NoTimeout)


def run_query(stream: DataFrame, path: str, checkpoint: str, trigger: str = "10 seconds", retention_column: str | None = None):
    """Write a stream as Parquet with a checkpoint; by date of the retention column if given, so old days can be dropped."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).option("path", path).format("parquet").outputMode("append").trigger(processingTime=trigger)
    if retention_column:
        writer = stream.withColumn("day", F.to_date(retention_column)).writeStream.option("checkpointLocation", checkpoint).option("path", path).format("parquet").outputMode("append").trigger(processingTime=trigger).partitionBy("day")
    return writer.start()


def expire(spark, path: str, before: str, column: str = "day") -> list[str]:
    """Delete the partitions of a written stream that lie before a date; returns the dates. Works on any Hadoop file system."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(f"{column}=") and name.removeprefix(f"{column}=") < before:
            fs.delete(status.getPath(), True)
            gone.append(name.removeprefix(f"{column}="))
    return sorted(gone)

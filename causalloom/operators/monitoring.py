"""Aggregations of monitoring checks: states, meters, timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalloom.functions.names import elapsed_ms


def status_counts(rows: DataFrame, by: str, status: str, states: list[str]) -> DataFrame:
    """Rows per group and state, one column a state, and in all."""
    return rows.groupBy(by).agg(*[F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in states], F.count("*").alias("n_total"))


def meter_stats(rows: DataFrame, by: str, value: str) -> DataFrame:
    """min, max, avg and sum of a meter; avg_time is the sum over the count."""
    v = F.col(value)
    return rows.groupBy(by).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("avg"), F.sum(v).alias("sum"), F.count(v).alias("count"), F.try_divide(F.sum(v), F.count(v)).alias("avg_time"))


def percentile_by_window(samples: DataFrame, step: str, p: float = 0.9) -> DataFrame:
    """Exact percentile and count of each service's values per window."""
    return samples.groupBy("service", F.window("ts", step)["start"].alias("bin")).agg(F.percentile("value", F.lit(p)).alias("p"), F.count("*").alias("n"))


def scaled(gauge: Column, ratio: Column | float) -> Column:
    return gauge * ratio


def table_rows(pages: DataFrame, column: str = "html", tag: str = "li") -> DataFrame:
    """Opening tags of a kind per page."""
    return pages.select("page_id", F.regexp_count(column, F.lit(f"(?i)<{tag}[ >]")).cast("long").alias("n_rows"))


def hypervisor_gauges(hosts: DataFrame, by: str, ratios: dict[str, float]) -> DataFrame:
    """Per group and resource: total (times its allocation ratio), used, and what is free.

    hosts has total_X and used_X columns for each resource X of ratios; nulls count as nothing.
    """
    parts = [F.struct(F.lit(x).alias("resource"), scaled(F.col(f"total_{x}"), F.lit(ratio)).alias("total"), F.col(f"used_{x}").cast("double").alias("used")) for x, ratio in sorted(ratios.items())]
    rows = hosts.select(F.col(by), F.explode(F.array(*parts)).alias("__gauge")).groupBy(by, "__gauge.resource").agg(F.sum("__gauge.total").alias("total"), F.sum("__gauge.used").alias("used"))
    return rows.withColumn("free", F.coalesce("total", F.lit(0.0)) - F.coalesce("used", F.lit(0.0)))


def endpoint_lines(check: Column, up: Column, seconds: Column) -> Column:
    """Status lines of an endpoint check: the state, and the response time only where it is up.

    Null states count as down; a null time gives no line.
    """
    is_up = F.coalesce(up, F.lit(False))
    time = F.when(is_up, F.format_string("metric %s_response_time double %.3f ms", check, elapsed_ms(seconds)))
    state = F.format_string("metric %s_status uint32 %d", check, is_up.cast("int"))
    return F.array_compact(F.array(F.lit("status okay"), state, F.when(seconds.isNotNull(), time)))

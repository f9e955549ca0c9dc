"""Regular, gap-free, classified series from raw samples (service, metric, ts, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["service", "metric"]


def time_range(samples: DataFrame, begin: str, end: str, closed_left: bool = True) -> DataFrame:
    """Samples in [begin, end); closed_left=False also leaves out rows at begin exactly. Reaches the scan as a pushed filter."""
    ts, low, high = F.col("ts"), F.lit(begin).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return samples.where((ts >= low if closed_left else ts > low) & (ts < high))


def matching(samples: DataFrame, pattern: str, column: str = "metric") -> DataFrame:
    """Rows whose column matches a regular expression anywhere."""
    return samples.where(F.col(column).rlike(pattern))


def null_or_total(rows: DataFrame, column: str = "cpu", total: str = "cpu-total", by: str | None = None) -> DataFrame:
    """If the column has any value (within `by`), keep rows where it is null or the total; else keep all."""
    has_any = F.max(F.col(column).isNotNull()).over(Window.partitionBy(*([by] if by else [])))
    if by is None:
        found = rows.agg(F.max(F.col(column).isNotNull())).first()[0]
        return rows.where(F.col(column).isNull() | (F.col(column) == total)) if found else rows
    return rows.withColumn("__any", has_any).where(~F.col("__any") | F.col(column).isNull() | (F.col(column) == total)).drop("__any")


def union_sources(*sources: DataFrame) -> DataFrame:
    """Rows of all sources under the union of their columns; missing ones are null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def merged(*sources: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows of all sources in time order, with `source`, their place among the arguments; at equal times the earlier source comes first.

    Null times come first. A range exchange sorts, so no task holds more than its range.
    """
    return union_sources(*[s.withColumn("source", F.lit(i)) for i, s in enumerate(sources)]).orderBy(ts, "source")


def wide_to_long(rows: DataFrame, service: str, fields: list[str], ts: str = "time") -> DataFrame:
    """Wide rows as long samples; NaN counts as null, nulls are left out."""
    long = rows.select(F.lit(service).alias("service"), F.col(ts).cast("timestamp_ntz").alias("ts"), *[F.col(f"`{f}`").cast("double").alias(f) for f in fields])
    long = long.unpivot(["service", "ts"], fields, "metric", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value")).select("service", "metric", "ts", "value")


def resample_mean(samples: DataFrame, step: str = "500 milliseconds") -> DataFrame:
    """Mean of each series per time bin, left-closed, labelled by its start; one partial aggregation."""
    return samples.groupBy(*SERIES, F.window("ts", step)["start"].alias("bin")).agg(F.avg("value").alias("value"))


def on_grid(binned: DataFrame, step: str = "500 milliseconds") -> DataFrame:
    """Every bin of the service's range for each of its series; value is null in gaps.

    The service's range is one row a service, so its join is small on one side whatever
    the number of samples.
    """
    span = binned.groupBy("service").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    series = binned.select(*SERIES).distinct().join(span, "service")
    grid = series.select(*SERIES, F.explode(F.expr(f"sequence(lo, hi, interval {step})")).alias("bin"))
    return grid.join(binned, [*SERIES, "bin"], "left")


def _known_around(grid: DataFrame, value: Column, previous: str, following: str) -> DataFrame:
    """grid with the last known value up to each row and the first from it on, both as growing frames: linear in a series."""
    upto = Window.partitionBy(*SERIES).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*SERIES).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    return grid.withColumns({previous: F.last(value, True).over(upto), following: F.last(value, True).over(down)})


def interpolate(grid: DataFrame) -> DataFrame:
    """Linear in time between known values, clamped to the nearest at both ends; all-null series stay null."""
    known = F.when(F.col("value").isNotNull(), F.struct(F.unix_micros(F.col("bin").cast("timestamp")).alias("t"), F.col("value").alias("v")))
    rows = _known_around(grid, known, "p", "n")
    t = F.unix_micros(F.col("bin").cast("timestamp"))
    between = F.col("p.v") + (F.col("n.v") - F.col("p.v")) * (t - F.col("p.t")) / (F.col("n.t") - F.col("p.t"))
    filled = F.coalesce("value", F.when(F.col("p").isNull(), F.col("n.v")).when(F.col("n").isNull(), F.col("p.v")).otherwise(between))
    return rows.select(*SERIES, "bin", filled.alias("value"))


def fill_both(grid: DataFrame) -> DataFrame:
    """Backward fill, then forward fill."""
    return _known_around(grid, F.col("value"), "p", "n").select(*SERIES, "bin", F.coalesce("n", "p").alias("value"))


def classify(regular: DataFrame) -> DataFrame:
    """One row a series: n, nulls, and klass: empty (any null), constant, monotonic (never falls) or other."""
    step = F.col("value") - F.lag("value").over(Window.partitionBy(*SERIES).orderBy("bin"))
    sums = regular.withColumn("step", step).groupBy(*SERIES).agg(
        F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.min("step").alias("least_step"),
    )
    klass = F.when(F.col("nulls") > 0, "empty").when(F.col("lo") == F.col("hi"), "constant").when(F.col("least_step") >= 0, "monotonic").otherwise("other")
    return sums.select(*SERIES, "n", "nulls", klass.alias("klass"))


def prepared(regular: DataFrame) -> DataFrame:
    """Series that carry information: others as they are, monotonic ones differenced under `<metric>-diff`; the first row goes.

    Classification and differencing share one window, so the table is shuffled once.
    """
    w = Window.partitionBy(*SERIES).orderBy("bin")
    whole = Window.partitionBy(*SERIES)
    rows = regular.withColumns({"step": F.col("value") - F.lag("value").over(w), "rn": F.row_number().over(w)})
    rows = rows.withColumns({
        "nulls": F.count_if(F.col("value").isNull()).over(whole), "lo": F.min("value").over(whole), "hi": F.max("value").over(whole), "least": F.min("step").over(whole),
    }).where((F.col("nulls") == 0) & (F.col("lo") != F.col("hi")) & (F.col("rn") > 1))
    up = F.col("least") >= 0
    return rows.select("service", F.when(up, F.concat("metric", F.lit("-diff"))).otherwise(F.col("metric")).alias("metric"), "bin", F.when(up, F.col("step")).otherwise(F.col("value")).alias("value"))


def zscore(regular: DataFrame, ddof: int = 0) -> DataFrame:
    """(v - mean) / deviation per series; constant series are zeros."""
    whole = Window.partitionBy(*SERIES)
    std = (F.stddev_pop if ddof == 0 else F.stddev_samp)("value").over(whole)
    z = F.try_divide(F.col("value") - F.avg("value").over(whole), std)
    return regular.select(*SERIES, "bin", F.coalesce(F.nanvl(z, F.lit(None).cast("double")), F.lit(0.0)).alias("z"))


def align(samples: DataFrame, left: str, right: str, step: str) -> DataFrame:
    """Two services on the union of their bins: one row a bin, one column each (a full outer join in one aggregation)."""
    w = F.window("ts", step)["start"].alias("bin")
    mine = samples.where(F.col("service").isin(left, right)).groupBy(w)
    return mine.agg(F.avg(F.when(F.col("service") == left, F.col("value"))).alias("left_value"), F.avg(F.when(F.col("service") == right, F.col("value"))).alias("right_value"))


def vectors(regular: DataFrame) -> DataFrame:
    """One row a series with its values in time order as an array: the form that vector kernels take."""
    packed = regular.groupBy(*SERIES).agg(F.sort_array(F.collect_list(F.struct("bin", "value"))).alias("x"))
    return packed.select(*SERIES, F.size("x").alias("n"), F.element_at("x", 1)["bin"].alias("t0"), F.transform("x", lambda p: p["value"]).alias("v"))


def inventory(samples: DataFrame, kept: DataFrame) -> DataFrame:
    """Per service: metrics in the raw samples and in the prepared series."""
    raw = samples.groupBy("service").agg(F.count_distinct("metric").alias("raw_metrics"), F.count("*").alias("n_samples"))
    left = kept.groupBy("service").agg(F.count_distinct("metric").alias("kept_metrics"))
    return raw.join(left, "service", "left").select("service", "n_samples", "raw_metrics", F.coalesce("kept_metrics", F.lit(0)).cast("long").alias("kept_metrics"))

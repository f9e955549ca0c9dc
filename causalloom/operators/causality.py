"""Granger causality between representatives of services that call each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalloom.functions import kernels

LAGS = (1, 2, 3, 4, 5)


def series_pairs(series: DataFrame, calls: DataFrame) -> DataFrame:
    """Ordered pairs of series of services that call each other: (p_*, c_*), both directions.

    The calls are joined before the pairing, so only pairs that a call allows are ever
    built; vectors are joined to names last.
    """
    both = calls.select(F.col("svc_x").alias("p_service"), F.col("svc_y").alias("c_service")).union(calls.select("svc_y", "svc_x")).distinct()
    names = series.select("service", "metric")
    pairs = both.join(names.toDF("p_service", "p_metric"), "p_service").join(names.toDF("c_service", "c_metric"), "c_service")
    pairs = pairs.where((F.col("p_service") != F.col("c_service")) | (F.col("p_metric") != F.col("c_metric")))
    left = series.select(F.col("service").alias("p_service"), F.col("metric").alias("p_metric"), F.col("v").alias("p_v"))
    right = series.select(F.col("service").alias("c_service"), F.col("metric").alias("c_metric"), F.col("v").alias("c_v"))
    return pairs.join(left, ["p_service", "p_metric"]).join(right, ["c_service", "c_metric"])


def granger(pairs: DataFrame, lags: tuple[int, ...] = LAGS, direction: str = "statistical") -> DataFrame:
    """F test per pair and lag: does the past of one series help to predict the other?

    direction="statistical": the perpetrator is the series whose past helps. "reference"
    names them the other way round. A pair that cannot be tested (constant, too short,
    perfect fit) gets a null p with the reason as its status, so no pair goes missing.
    """
    if direction not in ("statistical", "reference"):
        raise ValueError(direction)
    schema = "p_service string, p_metric string, c_service string, c_metric string, lag int, f_stat double, p_value double, status string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                cause, effect = np.array(r["p_v"], float), np.array(r["c_v"], float)
                n = min(len(cause), len(effect))
                if direction == "reference":
                    cause, effect = effect, cause
                for lag in lags:
                    try:
                        f, p, why = *kernels.granger(effect[:n], cause[:n], lag), "ok"
                    except (ValueError, np.linalg.LinAlgError) as e:
                        f, p, why = None, None, str(e)
                    rows.append((r["p_service"], r["p_metric"], r["c_service"], r["c_metric"], lag, f, p, why))
            kinds = [pa.string()] * 4 + [pa.int32(), pa.float64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names)

    return pairs.mapInArrow(run, schema)


def granger_lag1(pairs: DataFrame) -> DataFrame:
    """The lag-1 F statistic by correlations alone, without leaving the JVM.

    F = r^2 / (1 - r^2) * dof with r the partial correlation of effect and lagged cause
    given the lagged effect; pairs has (p_*, c_*, t, cause, effect) one row a time step.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("p_service", "p_metric", "c_service", "c_metric").orderBy("t")
    rows = pairs.withColumns({"y1": F.lag("effect").over(w), "x1": F.lag("cause").over(w)}).where(F.col("y1").isNotNull())
    m = rows.groupBy("p_service", "p_metric", "c_service", "c_metric").agg(
        F.count("*").alias("n"), F.corr("effect", "x1").alias("yx"), F.corr("effect", "y1").alias("yy"), F.corr("x1", "y1").alias("xy"),
    )
    r2 = F.pow(F.col("yx") - F.col("yy") * F.col("xy"), 2) / ((1 - F.pow("yy", F.lit(2))) * (1 - F.pow("xy", F.lit(2))))
    f = r2 / (1 - r2) * (F.col("n") - 3)
    return m.select("p_service", "p_metric", "c_service", "c_metric", "n", f.alias("f_stat"))


def pivoted(causality: DataFrame, lags: tuple[int, ...] = LAGS) -> DataFrame:
    """One row a pair: perpetrator and consequence as service|metric, p_for_lag_i columns."""
    p, c = F.concat_ws("|", "p_service", "p_metric"), F.concat_ws("|", "c_service", "c_metric")
    return causality.groupBy(p.alias("perpetrator"), c.alias("consequence")).agg(*[F.max(F.when(F.col("lag") == i, F.col("p_value"))).alias(f"p_for_lag_{i}") for i in lags])

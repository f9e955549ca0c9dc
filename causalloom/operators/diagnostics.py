"""Diagnostics of series: normality, stationarity, lag to the centroid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causalloom.functions import kernels


def informative(regular: DataFrame) -> DataFrame:
    """Series with a value and a variance other than 0."""
    return regular.groupBy("service", "metric").agg(F.count("value").alias("n"), F.var_samp("value").alias("variance")).where((F.col("n") > 0) & (F.col("variance") != 0))


def normality(regular: DataFrame) -> DataFrame:
    """D'Agostino and Pearson's K^2 per series and its p value exp(-K^2 / 2); from moments, in one aggregation."""
    m = regular.groupBy("service", "metric").agg(F.count("value").cast("double").alias("n"), F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2"))
    n, b2 = F.col("n"), F.col("g2") + 3
    y = F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    delta, alpha = 1 / F.sqrt(0.5 * F.log(w2)), F.sqrt(2 / (w2 - 1))
    z1 = delta * F.log(y / alpha + F.sqrt(F.pow(y / alpha, F.lit(2)) + 1))
    mean, var = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - mean) / F.sqrt(var)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    part = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - F.signum(part) * F.pow(F.abs(part), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    return m.where(n >= 8).select("service", "metric", n.cast("long").alias("n"), k2.alias("k2"), F.exp(-k2 / 2).alias("p_value"))


def _per_series(series: DataFrame, f, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([row for s, m, v in zip(pdf["service"], pdf["metric"], pdf["v"], strict=True) for row in f(s, m, np.asarray(v, float))], columns=[x.split()[0] for x in schema.split(", ")])

    return series.select("service", "metric", "v").mapInPandas(run, schema)


def shapiro(series: DataFrame) -> DataFrame:
    """Shapiro-Wilk W and p per series; nulls where it does not apply."""

    def one(s: str, m: str, v: np.ndarray):
        try:
            yield (s, m, *kernels.shapiro(v))
        except ValueError:
            yield (s, m, None, None)

    return _per_series(series, one, "service string, metric string, w double, p_value double")


def adf(series: DataFrame, regressions: tuple[str, ...] = ("c", "ct", "ctt")) -> DataFrame:
    """Augmented Dickey-Fuller per series and regression; series that never fall are differenced first; p -0.1 where undefined."""

    def one(s: str, m: str, v: np.ndarray):
        v = np.diff(v) if len(v) > 1 and (np.diff(v) >= 0).all() else v
        for r in regressions:
            try:
                yield (s, m, r, *kernels.adf(v, r))
            except (ValueError, ZeroDivisionError):
                yield (s, m, r, None, -0.1)

    return _per_series(series, one, "service string, metric string, regression string, statistic double, p_value double")


def adf_bins(tests: DataFrame, width: float = 0.05) -> DataFrame:
    """Series per regression and p value rounded to multiples of width."""
    return tests.groupBy("regression", (F.round(F.col("p_value") / width) * width).alias("bin")).agg(F.count("*").alias("n"))


def sampled_per_bin(tests: DataFrame, most: int = 10, width: float = 0.05, seed: int = 7) -> DataFrame:
    """Up to `most` series of each (regression, bin), by a seeded hash of their names."""
    rows = tests.withColumn("bin", F.round(F.col("p_value") / width) * width)
    rank = F.row_number().over(Window.partitionBy("regression", "bin").orderBy(F.xxhash64(F.lit(seed), "service", "metric"), "service", "metric"))
    return rows.withColumn("rn", rank).where(F.col("rn") <= most).drop("rn")


def lag_to_centroid(labelled: DataFrame) -> DataFrame:
    """Steps by which each member (v) trails its centroid."""
    from causalloom.operators.distance import with_sbd_long

    return with_sbd_long(labelled, "centroid", "v").select("service", "k", "metric", "cluster", "lag", "sbd")

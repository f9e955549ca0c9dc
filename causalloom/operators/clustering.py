"""k-Shape clustering per (service, k), warm starts, hand-over of representatives, name clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causalloom.functions import kernels
from causalloom.functions.runtime import materialize
from causalloom.operators import distance
from causalloom.operators.components import components


def start_labels(series: DataFrame, ks: list[int]) -> DataFrame:
    """(service, k, metric, v, start): starting labels from a hash of the name, the same on every run."""
    many = series.select("service", "metric", "v", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    return many.withColumn("start", F.pmod(F.crc32(F.concat_ws("|", F.lit(7), "service", "metric")), F.col("k")).cast("int"))


def warm_start(series: DataFrame, previous: DataFrame) -> DataFrame:
    """Labels of the previous version (service, metric, cluster), dense from 0; metrics it lacks share one more label."""
    dense = previous.withColumn("start", F.dense_rank().over(Window.partitionBy("service").orderBy("cluster")) - 1)
    joined = series.join(dense.select("service", "metric", "start"), ["service", "metric"], "left")
    top = F.max("start").over(Window.partitionBy("service"))
    labels = joined.withColumn("start", F.coalesce("start", top + 1, F.lit(0)).cast("int"))
    k = F.max("start").over(Window.partitionBy("service")) + 1
    return labels.withColumn("k", k.cast("int"))


def shapes(labelled: DataFrame, rounds: int = 100) -> DataFrame:
    """(service, k, metric, cluster, centroid) of each (service, k): one task per pair holds the service's series only.

    Series of a service have one length; shorter ones are padded with zeros. Services with
    no more than k series are left out, as there is nothing to reduce.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("metric")
        k, n = int(pdf["k"].iloc[0]), max(map(len, pdf["v"]))
        x = kernels.zscore(np.array([np.pad(np.asarray(v, float), (0, n - len(v))) for v in pdf["v"]]))
        if len(x) <= k:
            return pd.DataFrame(columns=["service", "k", "metric", "cluster", "centroid"])
        labels, centres = kernels.kshape(x, k, pdf["start"].to_numpy(), rounds)
        lists = [c.tolist() for c in centres]
        return pd.DataFrame({"service": pdf["service"].to_numpy(), "k": k, "metric": pdf["metric"].to_numpy(), "cluster": labels, "centroid": [lists[j] for j in labels]})

    rows = labelled.select("service", "k", "metric", "v", "start").repartition(distance.tasks(labelled), "service", "k")
    return rows.groupBy("service", "k").applyInPandas(run, "service string, k int, metric string, cluster int, centroid array<double>")


def kshape(labelled: DataFrame, rounds: int = 100) -> DataFrame:
    """shapes() with the silhouette of each (service, k); distances between series are taken once for all k of a service, block by block."""
    found = materialize(shapes(labelled, rounds), "shapes")
    series = labelled.select("service", "metric", "v").dropDuplicates(["service", "metric"])
    labels = found.select("service", F.col("k").alias("set"), F.col("metric").alias("key"), "cluster")
    scores = distance.series_silhouette(series, labels, ["service"], ("set",), prepare=True).select("service", F.col("set").alias("k"), "silhouette")
    return found.join(scores, ["service", "k"]).select("service", "k", "metric", "cluster", "silhouette", "centroid")


def hand_over(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Representatives kept from the previous version where that is possible.

    current: (service, cluster, representative, members); previous the same. A cluster
    keeps the representative of the first previous cluster (by id) that either has the
    same representative, or whose representative is among its members and whose members
    include the current one.
    """
    c, p = current.alias("c"), previous.select("service", F.col("cluster").alias("old"), F.col("representative").alias("was"), F.col("members").alias("had")).alias("p")
    both = c.join(p, "service", "left")
    fits = (F.col("was") == F.col("representative")) | (F.array_contains("members", F.col("was")) & F.array_contains("had", F.col("representative")))
    first = F.min(F.when(fits, F.struct("old", "was")))
    return both.groupBy("service", "cluster", "representative").agg(first.alias("f")).select("service", "cluster", F.coalesce("f.was", "representative").alias("representative"), F.col("f.was").isNotNull().alias("kept"))


def name_clusters(pairs: DataFrame, names: DataFrame, distance: float) -> DataFrame:
    """Single-linkage clusters of names, cut at a distance: components over pairs (a, b, d) with d <= distance."""
    roots = components(pairs.where(F.col("d") <= distance).select("a", "b"))
    return names.join(roots.withColumnsRenamed({"node": "name", "root": "label"}), "name", "left").select("name", F.coalesce("label", "name").alias("label"))


def name_clusters_to(pairs: DataFrame, names: DataFrame, size: int) -> DataFrame:
    """Single-linkage clusters of names, cut at the least distance that leaves `size` clusters at most.

    Distances are halved by their exact median until one is left, so cuts grow with the
    logarithm of their number. If no distance gives so few, the largest one cuts.
    """
    total, levels = names.count(), pairs.select("d").where(F.col("d").isNotNull()).distinct()
    low, high = float("-inf"), levels.agg(F.max("d")).first()[0]
    if total <= size or high is None:
        return names.select("name", F.col("name").alias("label"))
    while (cut := levels.where((F.col("d") > low) & (F.col("d") < high)).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY d)")).first()[0]) is not None:
        if name_clusters(pairs, names, cut).select("label").distinct().count() <= size:
            high = cut
        else:
            low = cut
    return name_clusters(pairs, names, high)


def gap_statistic(series: DataFrame, ks: list[int], references: int = 20, seed: int = 7) -> DataFrame:
    """Per service and k: log of the mean dispersion of uniform reference sets, less the log of the data's own.

    A reference set needs only the least and largest value at each place, so each is a task of
    its own; it begins where the sets before it leave the service's sequence of random numbers.
    """

    def spread(rows: np.ndarray, k: int) -> float:
        return float(kernels.kshape_fit(rows, k, np.arange(len(rows)) % k, 20)[2].sum())

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, k = pdf.sort_values("metric"), int(pdf["k"].iloc[0])
        x = kernels.zscore(np.array([np.asarray(v, float) for v in pdf["v"]]))
        if len(x) <= k:
            return pd.DataFrame(columns=["service", "k", "own", "n", "low", "high"])
        return pd.DataFrame({"service": pdf["service"].iloc[:1].to_numpy(), "k": k, "own": spread(x, k), "n": len(x), "low": [x.min(0)], "high": [x.max(0)]})

    def reference(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for service, k, mine, n, low, high, r in pdf.itertuples(index=False):
                shape = (n, len(low))
                before = sum(n > other for other in ks[: ks.index(k)]) * references + r
                random = np.random.Generator(np.random.PCG64(seed).advance(before * n * len(low)))
                out.append((service, k, mine, spread(kernels.zscore(random.uniform(low, high, shape)), k)))
            yield pd.DataFrame(out, columns=["service", "k", "own", "spread"])

    tasks = distance.tasks(series)
    many = series.select("service", "metric", "v", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).repartition(tasks, "service", "k")
    data = many.groupBy("service", "k").applyInPandas(own, "service string, k int, own double, n long, low array<double>, high array<double>")
    sets = data.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(references - 1)))).repartition(tasks)
    found = sets.mapInPandas(reference, "service string, k int, own double, spread double")
    mean = F.log(F.avg("spread")) - F.log(F.greatest(F.max("own"), F.lit(1e-12)))
    return found.groupBy("service", "k").agg(mean.alias("gap"))

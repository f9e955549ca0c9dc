"""Differences between two versions of a system: metrics, clusters, edges; ranked causes.

Cluster tables have (version, service, cluster, representative, metrics array); version
is `f` (faulty) or `nf` (non-faulty). Edge tables have (version, p_service, p_metric,
c_service, c_metric, lags array), metrics being representatives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalloom.functions.runtime import materialize

THRESHOLDS = [0.01, 0.5, 0.6, 0.7]


def jaccard(a: Column, b: Column) -> Column:
    """#(A and B) / #(A or B); null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """#(A and B) / #B, the other side's share; null if B is empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_distinct(b)))


def metric_diff(clusters: DataFrame) -> DataFrame:
    """(service, metric, change): new, discarded or unchanged, for services of the faulty version.

    A service only there has new metrics only; one only in the other version is left out.
    One aggregation by metric takes both versions at once.
    """
    each = clusters.select("version", "service", F.explode("metrics").alias("metric"))
    both = each.groupBy("service", "metric").agg(F.max(F.col("version") == "f").alias("f"), F.max(F.col("version") == "nf").alias("nf"))
    here = F.max("f").over(Window.partitionBy("service"))
    change = F.when(F.col("f") & F.col("nf"), "unchanged").when(F.col("f"), "new").otherwise("discarded")
    return both.withColumn("here", here).where("here").select("service", "metric", change.alias("change"))


def metric_diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("service").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("new", "discarded", "unchanged")])


def cluster_match(clusters: DataFrame, left: str = "f", right: str = "nf") -> DataFrame:
    """For each cluster of one version: the best cluster of the other by containment.

    (service, cluster, representative, metrics, best, best_representative, score); a best
    of null and score 0 if none shares a metric. Ties: least cluster id. Pairs come from
    an equi-join on (service, metric), so clusters without a common metric never meet.
    """
    a = clusters.where(F.col("version") == left).select("service", "cluster", "representative", F.array_distinct("metrics").alias("metrics"))
    b = clusters.where(F.col("version") == right).select("service", F.col("cluster").alias("best"), F.col("representative").alias("best_representative"), F.size(F.array_distinct("metrics")).alias("size"), F.array_distinct("metrics").alias("__m"))
    mine = a.select("service", "cluster", F.explode("metrics").alias("metric"))
    theirs = b.select("service", "best", "best_representative", "size", F.explode("__m").alias("metric"))
    shared = mine.join(theirs, ["service", "metric"]).groupBy("service", "cluster", "best", "best_representative", "size").agg(F.count("*").alias("common"))
    scored = shared.withColumn("score", F.col("common") / F.col("size"))
    rank = F.row_number().over(Window.partitionBy("service", "cluster").orderBy(F.desc("score"), "best"))
    top = scored.withColumn("rn", rank).where(F.col("rn") == 1).select("service", "cluster", "best", "best_representative", "score")
    return a.join(top, ["service", "cluster"], "left").select("service", "cluster", "representative", "metrics", "best", "best_representative", F.coalesce("score", F.lit(0.0)).alias("score"))


def cluster_discarded(clusters: DataFrame) -> DataFrame:
    """(service, cluster, discarded): metrics lost from non-faulty clusters, at the faulty cluster that matches best."""
    lost = metric_diff(clusters).where(F.col("change") == "discarded").select("service", "metric")
    back = cluster_match(clusters, "nf", "f").where(F.col("best").isNotNull())
    each = back.select("service", F.col("best").alias("cluster"), F.explode("metrics").alias("metric"))
    return each.join(lost, ["service", "metric"]).groupBy("service", "cluster").agg(F.array_sort(F.collect_set("metric")).alias("discarded"))


def cluster_novelty(clusters: DataFrame) -> DataFrame:
    """(service, cluster, representative, new, unchanged, discarded, novelty) of faulty clusters; novelty = #new + #discarded."""
    diff = metric_diff(clusters)
    each = clusters.where(F.col("version") == "f").select("service", "cluster", "representative", F.explode(F.array_distinct("metrics")).alias("metric"))
    sums = each.join(diff, ["service", "metric"]).groupBy("service", "cluster", "representative").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("new", "unchanged")])
    lost = cluster_discarded(clusters).select("service", "cluster", F.size("discarded").cast("long").alias("discarded"))
    all_ = sums.join(lost, ["service", "cluster"], "left").withColumn("discarded", F.coalesce("discarded", F.lit(0)).cast("long"))
    return all_.select("service", "cluster", "representative", "new", "unchanged", "discarded", (F.col("new") + F.col("discarded")).alias("novelty"))


def novelty_histogram(novelty: DataFrame) -> DataFrame:
    """(category, clusters): New, Discarded, New and discarded, Unchanged, and sums Changed and Total."""
    kind = F.when((F.col("new") > 0) & (F.col("discarded") > 0), "New and discarded").when(F.col("new") > 0, "New").when(F.col("discarded") > 0, "Discarded").otherwise("Unchanged")
    also = F.explode(F.filter(F.array(kind, F.when(F.col("novelty") > 0, "Changed"), F.lit("Total")), lambda x: x.isNotNull()))
    return novelty.select(also.alias("category")).groupBy("category").agg(F.count("*").alias("clusters"))


def edge_diff(edges: DataFrame, clusters: DataFrame, thresholds: list[float] = THRESHOLDS, least_novelty: int = 1) -> DataFrame:
    """(basis, threshold, p_service, p_metric, c_service, c_metric, change) of edges.

    An edge of the faulty version counts on basis `novelty` if both ends are novel and the
    perpetrator's cluster matches at the threshold, on `similarity` if the other's does
    too. Both ends are mapped to their best clusters: no such edge there is `new`, other
    lags are `lag-change`, else `unchanged`. An edge of the non-faulty version whose ends
    match novel clusters at the threshold, without an edge there, is `discarded`.
    """
    match = cluster_match(clusters).select("service", F.col("representative").alias("metric"), F.col("best_representative").alias("to"), "score")
    novel = materialize(cluster_novelty(clusters).select("service", F.col("representative").alias("metric"), "novelty"), "novelty")  # one row a cluster, read twice
    ends = materialize(match.join(novel, ["service", "metric"]), "edge-ends")
    f = edges.where(F.col("version") == "f").select("p_service", "p_metric", "c_service", "c_metric", F.array_sort("lags").alias("lags"))
    nf = edges.where(F.col("version") == "nf").select("p_service", "p_metric", "c_service", "c_metric", F.array_sort("lags").alias("lags"))

    def side(p: str, frame: DataFrame) -> DataFrame:
        return frame.select(*[F.col(c).alias(f"{p}_{c}") for c in frame.columns])

    met = f.join(side("p", ends), ["p_service", "p_metric"]).join(side("c", ends), ["c_service", "c_metric"])
    met = met.where((F.col("p_novelty") >= least_novelty) & (F.col("c_novelty") >= least_novelty))
    there = nf.select("p_service", F.col("p_metric").alias("p_to"), "c_service", F.col("c_metric").alias("c_to"), F.col("lags").alias("old_lags"))
    found = met.join(there, ["p_service", "p_to", "c_service", "c_to"], "left")
    change = F.when(F.col("old_lags").isNull(), "new").when(F.col("old_lags") != F.col("lags"), "lag-change").otherwise("unchanged")
    theta = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    judged = found.select("p_service", "p_metric", "c_service", "c_metric", "p_score", "c_score", "p_to", "c_to", change.alias("change"), theta).where(F.col("p_score") >= F.col("threshold"))
    both = (F.col("c_score") >= F.col("threshold")) & F.col("p_to").isNotNull() & F.col("c_to").isNotNull()
    bases = F.explode(F.filter(F.array(F.lit("novelty"), F.when(both, "similarity")), lambda x: x.isNotNull())).alias("basis")
    changed = judged.select(bases, "threshold", "p_service", "p_metric", "c_service", "c_metric", "change")
    back = cluster_match(clusters, "nf", "f").where(F.col("best").isNotNull()).select("service", F.col("representative").alias("metric"), F.col("best_representative").alias("to"), "score")
    back = materialize(back.join(novel.select("service", F.col("metric").alias("to"), "novelty"), ["service", "to"]), "edge-ends")
    gone = nf.join(side("p", back), ["p_service", "p_metric"]).join(side("c", back), ["c_service", "c_metric"])
    gone = gone.where((F.col("p_novelty") >= least_novelty) & (F.col("c_novelty") >= least_novelty))
    now = f.select("p_service", F.col("p_metric").alias("p_to"), "c_service", F.col("c_metric").alias("c_to"))
    gone = gone.join(now, ["p_service", "p_to", "c_service", "c_to"], "left_anti")
    gone = gone.select("p_service", "p_metric", "c_service", "c_metric", "p_score", "c_score", theta).where((F.col("p_score") >= F.col("threshold")) & (F.col("c_score") >= F.col("threshold")))
    return changed.unionByName(gone.select(F.lit("similarity").alias("basis"), "threshold", "p_service", "p_metric", "c_service", "c_metric", F.lit("discarded").alias("change")))


def edge_diff_counts(diff: DataFrame) -> DataFrame:
    kinds = ("new", "discarded", "lag-change", "unchanged")
    return diff.groupBy("basis", "threshold").agg(*[F.count_if(F.col("change") == c).alias(c.replace("-", "_")) for c in kinds])


def reduction_stats(diff: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per threshold: services, clusters and metrics that changed edges (not `unchanged`) still touch."""
    ends = diff.where((F.col("basis") == "similarity") & (F.col("change") != "unchanged"))
    version = F.when(F.col("change") == "discarded", "nf").otherwise("f").alias("version")
    touched = ends.select("threshold", version, F.explode(F.array(F.struct(F.col("p_service").alias("s"), F.col("p_metric").alias("m")), F.struct(F.col("c_service").alias("s"), F.col("c_metric").alias("m")))).alias("e")).select("threshold", "version", F.col("e.s").alias("service"), F.col("e.m").alias("representative")).distinct()
    sized = touched.join(clusters.select("version", "service", "representative", F.size("metrics").alias("n")), ["version", "service", "representative"])
    return sized.groupBy("threshold").agg(F.count_distinct("service").alias("services"), F.count("*").alias("clusters"), F.sum("n").cast("long").alias("metrics"))


def rank_services(diff: DataFrame, top: int | None = None) -> DataFrame:
    """Services by new + discarded metrics, most first, then by name, with their place."""
    counts = metric_diff_counts(diff)
    score = F.col("new") + F.col("discarded")
    ranked = counts.select("service", "new", "discarded", "unchanged", score.alias("score")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "service")))  # one row a service
    return ranked.where(F.col("place") <= top) if top else ranked

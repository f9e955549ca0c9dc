"""The whole analysis: samples of two versions and a call graph in, ranked causes out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalloom.functions.runtime import materialize, visible
from causalloom.operators import causality, clustering, distance, graphs, series, versions


@dataclass
class Version:
    """What the analysis of one version leaves: written tables, so later steps read them and nothing is computed twice."""

    series: DataFrame
    clusters: DataFrame
    scores: DataFrame
    representatives: DataFrame
    causality: DataFrame
    edges: DataFrame


def analyse(samples: DataFrame, calls: DataFrame, step: str = "500 milliseconds", ks: tuple[int, ...] = (2, 3, 4, 5, 6), significance: float = 0.001, previous: Version | None = None) -> Version:
    """Samples (service, metric, ts, value) and calls (svc_x, svc_y) of one version to a dependency graph.

    Resample, fill, drop what carries no information, cluster each service's series for
    every k, keep one representative per cluster of the best k, and test representatives
    of services that call each other. previous: clusters start from that version's.
    """
    visible(samples.sparkSession)
    regular = series.interpolate(series.on_grid(series.resample_mean(samples, step), step))
    vectors = materialize(series.vectors(series.prepared(regular)), "series")
    if previous is None:
        labelled = clustering.start_labels(vectors, list(ks))
    else:
        old = previous.clusters.join(distance.preferred_k(previous.scores, ["service"]).select("service", F.col("preferred_k").alias("k")), ["service", "k"])
        labelled = clustering.warm_start(vectors.select("service", "metric", "v"), old.select("service", "metric", "cluster"))
    clusters = materialize(clustering.kshape(labelled), "clusters")
    scores = clusters.groupBy("service", "k").agg(F.max("silhouette").alias("silhouette"))
    best = distance.preferred_k(scores, ["service"])
    members = clusters.join(vectors.select("service", "metric", "v"), ["service", "metric"])
    reps = distance.with_sbd_long(members.select("service", "k", "cluster", "metric", "centroid", "v"), "centroid", "v")
    reps = reps.groupBy("service", "k", "cluster").agg(F.min(F.struct("sbd", "metric")).alias("b")).select("service", "k", "cluster", F.col("b.metric").alias("representative"))
    reps = materialize(reps, "representatives")
    kept = distance.reduced(vectors, reps, best)
    tested = materialize(causality.granger(causality.series_pairs(kept, calls)), "causality")
    table = causality.pivoted(tested)
    return Version(vectors, clusters, scores, reps, tested, materialize(graphs.edges(graphs.classify_edges(table, significance)), "edges"))


def cluster_table(v: Version, name: str) -> DataFrame:
    """The clusters of the preferred k as (version, service, cluster, representative, metrics)."""
    best = distance.preferred_k(v.scores, ["service"]).select("service", F.col("preferred_k").alias("k"))
    rows = v.clusters.join(best, ["service", "k"]).groupBy("service", "k", "cluster").agg(F.array_sort(F.collect_set("metric")).alias("metrics"))
    return rows.join(v.representatives, ["service", "k", "cluster"]).select(F.lit(name).alias("version"), "service", "cluster", "representative", "metrics")


def edge_table(v: Version, name: str) -> DataFrame:
    return graphs.split_names(v.edges).select(F.lit(name).alias("version"), "p_service", "p_metric", "c_service", "c_metric", "lags")


@dataclass
class Report:
    services: DataFrame
    metrics: DataFrame
    matches: DataFrame
    novelty: DataFrame
    histogram: DataFrame
    edges: DataFrame
    edge_counts: DataFrame
    reduction: DataFrame
    silhouettes: DataFrame


def compare(faulty: Version, sound: Version) -> Report:
    """Differences between two versions, services with most changed metrics first."""
    clusters = materialize(cluster_table(faulty, "f").unionByName(cluster_table(sound, "nf")), "version-clusters")
    edges = materialize(edge_table(faulty, "f").unionByName(edge_table(sound, "nf")), "version-edges")
    diff = versions.metric_diff(clusters)
    novelty = versions.cluster_novelty(clusters)
    changes = materialize(versions.edge_diff(edges, clusters), "edge-changes")
    f, nf = (distance.preferred_k(v.scores, ["service"]).select("service", F.col("silhouette").alias(n)) for v, n in ((faulty, "f"), (sound, "nf")))
    silhouettes = f.join(nf, "service", "left").select("service", "f", F.coalesce("nf", F.lit(-1.0)).alias("nf"))
    return Report(
        versions.rank_services(diff), diff, versions.cluster_match(clusters), novelty, versions.novelty_histogram(novelty),
        changes, versions.edge_diff_counts(changes), versions.reduction_stats(changes, clusters), silhouettes,
    )

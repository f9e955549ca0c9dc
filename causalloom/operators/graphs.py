"""Call graphs, dependency edges from p values, their statistics, and weighted PageRank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from causalloom.functions.runtime import materialize

LAGS = (1, 2, 3, 4, 5)
# Prefixes of services that talk over the message queue, and its name.
QUEUE_USERS, QUEUE = ["nova", "neutron", "glance", "swift", "cinder"], "rabbitmq"


def call_edges(records: DataFrame, ports: DataFrame) -> DataFrame:
    """Distinct (src, dst) from capture records (container, direction, port) and (service, port).

    TX goes from the container to the port's service, RX the other way; other ports drop out.
    """
    joined = records.join(ports, "port")
    sent = F.col("direction") == "TX"
    return joined.select(F.when(sent, F.col("container")).otherwise(F.col("service")).alias("src"), F.when(sent, F.col("service")).otherwise(F.col("container")).alias("dst")).distinct()


def call_pairs(edges: DataFrame, services: DataFrame | None = None, queue_users: list[str] | None = None, queue: str | None = None) -> DataFrame:
    """Unordered pairs svc_x < svc_y of different known services, and queue users with the queue."""
    pairs = edges.where(F.col("src") != F.col("dst"))
    if services is not None:
        known = services.select(F.col("service"))
        pairs = pairs.join(known.toDF("src"), "src", "left_semi").join(known.toDF("dst"), "dst", "left_semi")
    out = pairs.select(F.least("src", "dst").alias("svc_x"), F.greatest("src", "dst").alias("svc_y"))
    if queue and services is not None:
        prefix = F.substring_index("service", "_", 1)
        mine = services.where(prefix.isin(*(queue_users or QUEUE_USERS)) & (F.col("service") != queue))
        out = out.unionByName(mine.select(F.least("service", F.lit(queue)).alias("svc_x"), F.greatest("service", F.lit(queue)).alias("svc_y")))
    return out.distinct()


def distinct_pairs(causality: DataFrame, order: str | None = None) -> DataFrame:
    """One row per (perpetrator, consequence): the first by `order`."""
    w = Window.partitionBy("perpetrator", "consequence").orderBy(order or "perpetrator")
    return causality.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def split_names(causality: DataFrame) -> DataFrame:
    """perpetrator and consequence as service and metric columns."""
    def parts(c: str, p: str) -> dict:
        return {f"{p}_service": F.substring_index(c, "|", 1), f"{p}_metric": F.regexp_replace(c, r"^[^|]*\|", "")}

    return causality.withColumns(parts("perpetrator", "p") | parts("consequence", "c"))


def filter_edges(rows: DataFrame, excluded_services: list[str] = (), excluded_metrics: list[str] = (), clustered: DataFrame | None = None, compat: bool = False, included: list[str] | None = None) -> DataFrame:
    """Without excluded services and metrics (their -diff ending aside), and only clustered services if given.

    included: an edge stays if the part before _ of either end's service stands in any of these names.
    """
    from causalloom.functions.names import strip_diff

    if excluded_services:
        rows = rows.where(~F.col("p_service").isin(*excluded_services) & ~F.col("c_service").isin(*excluded_services))
    if excluded_metrics:
        rows = rows.where(~strip_diff(F.col("p_metric"), compat).isin(*excluded_metrics) & ~strip_diff(F.col("c_metric"), compat).isin(*excluded_metrics))
    if included is not None:
        listed = F.array(*map(F.lit, included)).cast("array<string>")

        def listed_in(service: str) -> Column:
            return F.exists(listed, lambda name: F.contains(name, F.substring_index(service, "_", 1)))

        rows = rows.where(listed_in("p_service") | listed_in("c_service"))
    if clustered is not None:
        ok = clustered.where(F.col("preferred_k") != 0).select("service")
        rows = rows.join(ok.toDF("p_service"), "p_service", "left_semi").join(ok.toDF("c_service"), "c_service", "left_semi")
    return rows


def classify_edges(causality: DataFrame, significance: float = 0.001, lags: tuple[int, ...] = LAGS) -> DataFrame:
    """(a, b, lag, direction) for unordered pairs a < b: forward (a -> b), back or bidir, where p < significance.

    The two directions meet by their names, so a missing direction misaligns nothing. Each
    row is keyed by its unordered pair and one aggregation takes both sides: no self-join.
    """
    forward = F.col("perpetrator") < F.col("consequence")
    keyed = causality.where(F.col("perpetrator") != F.col("consequence")).select(
        F.least("perpetrator", "consequence").alias("a"), F.greatest("perpetrator", "consequence").alias("b"), forward.alias("forward"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("lag"), F.col(f"p_for_lag_{i}").alias("p")) for i in lags])).alias("x"),
    )
    sides = keyed.groupBy("a", "b", F.col("x.lag").alias("lag")).agg(
        F.coalesce(F.min(F.when(F.col("forward"), F.col("x.p"))) < significance, F.lit(False)).alias("f"),
        F.coalesce(F.min(F.when(~F.col("forward"), F.col("x.p"))) < significance, F.lit(False)).alias("r"),
    )
    direction = F.when(F.col("f") & F.col("r"), "bidir").when(F.col("f"), "forward").otherwise("back")
    return sides.where(F.col("f") | F.col("r")).select("a", "b", "lag", direction.alias("direction"))


def edges(classified: DataFrame) -> DataFrame:
    """One row per directed edge: its lags without bidirectional ones, and multiplicity.

    multiplicity counts the pair's significant lags, of any class, from the edge's first on.
    """
    every = F.collect_list("lag").over(Window.partitionBy("a", "b"))
    rows = classified.withColumn("all", every).where(F.col("direction") != "bidir")
    grouped = rows.groupBy("a", "b", "direction", "all").agg(F.sort_array(F.collect_list("lag")).alias("lags"))
    out = F.col("direction") == "forward"
    return grouped.select(
        F.when(out, F.col("a")).otherwise(F.col("b")).alias("perpetrator"), F.when(out, F.col("b")).otherwise(F.col("a")).alias("consequence"), "lags",
        F.size(F.filter("all", lambda x: x >= F.element_at("lags", 1))).alias("multiplicity"),
    )


def graph_stats(classified: DataFrame) -> DataFrame:
    """Significant lags by class, and distinct services that any of them touches."""
    ends = F.explode(F.array(F.struct(F.lit(True).alias("one"), F.substring_index("a", "|", 1).alias("service")), F.struct(F.lit(False).alias("one"), F.substring_index("b", "|", 1).alias("service"))))
    rows = classified.select("direction", ends.alias("end"))
    one = F.col("end.one")
    n = [F.count_if(one & (F.col("direction") == d)).alias(d) for d in ("forward", "back", "bidir")]
    return rows.agg(F.count_if(one).alias("edges"), *n, F.count_distinct("end.service").alias("services"))


def service_rollup(edges_: DataFrame) -> DataFrame:
    """Edges and lags per ordered pair of services; egress by p_service, ingress by c_service."""
    rows = edges_.select(F.substring_index("perpetrator", "|", 1).alias("p_service"), F.substring_index("consequence", "|", 1).alias("c_service"), F.size("lags").alias("n"), "multiplicity")
    return rows.groupBy("p_service", "c_service").agg(F.count("*").alias("edges"), F.sum("n").alias("lags"), F.sum("multiplicity").alias("physical_edges"))


def pvalue_histogram(causality: DataFrame, lags: tuple[int, ...] = (1, 2, 3, 4), bins: int = 20) -> DataFrame:
    """Per lag: counts by bin of the smaller p of a pair's two directions, and densities."""
    keyed = causality.select(F.least("perpetrator", "consequence").alias("a"), F.greatest("perpetrator", "consequence").alias("b"), *[f"p_for_lag_{i}" for i in lags])
    low = keyed.groupBy("a", "b").agg(*[F.min(f"p_for_lag_{i}").alias(f"p{i}") for i in lags])
    long = low.select(F.explode(F.array(*[F.struct(F.lit(i).alias("lag"), F.col(f"p{i}").alias("p")) for i in lags])).alias("x")).where(F.col("x.p").isNotNull())
    bin_ = F.least(F.floor(F.col("x.p") * bins), F.lit(bins - 1)).cast("int").alias("bin")
    counted = long.groupBy(F.col("x.lag").alias("lag"), bin_).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("lag"))
    return counted.select("lag", "bin", "n", (F.col("n") * bins / total).alias("density"))


def distinct_arcs(arcs: DataFrame, order: str = "line") -> DataFrame:
    """Arcs (src, dst, w): of equal (src, dst) the first by `order`, of several there the least weight; without that column the least weight."""
    key = order if order in arcs.columns else "w"
    return arcs.groupBy("src", "dst").agg(F.min_by("w", F.struct(key, F.col("w").alias("then"))).alias("w"))


def first_seen(arcs: DataFrame) -> DataFrame:
    """(node, seen) of arcs (line, src, dst): seen grows in the order in which lines name nodes, sources before targets.

    It orders nodes without a window over all of them; it is not dense.
    """
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), (F.col("line") * 2).alias("seen")), F.struct(F.col("dst").alias("node"), (F.col("line") * 2 + 1).alias("seen"))))
    return arcs.select(ends.alias("e")).groupBy("e.node").agg(F.min("e.seen").alias("seen"))


def numeric_nodes(arcs: DataFrame) -> DataFrame:
    """All ids from 0 to the largest one: numbers that no arc names are nodes too."""
    top = arcs.agg(F.max(F.greatest(F.col("src").cast("long"), F.col("dst").cast("long"))).alias("m"))
    return top.select(F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("node")).select(F.col("node").cast("string"))


def pagerank(arcs: DataFrame, nodes: DataFrame | None = None, alpha: float = 0.85, tolerance: float = 1e-5, most: int = 10000, start: str | None = None, iterations: int | None = None) -> DataFrame:
    """(node, rank, iterations): weighted PageRank; weights are used as given and stand for 1 / out-degree.

    r_i = alpha (sum over arcs w r_from + dangling / n) + (1 - alpha) / n, from all rank on
    the `start` node (the least name by default); ranks are normalised between rounds;
    it stops when the absolute changes sum to tolerance at most. Nodes without an outgoing
    arc are dangling. iterations fixes the number of rounds instead.

    Arcs are dealt by source once and kept; a round joins ranks to them, sums by target in
    a partial aggregation, and takes sums over all nodes as one row. Each round's ranks are
    written to the shared folder, so a lost executor costs a round at most.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be over 0 and at most 1")
    arcs = distinct_arcs(arcs) if "line" in arcs.columns else arcs.select("src", "dst", "w")
    ends = arcs.select(F.col("src").alias("node")).union(arcs.select("dst")).distinct() if nodes is None else nodes.select("node")
    out = arcs.select(F.col("src").alias("node")).distinct().withColumn("has_out", F.lit(True))
    first = F.lit(start) if start is not None else F.lit(ends.agg(F.min("node")).first()[0])
    state = ends.join(out, "node", "left").select("node", F.coalesce("has_out", F.lit(False)).alias("has_out"), F.when(F.col("node") == first, 1.0).otherwise(0.0).alias("rank"))
    def written(df: DataFrame) -> tuple[DataFrame, dict]:
        """df as a table, and its sums, taken while it was written: a round is one job."""
        seen, dead = Observation(), F.when(~F.col("has_out"), F.col("rank"))
        sums = [F.count("*").alias("n"), F.sum("rank").alias("total"), F.sum(dead).alias("dead"), F.sum(F.abs(F.col("rank") - F.col("prev"))).alias("change")]
        return materialize(df.observe(seen, *sums), "ranks"), seen.get

    arcs = materialize(arcs, "arcs")
    state, sums = written(state.withColumn("prev", F.lit(None).cast("double")))
    n, done = sums["n"], 0
    if not n:
        return state.select("node", "rank", F.lit(0).alias("iterations"))
    while done < (iterations if iterations is not None else most):
        scale = 1.0 if done == 0 else sums["total"]
        prev = state.select("node", "has_out", (F.col("rank") / F.lit(scale)).alias("prev"))
        got = arcs.join(prev.select(F.col("node").alias("src"), "prev"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("w") * F.col("prev")).alias("g"))
        rank = alpha * F.coalesce("g", F.lit(0.0)) + F.lit(alpha * (sums["dead"] or 0.0) / n + (1 - alpha) / n)
        state, sums = written(prev.join(got, "node", "left").select("node", "has_out", rank.alias("rank"), "prev"))
        done += 1
        if iterations is None and sums["change"] <= tolerance:
            break
    return state.select("node", "rank", F.lit(done).alias("iterations"))

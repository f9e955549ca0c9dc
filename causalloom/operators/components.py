"""Connected components by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from causalloom.functions.runtime import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) of one type; root is the component's least node.

    In a round every node takes the least label among its neighbours' and its own, then the
    label of that label. Least labels come from a partial aggregation, so a node with very
    many edges costs one row a task, and its edges are in a join that the engine may split.
    A round is one job: it writes the labels, so a lost executor costs a round at most, and
    counts the changes while it writes. Jumping makes the rounds grow with the logarithm
    of a component's diameter.
    """
    proper = edges.where(F.col("a") != F.col("b"))
    both = materialize(proper.select("a", "b").union(proper.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("root")), "labels")
    changed = 1
    while changed:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        least = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("to"))
        above = labels.select(F.col("node").alias("to"), F.col("root").alias("above"))
        moved = least.join(above, "to").select("node", F.col("above").alias("new"), (F.col("above") != F.col("root")).alias("moved"))
        seen, last = Observation(), labels
        labels = materialize(moved.observe(seen, F.count_if("moved").alias("n")).select("node", F.col("new").alias("root")), "labels")
        changed = seen.get["n"]
        discard(last)
    discard(both)
    return labels

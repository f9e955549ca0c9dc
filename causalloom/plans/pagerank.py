"""python -m causalloom.plans.pagerank FILE [-d DELIM] [-a ALPHA] [-c TOLERANCE] [-m ROUNDS] [-n]: ranks of a weighted graph."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from causalloom.operators import graphs
from causalloom.sources.readers import parse_arcs


def main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="pagerank")
    p.add_argument("file")
    p.add_argument("-d", default=" => ", help="what stands between source, weight and target")
    p.add_argument("-a", type=float, default=0.85, help="damping")
    p.add_argument("-c", type=float, default=1e-5, help="stop when changes sum to this")
    p.add_argument("-m", type=int, default=10000, help="rounds at most")
    p.add_argument("-n", action="store_true", help="names are numbers; those that no arc names are nodes too")
    a = p.parse_args(argv)
    if not 0 < a.a <= 1:
        p.error("the damping must be over 0 and at most 1")
    spark = SparkSession.builder.getOrCreate()
    arcs = parse_arcs(spark.read.text(a.file), a.d)
    ranks = graphs.pagerank(arcs, graphs.numeric_nodes(arcs) if a.n else None, a.a, a.c, a.m)
    for r in ranks.orderBy(F.col("node").cast("long") if a.n else F.col("node")).toLocalIterator():
        print(f"{r.node} = {r.rank:.17g}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""Causal metric analytics on Spark: series, clusters, causality, graphs and version diffs."""

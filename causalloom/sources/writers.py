"""Writers of series, metadata, graphs and points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLOURS = {"new": ("green", "solid"), "discarded": ("red", "dashed"), "lag-change": ("blue", "dotted")}


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Gzip files of tab-separated values with a header; the committer publishes whole files only."""
    df.write.mode(mode).options(sep="\t", header=True, compression="gzip", timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)


def write_merged(sources: list[DataFrame], fields: list[str], tags: list[str], path: str) -> None:
    """Rows of several tables in time order under one header: fields, tags, time; other columns are left out."""
    from causalloom.operators.series import union_sources

    merged = union_sources(*sources)
    cols = [c for c in [*sorted(fields), *sorted(tags), "time"]]
    rows = merged.select(*[F.col(c) if c in merged.columns else F.lit(None).cast("string").alias(c) for c in cols])
    write_tsv(rows.orderBy("time"), path)


def write_metadata(services: DataFrame, path: str) -> None:
    """One document per measurement with its services; keys in order, replaced as a whole."""
    own = ["measurement_name", "start", "end"]
    rest = sorted(c for c in services.columns if c not in own)
    doc = services.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("name", *[c for c in rest if c != "name"]))).alias("services"))
    doc.select(*sorted([*own, "services"])).write.mode("overwrite").json(path)


def dot_lines(edges: DataFrame) -> DataFrame:
    """`"a" -> "b"` for each (src, dst)."""
    return edges.select(F.format_string('"%s" -> "%s"', "src", "dst").alias("value"))


def edge_diff_dot(diff: DataFrame) -> DataFrame:
    """One line per pair of services and kind of change; unchanged edges are left out."""
    lines = None
    for kind, (colour, style) in COLOURS.items():
        mine = diff.where(F.col("change") == kind).select("p_service", "c_service").distinct()
        line = mine.select("p_service", "c_service", F.format_string(f'"%s" -> "%s" [color={colour},style={style}];', "p_service", "c_service").alias("value"))
        lines = line if lines is None else lines.unionByName(line)
    return lines


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def point_line(measurement: Column, metrics: Column, most: int = 49) -> Column:
    """`measurement k="v",k="v"` from a map, keys in order; null if it has over `most` entries."""
    pairs = F.transform(F.array_sort(F.map_entries(metrics)), lambda e: F.format_string('%s="%s"', e["key"], e["value"]))
    return F.when(F.size(pairs) <= most, F.concat(measurement, F.lit(" "), F.array_join(pairs, ",")))


def status_line(ok: Column, message: Column) -> Column:
    return F.concat(F.lit("status "), F.when(ok, "okay").otherwise("error"), F.when(F.length(message) > 0, F.concat(F.lit(" "), message)).otherwise(""))


def metric_line(name: Column, kind: Column, value: Column, unit: Column | None = None) -> Column:
    out = F.format_string("metric %s %s %s", name, kind, value)
    return out if unit is None else F.concat_ws(" ", out, unit)


def latex_rows(df: DataFrame) -> DataFrame:
    """Rows as `a & b \\\\` lines."""
    return df.select(F.concat(F.concat_ws(" & ", *[F.col(c).cast("string") for c in df.columns]), F.lit(" \\\\")).alias("value"))


def markdown_report(inventory: DataFrame, scores: DataFrame) -> DataFrame:
    """Lines of an overview: a table row per service with its metric counts and best clustering."""
    best = scores.groupBy("service").agg(F.max(F.struct("silhouette", "k")).alias("b"))
    row = F.format_string("| %s | %s | %s | %s | %s |", "service", "raw_metrics", "kept_metrics", F.coalesce(F.col("b.k").cast("string"), F.lit("-")), F.coalesce(F.format_number("b.silhouette", 3), F.lit("-")))
    body = inventory.join(best, "service", "left").select(F.lit(1).alias("part"), "service", row.alias("value"))
    head = inventory.sparkSession.createDataFrame([(0, "", "| service | raw | kept | k | silhouette |\n|-|-|-|-|-|")], "part int, service string, value string")
    return head.unionByName(body).orderBy("part", "service").select("value")


def metric_table(clusters: DataFrame, per_line: int = 3) -> DataFrame:
    """One cell per cluster: its representative and its metrics, per_line names a line."""
    from causalloom.functions.names import abbreviate, lines_of

    short = F.transform(F.array_sort("metrics"), abbreviate)
    return clusters.select("service", "cluster", F.concat(abbreviate(F.col("representative")), F.lit(":\n"), lines_of(short, per_line)).alias("cell"))


def grouped_report(inventories: DataFrame) -> DataFrame:
    """(service, value): a line per service over all measurements of (measurement_name, service, raw_metrics, kept_metrics), in order of their names."""
    cell = F.format_string("%s: %s of %s", "measurement_name", "kept_metrics", "raw_metrics")
    rows = inventories.groupBy("service").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return rows.select("service", F.concat(F.lit("| "), F.col("service"), F.lit(" | "), F.array_join("cells", ", "), F.lit(" |")).alias("value"))


def cluster_pages(assigned: DataFrame) -> DataFrame:
    """(service, k, value): a page per clustering of (service, k, metric, cluster): a heading, then a line per cluster with its metrics in order."""
    each = assigned.groupBy("service", "k", "cluster").agg(F.array_sort(F.collect_list("metric")).alias("metrics"))
    line = F.struct("cluster", F.concat(F.lit("* "), F.col("cluster").cast("string"), F.lit(": "), F.array_join("metrics", ", ")).alias("line"))
    pages = each.groupBy("service", "k").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return pages.select("service", "k", F.concat(F.format_string("## %s, k = %s\n", "service", "k"), F.array_join(F.col("lines.line"), "\n")).alias("value"))

"""Readers of the formats that measurements, metadata and graphs come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METADATA = (
    "start string, end string, measurement_name string, metrics_export string, services array<struct<name string, filename string, tags array<string>, fields array<string>, "
    "preprocessed_filename string, preprocessed_fields array<string>, pref_cluster int>>"
)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Tab-separated files with a header, plain or gzip; empty cells are null. Without a schema all columns are strings."""
    reader = spark.read.options(sep="\t", header=True, nullValue="", mode="PERMISSIVE")
    return (reader.schema(schema) if schema else reader).csv(path)


def list_files(spark: SparkSession, folder: str, pattern: str = "*causality.tsv.gz") -> DataFrame:
    """(path, length) of a folder's files whose names match; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")


def read_wide_samples(spark: SparkSession, path: str, service: str, fields: list[str]) -> DataFrame:
    """A service's wide samples as long ones: CPU rows of single cores left out, NaN as null, only the fields asked for."""
    from causalloom.operators.series import null_or_total, wide_to_long

    rows = read_tsv(spark, path)
    if "cpu" in rows.columns:
        rows = null_or_total(rows)
    return wide_to_long(rows, service, [f for f in fields if f in rows.columns])


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The services of metadata documents, one row each."""
    doc = spark.read.schema(METADATA).json(path, multiLine=True)
    return doc.select("measurement_name", "start", "end", F.explode("services").alias("s")).select("measurement_name", "start", "end", "s.*")


def catalog(df: DataFrame) -> DataFrame:
    """Columns of a table as tags (strings) and fields (numbers); container ids count as tags."""
    spark = df.sparkSession
    numeric = (T.NumericType,)
    rows = [(f.name, "field" if isinstance(f.dataType, numeric) and f.name != "container_id" else "tag") for f in df.schema.fields if not isinstance(f.dataType, T.TimestampNTZType | T.TimestampType)]
    return spark.createDataFrame(sorted(rows), "name string, kind string")


def parse_dot(lines: DataFrame) -> DataFrame:
    """Edges of lines like `"a" -> "b"` (column value); blanks at the ends and quotes go."""
    p = r"^\s*\"?([^\"]*?)\"?\s+->\s+\"?([^\"\[;]*?)\"?\s*(?:\[.*)?;?\s*$"
    return lines.where(F.col("value").rlike(p)).select(F.regexp_extract("value", p, 1).alias("src"), F.regexp_extract("value", p, 2).alias("dst"))


def parse_arcs(lines: DataFrame, delimiter: str = " => ") -> DataFrame:
    """(line, src, w, dst) of lines `from => weight => to`; lines without the delimiter are skipped, blanks trimmed.

    `line` is the place in the input where the frame has it (column line), else null.
    """
    part = F.split(F.col("value"), delimiter.replace("\\", "\\\\") if delimiter.isalnum() else "\\Q" + delimiter + "\\E")
    rows = lines.where(F.contains("value", F.lit(delimiter))).withColumn("part", part)
    line = F.col("line") if "line" in lines.columns else F.monotonically_increasing_id()
    blank = F.lit(" \t")
    return rows.select(line.alias("line"), F.btrim(F.get("part", F.lit(0)), blank).alias("src"), F.btrim(F.get("part", F.lit(1)), blank).try_cast("double").alias("w"), F.btrim(F.get("part", F.lit(2)), blank).alias("dst"))


def parse_captures(lines: DataFrame) -> DataFrame:
    """(container, direction, port) of capture lines: words 2, 3 (`<` is RX) and 5 (host:port/path)."""
    from causalloom.functions.names import port_of

    w = F.split("value", " ")
    rows = lines.select(F.get(w, F.lit(2)).alias("container"), F.when(F.get(w, F.lit(3)) == "<", "RX").otherwise("TX").alias("direction"), port_of(F.get(w, F.lit(5))).try_cast("int").alias("port"))
    return rows.where(F.col("port").isNotNull())


def parse_ports(lines: DataFrame) -> DataFrame:
    """(service, port) of lines `service:port,port`; what is no number is skipped."""
    part = F.split("value", ":", 2)
    rows = lines.where(F.contains("value", F.lit(":"))).select(F.trim(F.get(part, F.lit(0))).alias("service"), F.explode(F.split(F.get(part, F.lit(1)), ",")).alias("p"))
    return rows.select("service", F.trim("p").try_cast("int").alias("port")).where(F.col("port").isNotNull())


def parse_demo_edges(lines: DataFrame) -> DataFrame:
    """Edges of lines `svc.metric > svc.metric|1,2` with >, < or <>: one row a direction."""
    p = r"^\s*(\S+?)\.(\S+)\s+(<>|<|>)\s+(\S+?)\.([^|\s]+)\|(\S+)\s*$"
    x = [F.regexp_extract("value", p, i) for i in range(1, 7)]
    lags = F.transform(F.split(x[5], ","), lambda v: v.cast("double").cast("int"))
    there = F.struct(x[0].alias("p_service"), x[1].alias("p_metric"), x[3].alias("c_service"), x[4].alias("c_metric"))
    back = F.struct(x[3].alias("p_service"), x[4].alias("p_metric"), x[0].alias("c_service"), x[1].alias("c_metric"))
    ways = F.when(x[2] == ">", F.array(there)).when(x[2] == "<", F.array(back)).otherwise(F.array(there, back))
    return lines.where(F.col("value").rlike(p)).select(F.explode(ways).alias("e"), lags.alias("lags")).select("e.*", "lags")


def parse_points(lines: DataFrame) -> DataFrame:
    """(measurement, key, value) of lines `measurement k="v",k="v"`; values are strings, cast where they are numbers."""
    name = F.substring_index("value", " ", 1)
    body = F.expr("substr(value, instr(value, ' ') + 1)")
    pairs = F.regexp_extract_all(body, F.lit(r'([^,=\s]+="[^"]*")'), F.lit(1))
    rows = lines.select(name.alias("measurement"), F.explode(pairs).alias("kv"))
    text = F.expr("trim(BOTH '\"' FROM substr(kv, instr(kv, '=') + 1))")
    return rows.select("measurement", F.substring_index("kv", "=", 1).alias("key"), text.alias("text"), text.try_cast("double").alias("number"))

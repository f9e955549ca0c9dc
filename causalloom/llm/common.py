"""Shared helpers of the operators: input tables, lineage cuts, expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causalloom.functions.runtime import discard, materialize, shared_dir, visible

__all__ = ["discard", "let", "materialize", "meet", "salted", "shared_dir", "table"]

#: A key with over 1 / HOT_PARTS of a table's rows is hot; there are at most HOT_PARTS of these.
HOT_PARTS = 10_000


def let(value: Column, body) -> Column:
    """Bind value once and use it many times in body, without a second evaluation."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    visible(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def meet(rows: DataFrame, keyed: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner, or left) to keyed on key, where no key's rows gather in one task.

    keyed has one row a key, and in column n the number of that key's rows; total is the
    number of rows. The keyed rows of hot keys, HOT_PARTS at most whatever the input, are
    broadcast, so these rows stay where they are; all others are shuffled by key.
    """
    least = total / HOT_PARTS
    hot = F.broadcast(keyed.where(F.col("n") > least))
    cold = rows.join(hot.select(key), key, "left_anti").join(keyed.where(F.col("n") <= least), key, how)
    return rows.join(hot, key).unionByName(cold)


def salted(rows: DataFrame, wide: DataFrame, key: str, total: int, by: str) -> DataFrame:
    """rows joined to wide (one row a key, of any size), hot keys cut into pieces by a hash of `by`.

    A key with over total / HOT_PARTS of the rows is dealt to pieces of about that many, and
    its wide row is copied to each: 2 * HOT_PARTS copies at most, whatever the input.
    """
    least = max(total / HOT_PARTS, 64.0)
    hot = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > least)
    hot = F.broadcast(materialize(hot.select(key, F.ceil(F.col("__n") / least).cast("int").alias("__pieces")), "hot-keys"))
    left = rows.join(hot, key, "left").withColumn("__piece", F.coalesce(F.pmod(F.xxhash64(by, F.lit(1)), "__pieces"), F.lit(0)).cast("int"))
    right = wide.join(hot, key, "left").withColumn("__piece", F.explode(F.sequence(F.lit(0), F.coalesce("__pieces", F.lit(1)) - 1)))
    return left.drop("__pieces").join(right.drop("__pieces"), [key, "__piece"]).drop("__piece")

"""From raw documents to packed token windows: four stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from causalloom.llm import queries
from causalloom.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that the label model rejects go.

    Null and empty texts have no words and go; repeated rows stay as often as they come; an
    empty table stays empty.
    """
    from causalloom.llm.quality import filter_quality

    return filter_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: later copies of repeated multi-line chunks leave the texts.

    Every row stays, with a null text null and a text that loses all its lines empty; rows
    equal in id and text get the same text; an empty table stays empty.
    """
    from causalloom.llm.line_dedup import clean_lines

    return clean_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each group of near-duplicates stays, that with the least id.

    Null and empty texts are one group, texts of white space are groups by their bytes; of
    repeated rows one stays; an empty table stays empty.
    """
    from causalloom.llm.near_dedup import keep_representatives

    return keep_representatives(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: tokens of what is left, in windows.

    Null and empty texts give the end id alone; rows with equal or null ids are packed as
    separate documents; an empty table gives no pieces.
    """
    from causalloom.llm.packing import pack

    return pack(docs, queries.vocabulary("byte_bpe_50k.json"), queries.PACK_SIZE, end_id=0)


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("minhash near-dedup", near_dedup),
    ("packing", packing),
]

#: The label model and consistent weighted sampling have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs

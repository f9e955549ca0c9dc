"""Main text of web pages, by labelling every leaf block of a page."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import blocks
from .html_model import BlockLabeller, trained, vectors


def page_texts(pages: list[str | None], model: BlockLabeller) -> list[str]:
    """The article of each page: its blocks that the model labels so, joined by an empty line."""
    found = [blocks(p) for p in pages]
    labels = model.label([vectors(b) for b in found])
    return ["\n\n".join(b.text for b, good in zip(bs, label, strict=False) if good) for bs, label in zip(found, labels, strict=True)]


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: BlockLabeller | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page, from the whole html.

    Each task parses pages into leaf blocks and labels all blocks of a page at once; a
    page is never cut. The weights come with the package (html_training fits them), so
    nothing is trained here. Null, empty and text-less pages have an empty text. Repeated rows
    and null ids stay; other columns are ignored; an empty table gives no rows. There is
    no shuffle; the model's size is fixed.
    """
    shared = pages.sparkSession.sparkContext.broadcast((model or trained()).p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = BlockLabeller()
        labeller.p = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = page_texts(part.column(2).to_pylist(), labeller)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

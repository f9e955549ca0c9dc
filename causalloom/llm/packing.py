"""Packing of token streams into fixed windows by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .units import encoder

#: Windows at least this full stay as they are when a stream ends; emptier ones are merged.
FULL_ENOUGH = 0.97


class SumOfSquares:
    """Online packer for items of 1 to size tokens into windows of size tokens.

    levels[h] holds the open windows filled to h; count[h] is their number. An item
    of length s goes where the sum of squared counts grows least: into a window at
    h, which moves from h to h + s (a full window leaves the array), or into a new
    one, which appears at s. Ties go to the fullest window. The array has one cell
    a fill level, so a step costs O(size) array arithmetic, whatever has come before.
    """

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        self.levels: list[list[list]] = [[] for _ in range(size)]

    def place(self, item, length: int) -> list | None:
        """Put the item; return the window's items if that filled it."""
        size, count = self.size, self.count
        new = 2 * count[length] + 1 if length < size else 0
        room = size - length
        level = -1
        if room > 0:
            here = count[1 : room + 1]
            #: (n_h - 1)^2 - n_h^2 + (n_t + 1)^2 - n_t^2 with t = h + length; t = size costs nothing.
            to = 2 * count[1 + length : size + 1] + 1
            to[-1] = 0
            cost = np.where(here > 0, to - 2 * here + 1, np.iinfo(np.int64).max)
            best = room - 1 - int(np.argmin(cost[::-1]))
            if here[best] > 0 and cost[best] <= new:
                level = best + 1
        if level > 0:
            window = self.levels[level].pop()
            count[level] -= 1
        else:
            window, level = [], 0
        window.append(item)
        if level + length == size:
            return window
        self.levels[level + length].append(window)
        count[level + length] += 1
        return None

    def rest(self) -> Iterator[tuple[int, list]]:
        """The open windows, fullest first."""
        for h in range(self.size - 1, 0, -1):
            for w in self.levels[h]:
                yield h, w


def _close(packer: SumOfSquares, size: int) -> Iterator[list]:
    """Windows from what is open at the end: emptier ones are emptied, cut, into fuller ones."""
    left = list(packer.rest())
    keep = [w for h, w in left if h >= FULL_ENOUGH * size]
    yield from keep
    left = left[len(keep) :]
    i, j = 0, len(left) - 1
    pool: list = []
    while i <= j:
        fill, window = left[i]
        i += 1
        while fill < size and (pool or i <= j):
            if not pool:
                pool = left[j][1]
                j -= 1
            doc, start, ids, total = pool.pop()
            cut = min(len(ids) // 4, size - fill)
            window.append((doc, start, ids[: 4 * cut], total))
            fill += cut
            if 4 * cut < len(ids):
                pool.append((doc, start + cut, ids[4 * cut :], total))
        yield window
    while pool:
        window, fill = [], 0
        while pool and fill < size:
            doc, start, ids, total = pool.pop()
            cut = min(len(ids) // 4, size - fill)
            window.append((doc, start, ids[: 4 * cut], total))
            fill += cut
            if 4 * cut < len(ids):
                pool.append((doc, start + cut, ids[4 * cut :], total))
        yield window


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
ID_BITS = 33


def pack(
    docs: DataFrame, tokenizer_file: str, size: int = 1024, end_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Encode every text, append end_id, and pack the ids into windows of size tokens.

    Each input partition is a stream of its own: texts are never shuffled, and a task
    holds one batch and its open windows. A document's full windows leave at once; the
    rest of it, shorter than a window, is the item that the sum-of-squares rule places.
    When the stream ends, windows under FULL_ENOUGH are merged by cutting their pieces,
    so at most one of those per partition stays part empty.

    Returns one row per piece: its document, where it starts in the document's ids,
    its length, the crc32 of its ids (little-endian uint32), the document's token count,
    the window (partition number << 33, plus a number in it) and its place in it;
    with_ids adds the ids. Null and empty texts give the end id alone. Rows with equal
    or null ids are packed as separate documents. Other columns are ignored; an empty
    table gives no rows.
    """
    from tokenizers import Tokenizer

    spec = Tokenizer.from_file(tokenizer_file).to_str()
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(spec)  # the vocabulary file: a size that no input changes
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer_file, shared.value)
        packer, serial = SumOfSquares(size), TaskContext.get().partitionId() << ID_BITS
        out: list[list] = [[] for _ in range(8)]

        def emit(window: list) -> None:
            nonlocal serial
            at = 0
            for doc, start, ids, total in window:
                n = len(ids) // 4
                for col, x in zip(out, (doc, start, n, zlib.crc32(ids), total, serial, at, ids), strict=True):
                    col.append(x)
                at += n
            serial += 1

        def flush() -> Iterator[pa.RecordBatch]:
            if out[0]:
                cols = [pa.array(c, pa.int64()) for c in out[:7]]
                if with_ids:
                    flat = np.frombuffer(b"".join(out[7]), "<u4").astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(np.cumsum([0, *out[2]]).astype(np.int32), flat))
                for c in out:
                    c.clear()
                yield pa.RecordBatch.from_arrays(cols, COLUMNS + ["ids"] * with_ids)

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            docs_ = batch.column(0).to_pylist()
            for lo in range(0, len(texts), 500):
                for doc, ids in zip(docs_[lo : lo + 500], enc.ids(texts[lo : lo + 500]), strict=True):
                    ids += end
                    total = len(ids) // 4
                    whole = total - total % size
                    for s in range(0, whole, size):
                        emit([(doc, s, ids[4 * s : 4 * (s + size)], total)])
                    if whole < total and (w := packer.place((doc, whole, ids[4 * whole :], total), total - whole)):
                        emit(w)
                yield from flush()
        for window in _close(packer, size):
            emit(window)
            if len(out[0]) > 5000:
                yield from flush()
        yield from flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)

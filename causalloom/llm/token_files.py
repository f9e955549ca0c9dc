"""Token ids as Arrow stream files of fixed-size-list batches, for zero-copy random access.

A file holds equal-length sequences: column `ids` is fixed_size_list<uint16 or uint32>[L],
column `mask` a dictionary of fixed_size_list<uint8>[L] (0 on the padding at the file's
end, else 1), so that the many equal masks lie in the file once. An index
beside it (`.index.arrow`) has a row per document: doc_id, start in the file, n_tokens.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir
from .units import encoder

SEQUENCE = 2048
BATCH_SEQUENCES = 256
#: Bytes of text that go into one file, about.
FILE_BYTES = 1 << 28


def _filesystem(uri: str):
    """Filesystem and path of a URI in the shared folder: file:, hdfs:, s3: and what else Arrow opens."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class TokenFileWriter:
    """Writes one file and its index; the file appears under its name only when it is whole."""

    def __init__(self, uri: str, wide: bool, sequence: int = SEQUENCE):
        self.fs, self.path = _filesystem(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.kind, self.n = (np.dtype("<u4") if wide else np.dtype("<u2")), sequence
        import uuid

        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        value = pa.uint32() if wide else pa.uint16()
        self.schema = pa.schema([("ids", pa.list_(value, sequence)), ("mask", pa.dictionary(pa.int8(), pa.list_(pa.uint8(), sequence)))])
        self.sink = self.fs.open_output_stream(self.temporary)
        self.stream = pa.ipc.new_stream(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.count = self.total = 0
        self.docs: list[int | None] = []
        self.sizes = array("q")

    def add(self, doc_id: int | None, ids: bytes) -> None:
        got = np.frombuffer(ids, "<u4").astype(self.kind)
        self.docs.append(doc_id)
        self.sizes.append(len(got))
        self.total += len(got)
        self.held.append(got)
        self.count += len(got)
        if self.count >= self.n * BATCH_SEQUENCES:
            self._write(self.count - self.count % self.n)

    def _write(self, most: int) -> None:
        flat = np.concatenate(self.held)
        head, tail = flat[:most], flat[most:]
        pad = -len(head) % self.n  # only at the file's end
        if pad:
            head = np.concatenate([head, np.zeros(pad, self.kind)])
        ids = pa.FixedSizeListArray.from_arrays(pa.array(head), self.n)
        for at in range(0, len(ids), BATCH_SEQUENCES):
            part = ids.slice(at, BATCH_SEQUENCES)
            masks, which = np.ones((1 + bool(pad), self.n), np.uint8), np.zeros(len(part), np.int8)
            if pad:
                masks[1, -pad:] = 0
                which[-1] = at + BATCH_SEQUENCES >= len(ids)
            mask = pa.DictionaryArray.from_arrays(pa.array(which), pa.FixedSizeListArray.from_arrays(pa.array(masks.reshape(-1)), self.n))
            self.stream.write_batch(pa.RecordBatch.from_arrays([part, mask], schema=self.schema))
        self.held, self.count = [tail] if len(tail) else [], len(tail)

    def close(self) -> None:
        if self.count:
            self._write(self.count)
        self.stream.close()
        self.sink.close()
        sizes = np.array(self.sizes, np.int64)
        index = pa.table({"doc_id": pa.array(self.docs, pa.int64()), "start": np.cumsum(sizes) - sizes, "n_tokens": sizes})
        with self.fs.open_output_stream(f"{self.temporary}.index") as out, pa.ipc.new_stream(out, index.schema) as w:
            w.write_table(index)
        self.fs.move(f"{self.temporary}.index", f"{self.path}.index.arrow")
        self.fs.move(self.temporary, self.path)


class TokenFile:
    """Random access to a written file: sequences as zero-copy views, documents by number."""

    def __init__(self, uri: str):
        fs, path = _filesystem(uri)
        local = fs.type_name == "local"
        self.source = pa.memory_map(path) if local else fs.open_input_file(path)
        reader = pa.ipc.open_stream(self.source)
        self.batches = list(reader)  # memory-mapped: no bytes are copied
        self.n = reader.schema.field("ids").type.list_size
        self.first = np.cumsum([0, *[b.num_rows for b in self.batches]])
        with fs.open_input_stream(f"{path}.index.arrow") as f:
            self.index = pa.ipc.open_stream(f).read_all()

    def _place(self, i: int) -> tuple[int, int]:
        b = int(np.searchsorted(self.first, i, "right")) - 1
        return b, i - int(self.first[b])

    def _flat(self, batch: int) -> pa.Array:
        col = self.batches[batch].column("ids")
        return col.values.slice(col.offset * self.n, len(col) * self.n)

    def sequence(self, i: int) -> np.ndarray:
        """The ids of sequence i, a view of the file."""
        b, at = self._place(i)
        return self._flat(b).slice(at * self.n, self.n).to_numpy(zero_copy_only=True)

    def mask(self, i: int) -> np.ndarray:
        """1 for each id of sequence i that is a token, 0 for padding; a view of the file."""
        b, at = self._place(i)
        col = self.batches[b].column("mask")
        masks = col.dictionary
        return masks.values.slice((masks.offset + col.indices[at].as_py()) * self.n, self.n).to_numpy(zero_copy_only=True)

    def tokens(self, start: int, count: int) -> np.ndarray:
        """Ids start to start + count of the file, over batches."""
        parts, end = [], start + count
        b = int(np.searchsorted(self.first * self.n, start, "right")) - 1
        while start < end:
            base = int(self.first[b]) * self.n
            flat = self._flat(b).to_numpy(zero_copy_only=True)
            part = flat[start - base : end - base]
            parts.append(part)
            start += len(part)
            b += 1
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint32)


def write_tokens(
    docs: DataFrame, tokenizer_file: str, path: str, end_id: int = 1, partitions: int | None = None,
    sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Encode every text, append end_id, and write token files in ascending id order.

    Texts are dealt by ranges of their id (ties by their row in the input, so a repeated
    id spreads over files), sorted, encoded and written where they land; file k holds the
    k-th range. There are `partitions` files, or as many as the session has shuffle
    partitions, but more where a file would then hold over FILE_BYTES of text. Returns the manifest, one row a file: file (number), path, docs, tokens.
    A task that runs again writes under a temporary name first, so readers never see parts.
    Null texts are empty: the end id alone. Null ids come first. Other columns are ignored.
    An empty table writes no file.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    wide = max(tokenizer.get_vocab_size() - 1, end_id) > 0xFFFF
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer.to_str())  # the vocabulary file: a size that no input changes
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, writer = TaskContext.get().partitionId(), None
        enc = encoder(tokenizer_file, shared.value)
        uri = f"{path}/part-{number:06d}.arrow"
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for lo in range(0, len(texts), 500):
                writer = writer or TokenFileWriter(uri, wide, sequence)
                for doc, got in zip(ids[lo : lo + 500], enc.ids(texts[lo : lo + 500]), strict=True):
                    writer.add(doc, got + end)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"file": pa.array([number], pa.int32()), "path": [uri], "docs": pa.array([len(writer.docs)], pa.int64()), "tokens": pa.array([writer.total], pa.int64())})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE_BYTES))
    dealt = rows.repartitionByRange(n, "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    files = dealt.mapInArrow(run, "file int, path string, docs long, tokens long").collect()  # one row a file
    schema = T.StructType.fromDDL("file int, path string, docs long, tokens long")
    return spark.createDataFrame(sorted(files), schema)


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of written files: doc_id, start (ids before it in all files), n_tokens, ids_crc32.

    A file's first id follows from the token counts of the files before it. Each file is
    opened in its own task by memory map, and its documents are slices of the mapped ids.
    with_ids adds the ids.
    """
    spark = manifest.sparkSession
    rows, at = [], 0
    for r in sorted(manifest.collect()):
        rows.append((r["path"], at))
        at += r["tokens"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(path)
                for part in file.index.to_batches(max_chunksize=4096):
                    starts, sizes = part.column("start").to_pylist(), part.column("n_tokens").to_pylist()
                    got = [file.tokens(s, n) for s, n in zip(starts, sizes, strict=True)]
                    sums = [zlib.crc32(x.astype("<u4")) for x in got]
                    cols = [part.column("doc_id"), pa.array([before + s for s in starts], pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())]
                    if with_ids:
                        cols.append(pa.array([x.astype(np.int32) for x in got], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(cols, names)

    if not rows:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame(rows, "path string, before long").repartition(len(rows))
    return files.mapInArrow(run, schema)


def token_table(docs: DataFrame, tokenizer_file: str, end_id: int = 1) -> DataFrame:
    """Write docs to token files in the shared folder and return read_tokens() of them."""
    return read_tokens(write_tokens(docs, tokenizer_file, shared_dir(docs.sparkSession, "tokens"), end_id))

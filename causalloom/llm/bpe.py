"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import hashlib
import heapq
import pickle
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .units import Known

#: Units (what stands between two spaces) and pre-tokens kept by a Python worker.
CACHE_UNITS, CACHE_PIECES, CACHE_CHARS = 500_000, 300_000, 48
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
M64 = (1 << 64) - 1


def _mix(x: int) -> int:
    x = ((x ^ (x >> 30)) * MIX[1]) & M64
    x = ((x ^ (x >> 27)) * MIX[2]) & M64
    return x ^ (x >> 31)


class PerfectHash:
    """Minimal perfect hash over the vocabulary by hash-and-displace.

    Keys fall into buckets of about four. Buckets, largest first, take the least
    displacement under which all their keys hash to free slots; a bucket of one key takes
    a free slot outright, noted as -1 - slot. A lookup reads one displacement, one id, and
    the key's own bytes at the slot, which tell members from strangers.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.n = max(1, len(ranks))
        self.buckets = self.n // 4 + 1
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for key in ranks:
            h = hash_bytes(key)
            groups.setdefault(h % self.buckets, []).append((h, key))
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * self.n
        self.ids = [-1] * self.n
        order = sorted(groups.items(), key=lambda x: (-len(x[1]), x[0]))
        for bucket, members in order:
            if len(members) == 1:
                continue
            d = 0
            while True:
                slots = [self._slot(h, d) for h, _ in members]
                if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                    break
                d += 1
            self.shift[bucket] = d
            for s, (_, key) in zip(slots, members, strict=True):
                self.keys[s], self.ids[s] = key, ranks[key]
        free = iter([s for s in range(self.n) if self.keys[s] is None])
        for bucket, members in order:
            if len(members) == 1:
                s = next(free)
                self.shift[bucket] = -1 - s
                self.keys[s], self.ids[s] = members[0][1], ranks[members[0][1]]

    def _slot(self, h: int, d: int) -> int:
        return -1 - d if d < 0 else _mix((h + d * MIX[0]) & M64) % self.n

    def get(self, key: bytes) -> int:
        """The key's id, or -1."""
        h = hash_bytes(key)
        slot = self._slot(h, self.shift[h % self.buckets])
        return self.ids[slot] if self.keys[slot] == key else -1


def hash_bytes(key: bytes) -> int:
    """64 bits of a key, the same in every process."""
    import xxhash

    return xxhash.xxh3_64_intdigest(key)


class BytePairCodec:
    """Encoder and decoder for one set of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.words = PerfectHash(ranks)
        self.pattern, self.find = pattern, regex.compile(pattern).findall
        self.bytes_of = {i: k for k, i in ranks.items()}
        pairs = {}
        for token in ranks:
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = ranks[token]
        #: (left id, right id) -> rank of the joined token, which is its id.
        self.pairs = pairs
        self.byte_ids = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.open()

    def open(self) -> None:
        """Start with empty caches."""
        self.units, self.pieces = Known(self._unit), Known(self.word)
        self.unit_room, self.piece_room, self.odd = CACHE_UNITS, CACHE_PIECES, False

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("units", "pieces", "find")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.find = regex.compile(self.pattern).findall
        self.open()

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Merge a word's bytes, least rank first and leftmost among equals, on a linked list.

        The heap holds (rank, place, left id, right id); an entry is stale if either id
        has changed since. Each merge adds two entries at most: O(n log n) for n bytes.
        """
        ids = [self.byte_ids[b] for b in word]
        if -1 in ids:
            raise ValueError("the ranks lack a single byte of the text")
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = pairs.get(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                heap.append((rank, i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            rank, i, left, right = pop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = rank, -1
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                r = pairs.get(rank << 32 | ids[k])
                if r is not None:
                    push(heap, (r, i, rank, ids[k]))
            p = before[i]
            if p >= 0:
                r = pairs.get(ids[p] << 32 | rank)
                if r is not None:
                    push(heap, (r, p, ids[p], rank))
        return tuple(x for x in ids if x >= 0)

    def word(self, piece: str) -> tuple[int, ...]:
        """Ids of one match of the pattern: the perfect hash, else the heap."""
        raw = piece.encode()
        whole = self.words.get(raw)
        out = (whole,) if whole >= 0 else self.merge(raw)
        if self.piece_room > 0 and len(piece) <= CACHE_CHARS:
            self.pieces[piece] = out
            self.piece_room -= 1
        return out

    def _unit(self, unit: str) -> tuple[int, ...]:
        """Ids of a unit with the space before it, kept while there is room."""
        if not unit or unit[0].isspace() or unit[-1].isspace():
            self.odd = True
            return ()
        out = self._split(" " + unit)
        if self.unit_room > 0 and len(unit) <= CACHE_CHARS:
            self.units[unit] = out
            self.unit_room -= 1
        return out

    def _split(self, text: str) -> tuple[int, ...]:
        found = self.find(text)
        return self.pieces[found[0]] if len(found) == 1 else tuple(chain.from_iterable(map(self.pieces.__getitem__, found)))

    def encode(self, text: str) -> list[int]:
        """Ids of a text, each match of the pattern separately.

        Matches never span the space before a word, so a text is the sequence of its
        units, each with the space before it, unless a unit is empty or begins or ends
        with white space; then the pattern runs over the whole text.
        """
        head, *units = text.split(" ")
        self.odd = bool(units) and head[-1:].isspace()
        if not self.odd:
            out = list(self._split(head)) if head else []
            out.extend(chain.from_iterable(map(self.units.__getitem__, units)))
            if not self.odd:
                return out
        return list(self._split(text))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def prepared(path: str, pattern: str) -> bytes:
    """The codec of a vocabulary file, ready to be sent to workers: its size follows the vocabulary alone."""
    return pickle.dumps(BytePairCodec(read_ranks(path), pattern))


_ready: dict[tuple, BytePairCodec] = {}


def encode_documents(
    docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Encode every whole text, decode the ids again, and return digests of both.

    Columns: doc_id, n_tokens, ids_sha256 (hex, of the decimal ids joined by a space),
    decoded_sha256 (hex, of the decoded bytes); with_ids adds the ids. One pass without
    a shuffle; a worker keeps CACHE_UNITS units at most, and a text of any length is one
    step. Null and empty texts have no ids. Repeated rows and null ids stay as they are;
    other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(prepared(ranks_file, pattern))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (ranks_file, pattern)
        if key not in _ready:
            _ready[key] = pickle.loads(shared.value)
        codec, sha = _ready[key], hashlib.sha256
        decimal = {i: str(i) for i in codec.bytes_of}
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(texts), 1000):
                sizes, left, right, kept = [], [], [], []
                for text in texts[lo : lo + 1000]:
                    ids = codec.encode(text or "")
                    sizes.append(len(ids))
                    left.append(sha(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    right.append(sha(codec.decode(ids)).hexdigest())
                    if with_ids:
                        kept.append(ids)
                cols = [pa.array(ids_of[lo : lo + 1000], pa.int64()), pa.array(sizes, pa.int64()), pa.array(left), pa.array(right)]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)

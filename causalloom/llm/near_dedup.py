"""Near-duplicates by consistent weighted sampling over TF-IDF shingles, verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalloom.operators.components import components

from .common import discard, materialize, meet, salted
from .shingles import Block, ConsistentSampler, Idf, WordHash, counted, packed, unpacked, weighted_jaccard

THRESHOLD, BANDS, ROWS = 0.8, 15, 3
#: Shingles in up to this part of all documents have the highest IDF.
IDF_RARE = 1 / 512
#: Documents (and shingles) counted at a time, and the least part of them that a shingle must have there to be sent.
COUNT_DOCS, COUNT_SHINGLES, COUNT_PART = 4096, 1 << 24, 1 / 1024
#: Members of a bucket that the others are compared with.
LEADERS = 4
#: Texts, and shingles, of a block whose members are compared all with all.
BLOCK, BLOCK_SHINGLES = 512, 1 << 22

_hashes: list[WordHash] = []


def _word_hash() -> WordHash:
    """One per Python worker."""
    if not _hashes:
        _hashes.append(WordHash())
    return _hashes[0]


def _sets(rows: DataFrame) -> DataFrame:
    """(row, id, th, h, many) of every document: its distinct 5-word shingles and their counts, as bytes. Texts end here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_hash()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = [packed(*counted(words.shingles(text))) for text in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([h for h, _ in got], pa.binary()), pa.array([m for _, m in got], pa.binary())], ["row", "id", "th", "h", "many"])

    return rows.mapInArrow(run, "row long, id long, th string, h binary, many binary")


def _hashes_of(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    for lo in range(0, batch.num_rows, 256):
        for h in batch.column(column).slice(lo, 256).to_pylist():
            yield np.frombuffer(h, "<u4")


def frequent_shingles(sets: DataFrame, total: int, rare: float = IDF_RARE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles in over `rare` of all documents, and the exact parts they are in.

    The first pass finds candidates. It counts COUNT_DOCS documents at a time, and sends the
    shingles that stand in COUNT_PART of these at least. What it keeps back is less than
    COUNT_PART of all documents a shingle, so those whose sum is over rare - COUNT_PART hold
    all that are over rare, however the table is partitioned. They are
    mean shingles of a document / (rare - COUNT_PART) at most, whatever the input. The second
    pass counts these in all documents.
    """
    if not total:
        return np.empty(0, np.uint32), np.empty(0)
    only = sets.select("h").coalesce(max(1, total // (2 * COUNT_DOCS)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def block(some: list[np.ndarray]) -> pa.RecordBatch:
            h, n = counted(np.concatenate(some)) if some else (np.empty(0, np.uint32), np.empty(0))
            keep = n >= COUNT_PART * len(some)
            return pa.RecordBatch.from_arrays([pa.array(h[keep].astype(np.int64)), pa.array(n[keep].astype(np.int64))], ["h", "n"])

        for batch in batches:
            for h in _hashes_of(batch, 0):
                held.append(h)
                size += len(h)
                if len(held) == 2 * COUNT_DOCS or size > COUNT_SHINGLES:
                    now = held[:COUNT_DOCS]
                    held = held[COUNT_DOCS:]
                    size = sum(map(len, held))
                    yield block(now)
        yield block(held)

    sums = only.mapInArrow(find, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > (rare - COUNT_PART) * total)
    maybe = np.sort(sums.select("h").toArrow()["h"].to_numpy().astype(np.uint32))
    if not len(maybe):
        return np.empty(0, np.uint32), np.empty(0)
    shared = sets.sparkSession.sparkContext.broadcast(maybe)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, seen = shared.value, np.zeros(len(shared.value), np.int64)
        bits = np.zeros(1 << 16, bool)
        bits[of & 0xFFFF] = True
        for batch in batches:
            for h in _hashes_of(batch, 0):
                some = h[bits[h & 0xFFFF]]
                pos = np.minimum(np.searchsorted(of, some), len(of) - 1)
                seen[pos[of[pos] == some]] += 1  # a document's hashes are distinct
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(of[at].astype(np.int64)), pa.array(seen[at])], ["h", "n"])

    exact = only.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > rare * total).toArrow()
    return exact["h"].to_numpy().astype(np.uint32), exact["n"].to_numpy() / total


def _signed(sets: DataFrame, idf, bands: int, rows_: int) -> DataFrame:
    """(node, h, many) with size, the number of shingles, and bands, null if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, sampler = Idf(*idf.value, IDF_RARE), ConsistentSampler(bands, rows_)
        for batch in batches:
            lo, hi = 0, 0
            hs, ws, sizes, size = [], [], [], 0
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                for bytes_, many in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    h, tf = unpacked(bytes_, many)
                    hs.append(h)
                    ws.append(weigh.weights(h, tf))
                    sizes.append(len(h))
                    size += len(h)
                    hi += 1
                    if size < 60_000 and hi < batch.num_rows:
                        continue
                    n = np.array(sizes)
                    some = np.flatnonzero(n)
                    out: list = [None] * len(sizes)
                    if len(some):
                        starts = (np.cumsum(n) - n)[some]
                        for i, b in zip(some, sampler.band_hashes(np.concatenate(hs), np.concatenate(ws), starts).view(np.int64), strict=True):
                            out[i] = b
                    held = batch.slice(lo, hi - lo)
                    yield pa.RecordBatch.from_arrays([*held.columns, pa.array(n, pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["node", "h", "many", "size", "bands"])
                    lo = hi
                    hs, ws, sizes, size = [], [], [], 0

    return sets.mapInArrow(run, "node long, h binary, many binary, size long, bands array<long>")


def _verified(pairs: DataFrame, total: int, sets: DataFrame, idf, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough, by all their shingles; no end of many pairs is hot."""
    left = sets.select(F.col("node").alias("a"), F.col("h").alias("h_a"), F.col("many").alias("many_a"))
    right = sets.select(F.col("node").alias("b"), F.col("h").alias("h_b"), F.col("many").alias("many_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = Idf(*idf.value, IDF_RARE)

        def weighted(h: bytes, many: bytes):
            x, tf = unpacked(h, many)
            return x, weigh.weights(x, tf)

        for batch in batches:
            keep = []
            for lo in range(0, batch.num_rows, 256):
                for ha, ma, hb, mb in zip(*(batch.column(c).slice(lo, 256).to_pylist() for c in (2, 3, 4, 5)), strict=True):
                    keep.append(weighted_jaccard(weighted(ha, ma), weighted(hb, mb)) >= threshold)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = salted(salted(pairs, left, "a", total, "b"), right, "b", total, "a").select("a", "b", "h_a", "many_a", "h_b", "many_b")
    return materialize(joined.mapInArrow(run, "a long, b long"), "links")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(documents: id, th) and (texts: th, node, id, n, root), one row per distinct text, root naming its class.

    1. Every text becomes its set of hashed shingles, once. Shingle frequencies over all
       documents give the IDF (frequent_shingles).
    2. Exact copies collapse by md5 (th) into a node, so a text has one row from here on.
       Each node's weighted shingles are sampled; BANDS bands of ROWS samples.
    3. Per band, texts with equal samples form a bucket. Each bucket names LEADERS members,
       drawn by hashes that differ from bucket to bucket, as minima in a partial
       aggregation; every other member pairs with them: rows grow with members, not pairs.
    4. Each text is verified, whole, with the leader that it meets most; links form
       components. Buckets that still hold two components or more are compared exactly in
       blocks (_mixed), and in buckets of several blocks every two members that are still
       in different components are compared too (_rest): no bucket is capped.

    Joins by bucket, text hash or pair end keep no hot key in one task (meet, salted).
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.md5(text).alias("th"), text.alias("text"))
    each = materialize(_sets(rows), "shingles")
    total = each.count()
    idf = spark.sparkContext.broadcast(frequent_shingles(each, total))
    names = materialize(each.select("row", "id", "th"), "names")
    nodes = materialize(names.groupBy("th").agg(F.min("id").alias("id"), F.min("row").alias("node"), F.count("*").alias("n")), "nodes")
    one = each.select(F.col("row").alias("node"), "h", "many").join(nodes.select("node"), "node")
    sets = materialize(_signed(one, idf, BANDS, ROWS), "sets")
    discard(each)
    member = sets.where(F.col("bands").isNotNull()).select("node", "size", F.posexplode("bands")).select("node", "size", F.xxhash64("pos", "col").alias("bucket"))
    draws = [F.min(F.struct(F.xxhash64("node", "bucket", F.lit(i)), F.col("node"))).alias(f"l{i}") for i in range(LEADERS)]
    lead = member.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), *draws).where(F.col("n") > 1)
    lead = lead.select("bucket", F.array_distinct(F.array(*[F.col(f"l{i}.node") for i in range(LEADERS)])).alias("leaders"), "n", "shingles")
    lead = materialize(lead, "leaders")
    met = materialize(meet(member, lead, "bucket", BANDS * total).select("bucket", "node", "size", "leaders"), "met")
    pairs = met.select("node", F.explode("leaders").alias("leader")).where(F.col("node") != F.col("leader"))
    pairs = pairs.groupBy(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).agg(F.count("*").alias("n"))
    best = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), "n", "b", "a"), F.struct(F.col("b").alias("node"), "n", "b", "a"))).alias("x"))
    best = best.groupBy("x.node").agg(F.max(F.struct("x.n", "x.b", "x.a")).alias("x")).select("x.a", "x.b").distinct()
    best = materialize(best, "pairs")
    links = _verified(best, total, sets, idf, threshold)
    roots = components(links)
    for tasks in (_mixed, _rest):
        more = _compared(tasks(met, lead, roots, BANDS * total), sets, roots, idf, threshold)
        if not more.isEmpty():
            links = links.union(more)
            roots = components(links)
    named = materialize(nodes.join(roots, "node", "left").select("th", "node", "id", "n", F.coalesce("root", "node").alias("root")), "classes")
    discard(sets, met, lead, best, nodes)
    return names.select("id", "th"), named


def _blocks(texts: Column, shingles: Column) -> Column:
    """Number of blocks for so many texts and shingles."""
    return F.greatest(F.ceil(texts / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _mixed(met: DataFrame, lead: DataFrame, roots: DataFrame, total: int) -> DataFrame:
    """Tasks for buckets whose members lie in two components or more: (task, node, left, right).

    Members are dealt by a hash to blocks of about BLOCK texts, or BLOCK_SHINGLES shingles;
    a task compares all members of a block with each other and, where a bucket has several
    blocks, with the leaders. So buckets of one block, nearly all, are compared exactly.
    """
    rooted = met.join(roots, "node", "left").select("bucket", "size", F.coalesce("root", "node").alias("root"))
    sizes = rooted.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.min("root").alias("lo"), F.max("root").alias("hi")).where(F.col("lo") != F.col("hi"))
    sizes = materialize(sizes.select("bucket", "n", _blocks(F.col("n"), F.col("shingles")).alias("blocks")), "mixed")
    own = meet(met, sizes, "bucket", total).select("bucket", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), "node", F.lit(True).alias("left"))
    heads = lead.join(sizes.where(F.col("blocks") > 1), "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "leaders")
    heads = heads.select("bucket", "block", F.explode("leaders").alias("node"), F.lit(False).alias("left"))
    return own.unionByName(heads).select(F.xxhash64("bucket", "block").alias("task"), "node", "left", F.lit(True).alias("right"))


def _rest(met: DataFrame, lead: DataFrame, roots: DataFrame, total: int) -> DataFrame:
    """Tasks for buckets of over one block: every two members in different components meet.

    A pair in two components has an end outside the bucket's largest one. So blocks of all
    members (left) meet blocks of the outsiders (right): with m members and o outsiders a
    text is copied o / BLOCK times, an outsider's m / BLOCK times more.
    """
    large = lead.where(_blocks(F.col("n"), F.col("shingles")) > 1).select("bucket", "n")
    mine = meet(met, large, "bucket", total).join(roots, "node", "left").select("bucket", "node", "size", F.coalesce("root", "node").alias("root"))
    mine = materialize(mine, "large-buckets")
    parts = mine.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    sizes = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), F.max(F.struct("n", "root", "shingles")).alias("main")).where(F.col("n") > F.col("main.n"))
    others = _blocks(F.col("n") - F.col("main.n"), F.col("shingles") - F.col("main.shingles"))
    sizes = materialize(sizes.select("bucket", "n", F.col("main.root").alias("main"), _blocks(F.col("n"), F.col("shingles")).alias("lefts"), others.alias("rights")), "large-sizes")
    placed = meet(mine, sizes, "bucket", total).withColumn("h", F.xxhash64("node"))
    left = placed.select("bucket", "node", F.pmod("h", "lefts").alias("l"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("r"), F.lit(True).alias("left"))
    right = placed.where(F.col("root") != F.col("main")).select("bucket", "node", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("l"), F.pmod("h", "rights").alias("r"), F.lit(False).alias("left"))
    both = left.unionByName(right)
    return both.select(F.xxhash64("bucket", F.col("l").cast("int"), F.col("r").cast("int")).alias("task"), "node", "left", (~F.col("left")).alias("right"))


def _compared(tasks: DataFrame, sets: DataFrame, roots: DataFrame, idf, threshold: float) -> DataFrame:
    """Links (a, b) found by comparing, in each task, all left nodes with all right ones.

    A task holds some 2 * BLOCK texts, or 2 * BLOCK_SHINGLES shingles, at most. One text is
    compared with a whole side at once through that side's sorted shingles. Links inside a component are not looked for,
    and of the others a spanning forest is returned: rows never grow with pairs.
    """

    def run(table: pa.Table) -> pa.Table:
        weigh = Idf(*idf.value, IDF_RARE)
        node, root, parent = table["node"].to_pylist(), table["root"].to_pylist(), {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        held = []
        for batch in table.select(["h", "many"]).to_batches(max_chunksize=256):
            for bytes_, many in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, tf = unpacked(bytes_, many)
                held.append((h, weigh.weights(h, tf)))
        first = [i for i, x in enumerate(table["left"].to_pylist()) if x]
        second = [i for i, x in enumerate(table["right"].to_pylist()) if x]
        out: list[tuple[int, int]] = []
        if first and second:
            against = Block([held[j] for j in second])
            for i in first:
                for j in np.flatnonzero(against.similarities(*held[i]) >= threshold):
                    a, b = find(root[i]), find(root[second[j]])
                    if a != b:
                        parent[a] = b
                        out.append((min(node[i], node[second[j]]), max(node[i], node[second[j]])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    rows = tasks.join(roots, "node", "left").join(sets.select("node", "h", "many"), "node").select("task", "node", F.coalesce("root", "node").alias("root"), "left", "right", "h", "many")
    return materialize(rows.groupBy("task").applyInArrow(run, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id, class_docs, is_representative.

    Documents are near-duplicates when the weighted Jaccard similarity of their 5-word
    shingles, weighted by TF times a smoothed IDF, is `threshold` or more; classes are the
    connected components of these links. class_id is the least doc_id of the class, class_docs its number of rows.

    Texts of fewer than 5 words are one shingle. Texts without words (null is empty) are
    alike only if they are equal. Repeated rows are copies of each other; with equal ids
    all of them are marked representative. Null ids give a null class_id only if the whole
    class has none, and then represent it. Other columns are ignored. An empty table gives
    no rows.
    """
    signed, texts = classes(docs, id_col, text_col, threshold)
    each = texts.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_docs"))
    named = materialize(texts.select("th", "root", "n").join(each, "root").select("th", "class_id", "class_docs", "n"), "named")
    total = named.agg(F.sum("n")).first()[0] or 0
    return meet(signed, named, "th", total).select(
        F.col("id").alias("doc_id"), "class_id", "class_docs", F.col("id").eqNullSafe(F.col("class_id")).alias("is_representative"),
    )


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs for each class of near_duplicates(), with the columns of docs.

    The row with the least id stays (of rows with that id, one with the least text hash);
    of repeated rows, one.
    """
    names = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    signed, texts = classes(docs, id_col, text_col, threshold)
    best = texts.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "th")).alias("x")).select(F.col("x.id").alias("__keep_id"), F.col("x.th").alias("__keep_th"))
    times = signed.groupBy(F.col("id").alias("__keep_id"), F.col("th").alias("__keep_th")).agg(F.count("*").alias("__keep_n"))
    same = F.col("b.__keep_id").eqNullSafe(F.col("t.__keep_id")) & (F.col("b.__keep_th") == F.col("t.__keep_th"))
    best = best.alias("b").join(times.alias("t"), same).select("b.__keep_id", "b.__keep_th", "__keep_n")
    best = materialize(best, "representatives")
    aside = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in names.items()])
    key = F.md5(F.coalesce(F.col(names[text_col]).cast("string"), F.lit("")))
    keyed = aside.withColumn("__th", key)
    on = keyed["__th"].eqNullSafe(best["__keep_th"]) & keyed[names[id_col]].cast("long").eqNullSafe(best["__keep_id"])
    kept = keyed.join(best, on)
    own = [F.col(a) for a in names.values()]
    out = kept.where(F.col("__keep_n") == 1).select(*own)
    if not best.where(F.col("__keep_n") > 1).isEmpty():
        out = out.union(kept.where(F.col("__keep_n") > 1).dropDuplicates(["__keep_id", "__keep_th"]).select(*own))
    return out.select(*[F.col(a).alias(c) for c, a in names.items()])

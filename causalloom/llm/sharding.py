"""K-d tree partitioning of documents into shards of near-equal bytes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, meet

#: A coordinate on the widest dimension has this many bits; ties below it fall to a hash of the text.
COORD_BITS, HASH_BITS, STEP_BITS = 20, 31, 13
#: At most this many bits of sums come to the driver in a round; at most so many leaves are made.
SUM_BITS, MOST_LEAVES = 20, 1 << 16
KEY_BITS = COORD_BITS + HASH_BITS
#: What shard() takes for piece_part: near-equal sizes need that no point weighs much of a shard.
PIECE_PART = 1 / 32
#: Rows numbered by one window task.
SLOT_ROWS = 200_000
DIMENSIONS = ["d_length", "d_source", "d_lang"]


@dataclass
class Node:
    """A part of the space that must hold `shards` shards, from number `first` on."""

    first: int
    shards: int


def _unit(x: Column, low: float, high: float) -> Column:
    """x on [0, 1]; null and constant columns at 0."""
    return F.coalesce((x - low) / (high - low), F.lit(0.0)) if high > low else F.lit(0.0)


def _key() -> Column:
    """Order on the dimension numbered `dim`, ties by a hash: an integer of KEY_BITS bits."""
    x = F.when(F.col("dim") == 0, F.col(DIMENSIONS[0])).when(F.col("dim") == 1, F.col(DIMENSIONS[1])).otherwise(F.col(DIMENSIONS[2]))
    cell = F.least(F.floor(x * (1 << COORD_BITS)), F.lit((1 << COORD_BITS) - 1)).cast("long")
    return F.shiftleft(cell, HASH_BITS) + F.col("tie")


def _small(frame: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A broadcast table of few integer rows (one or two a node, MOST_LEAVES at most), made in the engine from one literal."""
    columns = [c.split() for c in schema.split(", ")]
    text = ";".join(",".join(map(str, r)) for r in rows)
    one = frame.sparkSession.range(0, 1, 1, 1).select(F.explode(F.split(F.lit(text), ";")).alias("row"))
    return F.broadcast(one.select(*[F.get(F.split("row", ","), F.lit(k)).cast(kind).alias(name) for k, (name, kind) in enumerate(columns)]))


def _split_points(points: DataFrame, nodes: dict[int, Node]) -> dict[int, tuple[int, int]]:
    """For each node to split: the number of its widest dimension, and the weighted median's key.

    The median is found by histogram refinement: each round groups the weights of the
    one open cell of every node by its next bits, in one partial aggregation. The bits of
    a round are so few that at most 2^SUM_BITS sums come to the driver.
    """
    ids = [(i,) for i, n in nodes.items() if n.shards > 1]
    mine = points.join(_small(points, ids, "node int"), "node")
    spans = mine.groupBy("node").agg(F.sum("weight").alias("weight"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).collect()
    if not spans:
        return {}
    widest = {r["node"]: max(range(len(DIMENSIONS)), key=lambda k: (r[DIMENSIONS[k]], -k)) for r in spans}
    want = {r["node"]: r["weight"] * (nodes[r["node"]].shards // 2) / nodes[r["node"]].shards for r in spans}
    keyed = mine.join(_small(points, list(widest.items()), "node int, dim int"), "node").select("node", "weight", _key().alias("key"))
    prefix, below, shift = dict.fromkeys(widest, 0), dict.fromkeys(widest, 0), KEY_BITS
    bits = max(1, min(STEP_BITS, SUM_BITS - len(widest).bit_length()))
    while shift > 0:
        top, shift = shift, max(0, shift - bits)
        open_ = keyed.join(_small(points, list(prefix.items()), "node int, prefix long"), "node").where(F.shiftright("key", top) == F.col("prefix"))
        cells: dict[int, list[tuple[int, int]]] = {}
        for r in open_.groupBy("node", F.shiftright("key", shift).alias("cell")).agg(F.sum("weight").alias("weight")).collect():
            cells.setdefault(r["node"], []).append((r["cell"], r["weight"]))
        for i, mine_ in cells.items():
            last = 0
            for cell, weight in sorted(mine_):
                prefix[i], last = cell, weight
                if below[i] + weight >= want[i]:
                    break
                below[i] += weight
            else:
                below[i] -= last
            if shift == 0 and abs(below[i] + last - want[i]) < abs(want[i] - below[i]):
                prefix[i] += 1  # the cell at the median belongs to the lower side
    return {i: (widest[i], prefix[i]) for i in widest}


def _descend(frame: DataFrame, cuts: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """frame one level down: rows of a node that was cut move to its left or right child."""
    at = _small(frame, cuts, "node int, dim int, cut long, low int, high int")
    to = F.when(F.col("dim").isNull(), F.col("node")).when(_key() < F.col("cut"), F.col("low")).otherwise(F.col("high"))
    return frame.join(at, "node", "left").withColumn("node", to).drop("dim", "cut", "low", "high")


def shard(
    docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None, id_col: str = "doc_id",
    text_col: str = "text", length_col: str = "n_chars", source_col: str = "source", lang_col: str = "lang",
    piece_part: float | None = PIECE_PART,
) -> DataFrame:
    """Put every document into a shard; the law is `bytes`: shards have near-equal sizes.

    shards: the number of leaves (MOST_LEAVES at most), or None to derive it from target_bytes. Dimensions are
    length (logarithmic), source and language, each scaled to [0, 1]. A node splits at
    the weighted median (weight: bytes) along its widest dimension, again and again.
    Equal texts are one point, so they share a shard. The law cannot hold where a group of
    equal texts outweighs a shard, so one of over piece_part of a shard becomes several
    points of about that weight, dealt by a hash of text and id (null ids: of the row);
    with piece_part None every group stays whole and sizes are as near as groups let them.
    A document's shard depends on the documents alone, not on the table's partitions.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard, slot
    (0 up to the shard's rows less one, without gaps) and grown_shard (null under this
    law). A null text has no bytes: size 1, crc 0. Null metadata lie at 0 of their
    dimension; missing metadata columns are dimensions of width 0. Repeated rows each
    get a slot; null ids are allowed; an empty table gives no rows. Texts are read once
    and never shuffled; what is shuffled has a few numbers a document.
    """
    have = {c.lower() for c in docs.columns}

    def code(c: str) -> Column:
        return F.crc32(F.col(c).cast("string")).cast("double") / float(1 << 32) if c.lower() in have else F.lit(None).cast("double")

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    length = F.log2(F.greatest(F.col(length_col).cast("double"), F.lit(0.0)) + 1) if length_col.lower() in have else F.lit(None).cast("double")
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("same"), length.alias("d_length"), code(source_col).alias("d_source"), code(lang_col).alias("d_lang"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("size").alias("size"), F.count("*").alias("n"), *[f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)]).first()
    if not total["n"]:
        return rows.select(*_columns(F.lit(0), F.lit(0)))
    leaves = shards if shards is not None else max(1, -(-total["size"] // target_bytes))
    if leaves > MOST_LEAVES:
        raise ValueError(f"{leaves} shards are more than {MOST_LEAVES}")
    groups = rows.groupBy("same").agg(
        F.count("*").alias("n"), F.sum("size").alias("same_size"), F.min("d_length").alias("g_length"), F.min("d_source").alias("g_source"), F.min("d_lang").alias("g_lang"),
    )
    # Only repeated texts take their group's place; those of very many rows meet it by broadcast.
    groups = materialize(groups.where(F.col("n") > 1), "shard-repeated")
    placed = meet(rows, groups, "same", total["n"], "left")
    pieces = F.lit(1) if piece_part is None else F.coalesce(F.ceil(F.col("same_size") / max(1, int(total["size"] / leaves * piece_part))), F.lit(1))
    part = F.when(pieces > 1, F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("row").cast("string")), "same"), pieces)).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumn("part", part)
    for d in DIMENSIONS:
        low, high = total[f"min_{d}"] or 0.0, total[f"max_{d}"] or 0.0
        placed = placed.withColumn(d, _unit(F.when(F.col("n").isNull(), F.col(d)).otherwise(F.col(d.replace("d_", "g_"))), low, high))
    node = F.lit(0).alias("node")
    placed = materialize(
        placed.select("doc_id", "size", "text_crc32", "row", *DIMENSIONS, F.shiftrightunsigned(F.xxhash64("same", "part"), 64 - HASH_BITS).alias("tie"), node),
        "shard-points",
    )
    points = materialize(placed.groupBy("tie", *DIMENSIONS, "node").agg(F.sum("size").alias("weight")), "shard-groups")
    nodes, fresh, leaf = {0: Node(0, leaves)}, 1, {}
    dealt = placed
    while any(n.shards > 1 for n in nodes.values()):
        found = _split_points(points, nodes)
        after, cuts = {}, []
        for i, n in nodes.items():
            if i not in found:
                leaf[i] = n.first
                continue
            half = n.shards // 2
            cuts.append((i, *found[i], fresh, fresh + 1))
            after |= {fresh: Node(n.first, half), fresh + 1: Node(n.first + half, n.shards - half)}
            fresh += 2
        nodes = after
        if cuts:
            points, dealt = _descend(points, cuts), _descend(dealt, cuts)
    leaf |= {i: n.first for i, n in nodes.items()}
    dealt = dealt.join(_small(dealt, list(leaf.items()), "node int, shard int"), "node")
    buckets = max(1, -(-total["n"] // (SLOT_ROWS * leaves)), min(32, total["n"] // 256))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    dealt = materialize(dealt.select("doc_id", "size", "text_crc32", "row", "shard", "bucket"), "shard-dealt")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "bucket").orderBy("row")
    numbered = dealt.withColumn("place", F.row_number().over(order)).join(starts, ["shard", "bucket"])
    return numbered.select(*_columns(F.col("shard"), F.col("start") + F.col("place") - 1))


def _columns(shard_: Column, slot: Column) -> list[Column]:
    return [
        F.col("doc_id"), F.col("size"), F.col("text_crc32"), F.lit("bytes").alias("law"),
        shard_.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    ]

"""Exact top-k by inner product, found by distributed histogram selection."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Queries held by every task at a time, and cells of a query's histogram.
QUERY_BLOCK, CELLS = 2048, 128


@dataclass
class Queries:
    """A block of queries and the open score range [low, high) of each; `above` scores lie at high or over."""

    ids: np.ndarray
    vectors: list[np.ndarray]
    low: np.ndarray
    high: np.ndarray
    above: np.ndarray
    exact: type

    def by_length(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        out: dict[int, list[int]] = {}
        for i, v in enumerate(self.vectors):
            out.setdefault(len(v), []).append(i)
        return {n: (np.array(at), np.array([self.vectors[i] for i in at], self.exact).reshape(len(at), n)) for n, at in out.items()}


def _blocks(batch: pa.RecordBatch, groups: dict[int, tuple[np.ndarray, np.ndarray]], q: Queries) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For candidates of each length: the queries' numbers, the candidates' ids, and all scores (queries x candidates)."""
    ids, lists = batch.column(0).to_numpy(), batch.column(1)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    for n in np.unique(sizes):
        if int(n) not in groups:
            continue
        at, matrix = groups[int(n)]
        rows = np.flatnonzero(sizes == n)
        cand = flat[(starts[rows][:, None] + np.arange(n)[None, :])].astype(q.exact)
        for lo in range(0, len(rows), 4096):
            part = ids[rows[lo : lo + 4096]]
            yield at, part, matrix @ cand[lo : lo + 4096].T


def _histogram(q: Queries):
    """Task: counts of scores by cell of each query's open range."""
    width = -(-(q.high - q.low) // CELLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, groups = np.zeros(len(q.ids) * CELLS, np.int64), q.by_length()
        for batch in batches:
            for at, ids, scores in _blocks(batch, groups, q):
                low, high, step = (x[at][:, None].astype(q.exact) for x in (q.low, q.high, width))
                mine = (scores >= low) & (scores < high) & (ids[None, :] != q.ids[at][:, None])
                row, col = np.nonzero(mine)
                cell = ((scores[row, col] - low[row, 0]) // step[row, 0]).astype(np.int64)
                counts += np.bincount(at[row] * CELLS + cell, minlength=len(counts))
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(hit // CELLS, pa.int32()), pa.array(hit % CELLS, pa.int32()), pa.array(counts[hit], pa.int64())], ["query", "cell", "n"])

    return run, width


def _best(k: int, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each query by falling score, then rising id."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.flatnonzero(np.diff(query, prepend=-1))
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return query[rank < k], ids[rank < k], scores[rank < k]


def _select(q: Queries, k: int):
    """Task: of the scores at or over each query's kth value, the task's own k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        groups = q.by_length()
        for batch in batches:
            for at, ids, scores in _blocks(batch, groups, q):
                mine = (scores >= q.low[at][:, None].astype(q.exact)) & (ids[None, :] != q.ids[at][:, None])
                row, col = np.nonzero(mine)
                new = (at[row], ids[col], scores[row, col].astype(np.int64))
                kept = _best(k, *(np.concatenate(x) for x in zip(kept, new, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(q.ids[kept[0]], pa.int64()), pa.array(kept[1], pa.int64()), pa.array(kept[2], pa.int64())], ["query_id", "vec_id", "score"])

    return run


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, v) of every row: components as floor(scale * x); vectors with null or non-finite parts are left out."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(v.isNotNull() & F.col(id_col).isNotNull()).where(F.coalesce(sound, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def top_k(
    vectors: DataFrame, k: int = 5, is_query: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The k highest integer inner products of every query row over all other rows.

    Queries (default: vec_id divisible by 50) come in blocks of query_block at most, so
    what is broadcast has a fixed size. For a block every pass scores all candidates: the
    first passes count scores by cell of each query's open range and narrow that range to
    the cell with the kth value, until it holds one value or just what is wanted; the last
    pass keeps scores at or over it. Ties go to the smaller vec_id. Tasks send histograms
    and their own k best, never more.

    Returns query_id, rank (from 1), vec_id, score. Null ids, and vectors that are null or
    hold a null or a non-finite component, take no part. Repeated rows are candidates as often
    as they come, but ask once; a row never matches its own id; vectors of another length don't match. A query
    with fewer than k candidates gets them all. Scores must fit 64 bits. An empty table
    gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score long"
    rows = materialize(integer_vectors(vectors, id_col, vector_col), "vectors")
    queries = rows.where(F.col("vec_id") % 50 == 0 if is_query is None else is_query).distinct()
    square = F.aggregate(F.transform("v", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    longest = math.sqrt(rows.agg(F.max(square)).first()[0] or 0.0)
    n = queries.count()
    parts = 1 if n <= query_block else -(-2 * n // query_block)
    found = None
    for p in range(parts if n else 0):
        mine = (queries if parts == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == p)).orderBy("vec_id").collect()
        if not mine:
            continue
        vs = [np.array(r["v"], np.int64) for r in mine]
        bound = [math.ceil(float(np.linalg.norm(v.astype(float))) * longest * (1 + 1e-9)) + 1 for v in vs]
        if max(bound) >= 1 << 62:
            raise ValueError("scores exceed 64 bits")
        exact = np.float64 if max(bound) < 1 << 52 else object
        q = Queries(np.array([r["vec_id"] for r in mine], np.int64), vs, -np.array(bound, np.int64), np.array(bound, np.int64) + 1, np.zeros(len(mine), np.int64), exact)
        open_ = np.ones(len(mine), bool)
        while open_.any():
            task, width = _histogram(_only(q, open_))
            at = np.flatnonzero(open_)
            sums = rows.mapInArrow(task, "query int, cell int, n long").groupBy("query", "cell").agg(F.sum("n").alias("n")).collect()
            cells: dict[int, list[tuple[int, int]]] = {}
            for r in sums:
                cells.setdefault(r["query"], []).append((r["cell"], r["n"]))
            for j, i in enumerate(at):
                open_[i] = False
                for cell, count in sorted(cells.get(j, []), reverse=True):
                    if q.above[i] + count >= k:
                        low = int(q.low[i]) + cell * int(width[j])
                        high = min(int(q.high[i]), low + int(width[j]))
                        q.low[i], q.high[i] = low, high
                        open_[i] = high - low > 1 and q.above[i] + count > k
                        break
                    q.above[i] += count
        part = rows.mapInArrow(_select(q, k), schema)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        part = part.withColumn("rank", rank).where(F.col("rank") <= k)
        part = materialize(part, "top-k") if parts > 1 else part
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema).withColumn("rank", F.lit(0))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _only(q: Queries, keep: np.ndarray) -> Queries:
    at = np.flatnonzero(keep)
    return Queries(q.ids[at], [q.vectors[i] for i in at], q.low[at], q.high[at], q.above[at], q.exact)

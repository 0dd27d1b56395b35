"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates are taken in blocks; a block keeps, for each dimension, its vectors
sorted by that component.  A query reads all its lists from the favourable end,
in steps, scores what it meets in full, and stops once its k-th result is above
what any vector further down the lists could reach.  The k-th result is carried
from block to block in a task, so later blocks start with a bound.  Each task
sends k results a query, and these are merged.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, pick, prepare

SCALE = 1024.0
BLOCK = 8192


LEAST, MOST = -(1 << 63), (1 << 63) - 1


def integers(vector: list[float | None] | None) -> np.ndarray | None:
    """floor(1024 * x) of each component, or None if any is null or not finite.

    What 1024 times a component can't be as a double counts as the largest double.
    """
    if vector is None or any(x is None for x in vector):
        return None
    x = np.array(vector, dtype=np.float64)
    if not np.isfinite(x).all():
        return None
    most = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * x), -most, most)


def _held(score: int) -> int:
    """A score as a 64-bit integer: the nearest one, where it is beyond them."""
    return max(LEAST, min(MOST, score))


class Lists:
    """A block of vectors of one length, with its sorted lists."""

    def __init__(self, ids: list[int], vectors: list[np.ndarray]):
        self.ids = np.array(ids, dtype=np.int64)
        self.x = np.array(vectors, dtype=np.float64).reshape(len(ids), -1)
        self.order = np.argsort(self.x, axis=0, kind="stable").T if len(ids) else np.zeros((0, 0), np.int64)
        self.largest = float(np.abs(self.x).max(initial=0))
        #: The longest vector, rounded up so that a bound from it holds.
        self.length = float(np.sqrt((self.x**2).sum(1).max(initial=0))) * (1 + 1e-9) if self.largest < 1e150 else np.inf
        #: How many of the vectors the last search scored.
        self.scored = 0

    def bound(self, q: np.ndarray, up: np.ndarray, down: np.ndarray, depth: int) -> int:
        """What a vector not met so far can reach at most.

        Its components are no better than those where the lists stand, and its
        length is no more than the longest one's: with components held to the
        lists' where that is what limits them, the rest of the length goes along
        the query.
        """
        n = len(self.ids)
        weights = np.concatenate([-q[up], q[down]])
        caps = np.concatenate([-self.x[self.order[up, depth], up], self.x[self.order[down, n - 1 - depth], down]])
        listed = sum(int(a) * int(b) for a, b in zip(weights, caps))
        if not np.isfinite(self.length) or self.largest * float(weights.max(initial=0)) >= 1e150:
            return listed
        # the components whose caps lie furthest below a vector along the query are held to them; the
        # sum is concave, so that is the most if it still rises toward the caps of all that are held
        ratio = caps / weights
        order = np.argsort(ratio, kind="stable")
        w, c, ratio = weights[order], caps[order], ratio[order]
        held, left = np.concatenate([[0.0], np.cumsum(w * c)]), self.length**2 - np.concatenate([[0.0], np.cumsum(c**2)])
        rest = np.concatenate([np.cumsum((w**2)[::-1])[::-1], [0.0]])
        along = np.sqrt(np.maximum(left[:-1], 0.0) / rest[:-1])
        valid = (left[:-1] >= 0) & (np.concatenate([[-np.inf], ratio[:-1]]) <= along)
        most = (held[:-1] + along * rest[:-1])[valid].min(initial=np.inf)
        slack = 1 + 1e-9 * self.length * float(np.sqrt(rest[0]))
        return min(listed, int(np.ceil(most + slack))) if np.isfinite(most) else listed

    def exact(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Integer inner products; whole numbers below 2**53 are exact as doubles."""
        if len(q) and float(np.abs(q).max(initial=0)) * self.largest * len(q) >= 2.0**53:
            return np.array([_held(sum(int(a) * int(b) for a, b in zip(self.x[r], q))) for r in rows], dtype=object)
        return self.x[rows] @ q

    def search(self, q: np.ndarray, own: int, k: int, best: list[tuple]) -> list[tuple]:
        """Merge this block's results into ``best``, (-score, id) in ascending order."""
        n = len(self.ids)
        dims = np.nonzero(q)[0]
        seen = np.zeros(n, bool)
        depth, step = 0, 16
        up, down = dims[q[dims] < 0], dims[q[dims] > 0]
        while depth < n:
            # what a vector not met so far can reach at most
            if len(best) == k and len(dims) and -best[-1][0] > _held(self.bound(q, up, down, depth)):
                break
            end = min(n, depth + step) if len(dims) else n
            met = np.zeros(n, bool)
            if len(dims):
                met[self.order[up, depth:end].ravel()] = True
                met[self.order[down, n - end : n - depth].ravel()] = True
            else:
                met[:] = True
            rows = np.nonzero(met & ~seen)[0]
            seen |= met
            if len(rows):
                score = self.exact(rows, q)
                if len(best) == k:
                    worth = score >= -best[-1][0]
                    rows, score = rows[worth], score[worth]
                elif score.dtype != object and len(rows) > 8 * k:
                    ids = self.ids[rows]
                    worth = np.lexsort((ids, -score))[: 8 * k]
                    if len(np.unique(ids[worth])) > k:
                        rows, score = rows[worth], score[worth]
                found = {(-int(s), int(i)) for s, i in zip(score, self.ids[rows]) if i != own}
                merged: dict[int, tuple] = {}
                for x in sorted(found | set(best)):
                    merged.setdefault(x[1], x)
                best = list(merged.values())[:k]
            depth, step = end, 2 * step
            if seen.all():
                break
        self.scored = int(seen.sum())
        return best


def _search(queries, k: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for i, q in queries.value:
            asked[len(q)].append((i, q))
        best: dict[int, list[tuple]] = {i: [] for i, _ in queries.value}
        held: dict[int, tuple[list, list]] = {}

        def search(size: int) -> None:
            block = Lists(*held.pop(size))
            for i, q in asked[size]:
                best[i] = block.search(q, i, k, best[i])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = integers(v) if i is not None else None
                if x is not None and len(x) in asked:
                    ids, vectors = held.setdefault(len(x), ([], []))
                    ids.append(i)
                    vectors.append(x)
                    if len(ids) == BLOCK:
                        search(len(x))
        for size in list(held):
            search(size)
        rows = [(i, j, -s) for i, found in best.items() for s, j in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], []))], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block_queries: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of ``vectors`` for each row of ``queries``.

    Components count as floor(1024 * x); ties go to the smaller id; vectors with
    a query's own id aren't among its results; a score beyond 64 bits counts as
    the nearest 64-bit integer.  Queries are taken
    ``block_queries`` at a time, each block against all vectors.

    Rows with a null id or vector, or with a null or non-finite component, take
    no part; vectors of another length than a query's aren't its candidates; an
    id that comes again counts once (its best score), as a query by its first
    vector in order; without rows there are no results.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = pick(vectors, vec_id=id_col, v=vector_col).select(F.col("vec_id").cast("long"), "v")
    asked = pick(queries, vec_id=id_col, v=vector_col).select(F.col("vec_id").cast("long"), "v").where("vec_id is not null and v is not null")
    asked = asked.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // block_queries))
    out = None
    for b in range(blocks):
        part = [(r["vec_id"], integers(r["v"])) for r in asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()]
        sent = spark.sparkContext.broadcast([(i, x) for i, x in part if x is not None])
        found = rows.mapInArrow(_search(sent, k), "query_id long, vec_id long, score long")
        out = found if out is None else out.union(found)
    best = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)
), r as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s
)
select query_id, cast(rank as integer) as rank, vec_id, cast(score as bigint) as score from r where rank <= 10
"""

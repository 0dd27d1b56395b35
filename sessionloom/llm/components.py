"""Connected components of a table of links, by alternating stars over local forests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, lean, staged

#: Links that a task closes at a time.
CHUNK = 1 << 20
#: Links for a task, where there are more than the cluster has cores for.
SHARE = 1 << 17
_FOREST = "u long, v long, new boolean"


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in links (u, v) and for each the least id that these links reach."""
    ids, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, up = code[: len(u)], code[len(u) :], np.arange(len(ids))
    while True:
        x, y = up[u], up[v]
        apart = x != y
        if not apart.any():
            return ids, ids[up]
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]


@lean
def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each id but a least one, with the least id that it reaches over a chunk of links.

    ``new`` are those that no link of the chunk began with.  Where links come in
    the order of ``u``, those of one ``u`` are all in one chunk.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def closed(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        ids, least = roots(u, v)
        below = ids != least
        return pa.RecordBatch.from_arrays([pa.array(ids[below]), pa.array(least[below]), pa.array(~np.isin(ids[below], u))], ["u", "v", "new"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        count += batch.num_rows
        if count >= CHUNK:
            u, v = (np.concatenate(x) for x in zip(*held))
            last = u == u[-1]
            held, count = [(u[last], v[last])], int(last.sum())
            if not last.all():
                yield closed(u[~last], v[~last])
    if count:
        yield closed(*(np.concatenate(x) for x in zip(*held)))


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of every id in ``links`` (a, b): the least id that can be reached.

    Each task closes the links that it holds, so that what is shuffled is a
    forest.  A round brings the links of a node together, which ties all that
    the node is linked with to the least of them, and then links every node to
    the least that the other end of its link has.  It ends when all nodes have
    one link, to a node that has none; that takes a logarithmic number of rounds
    at most, and one or two where tasks hold much of a component.  A node is in
    at most one link from each task before it, so none has very many; joins on a
    centre with very many are broadcast or split by adaptive execution.  Links
    stay distributed and each round is written to the shared folder, by tasks
    that have some :data:`SHARE` links each rather than by as many as a shuffle
    has.  ``links`` are read twice and should be a stored table.
    """
    n = max(links.sparkSession.sparkContext.defaultParallelism, links.count() // SHARE)
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").mapInArrow(_forest, _FOREST)
    before = None
    while True:
        trees = staged(edges.select("u", "v").repartition("u").coalesce(n).sortWithinPartitions("u").mapInArrow(_forest, _FOREST), "trees")
        if before:
            drop(before)
        new = bool(trees.agg(F.max("new")).first()[0])
        above = trees.groupBy("u").agg(F.min("v").alias("m")) if new else trees.select("u", F.col("v").alias("m"))
        jumped = trees.join(above.withColumnRenamed("u", "v"), "v", "left")
        before = edges = staged(jumped.select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved")).coalesce(n), "links")
        drop(trees)
        if not new and not edges.agg(F.max("moved")).first()[0]:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct().coalesce(n))

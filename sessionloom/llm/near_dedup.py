"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of composite hashes (each of a few minhashes) give the
keys of many tables: table (i, j) has the pair of the i-th of the first and the
j-th of the second.  A pair of documents meets in some table if it agrees
somewhere in both collections, so 2 * 26 composites do the work of 26 * 26
tables and the minhashes needed fall to about the square root.  A composite that
only one document has can't make any pair meet, and is dropped before pairs of
composites are formed.

Documents with equal shingle sets are one class from the start.  In a bucket
each class is compared with the bucket's least class, its hub, first; the links
found join classes into components.  Buckets that still hold several components are
then known by their hubs alone: two classes that share such a bucket share its
hub, so what has a hub in common is a superset of what shares a bucket, with one
row for a hub and class in place of one for each of the hundreds of tables in
which close copies meet.  Each member's shingles that any other such member has
bound what it can share with anyone (an edited copy's own shingles match
nothing).  What the bounds leave is compared in full by tiles of sets, members
outside the largest component of those that hubs tie together against all of
them, so a large group of near copies costs about one comparison a member.
Every link is confirmed on full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_index, drop, lean, pick, prepare, row_columns, staged, with_row
from .components import components
from .words import mix, shingles

ROWS, COMPOSITES = 4, 26
SIZE = 5
NUMERATOR, DENOMINATOR = 75, 100
_COUNT = 2 * ROWS * COMPOSITES
_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 1 << 32, _COUNT, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, _COUNT, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SIDE = (np.arange(2 * COMPOSITES, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
#: Of the minhashes, how many must agree for a pair to be compared in full: 4.5 standard deviations below what the threshold lets expect.
LEAST_AGREEING = int(_COUNT * 0.75 - 4.5 * (_COUNT * 0.75 * 0.25) ** 0.5)
_SIGNED = "doc_id long, n_shingles long, digest binary, halves array<long>, sketch binary"


def minhashes(s: np.ndarray) -> np.ndarray:
    """The minhashes of a non-empty set of 64-bit shingles."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(_COUNT, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 512):
        np.minimum(out, ((low[k : k + 512, None] ^ _XOR) * _MUL).min(0), out=out)
    return out


def halves(m: np.ndarray) -> np.ndarray:
    """The composite hashes: first collection, then second."""
    rows = m.reshape(2 * COMPOSITES, ROWS).astype(np.uint64)
    total = _SIDE.copy()
    for k in range(ROWS):
        total = mix(total + rows[:, k])
    return total.view(np.int64)


@lean
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, keys, sketches = [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text, SIZE)
            sizes.append(len(s))
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            m = minhashes(s) if len(s) else None
            keys.append(None if m is None else halves(m))
            sketches.append(None if m is None else m.astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
            ["doc_id", "n_shingles", "digest", "halves", "sketch"],
        )


@lean
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(x, SIZE).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], ["id", "s"])


@lean
def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose sketches leave the threshold possible, with the number of agreeing minhashes."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, _COUNT) for k in (2, 3))
            n = (x == y).sum(1)
            keep = pa.array(n >= LEAST_AGREEING)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int32))], ["a", "b", "n"]).filter(keep)


@lean
def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(DENOMINATOR * both >= NUMERATOR * (len(s) + len(t) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _buckets(reps: DataFrame) -> DataFrame:
    """``key, a, id``: the tables' buckets that hold several classes ``id``, each with its least one, the hub ``a``."""
    single = reps.select("id", F.posexplode("halves").alias("k", "h"))
    shared = single.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    left = single.join(shared, "h").groupBy("id").agg(
        F.collect_list(F.when(F.col("k") < COMPOSITES, F.col("h"))).alias("first"), F.collect_list(F.when(F.col("k") >= COMPOSITES, F.col("h"))).alias("second")
    )
    pairs = F.flatten(F.transform("first", lambda a: F.transform(F.col("second"), lambda b: F.xxhash64(a, b))))
    keys = staged(left.select("id", F.explode(pairs).alias("key")), "buckets")
    several = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a")).where("n > 1").select("key", "a")
    out = staged(keys.join(several, "key").select("key", "a", "id"), "shared-buckets")
    drop(keys)
    return out


def _sketched(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs worth comparing in full, with how many minhashes agree."""
    x = reps.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    y = reps.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    joined = pairs.join(x, "a").join(y, "b").where((DENOMINATOR * F.least("na", "nb") >= NUMERATOR * F.greatest("na", "nb")))
    return joined.select("a", "b", "sa", "sb").mapInArrow(_alike, "a long, b long, n int")


def _full(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    x, y = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(_confirm, "a long, b long")


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs with the components ``ca`` and ``cb`` of their ends."""
    x, y = labels.select(F.col("id").alias("a"), F.col("component").alias("ca")), labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    return pairs.join(x, "a", "left").join(y, "b", "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})


def _files(table: DataFrame) -> int:
    """In how many files to write what is no larger than a stored table: as many as there are tasks to read it, which may be far fewer than a shuffle's."""
    return max(table.sparkSession.sparkContext.defaultParallelism, table.rdd.getNumPartitions())


def _mixed(members: DataFrame, by: str, files: int) -> DataFrame:
    """``a, id, c``: the members ``id`` of what holds, ``by`` its column, several components ``c``."""
    mixed = members.groupBy(by).agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select(by)
    return staged(members.join(mixed, by).select("a", "id", "c").distinct().coalesce(files), "mixed")


@lean
def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            h = np.frombuffer(s, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i, np.int64)), pa.array(h)], ["id", "h"])


def _shared(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """``id, n, s``: how many of the ``n`` shingles of each set any other of the sets has, where a link is possible at all.

    Two sets share at most the lesser ``s``, so those where that is too little
    for any partner are left out.
    """
    spread = sets.select("id", "s").mapInArrow(_spread, "id long, h long")
    several = spread.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h")
    counts = spread.join(several, "h").groupBy("id").agg(F.count(F.lit(1)).alias("s"))
    sizes = reps.groupBy("id").agg(F.max("n_shingles").alias("n"))
    return counts.join(sizes, "id").where(DENOMINATOR * F.col("s") >= NUMERATOR * F.col("n")).select("id", "n", "s")


def _within_families(member: DataFrame, sets: DataFrame) -> DataFrame:
    """Links across components among members that share hubs, directly or through others.

    A family is dealt out as tiles of about :data:`TILE` sets: those outside its
    largest component against all.  A task holds two tiles; sets are sent once
    for each tile on the other side, and no pairs are formed outside a tile.
    """
    # a hub's own number may be that of a member: the two are one node, which only makes a family larger
    ties = member.where("id <> a").select("a", F.col("id").alias("b"))
    families = staged(components(ties), "families")
    own = member.groupBy("id").agg(F.min("c").alias("c")).join(families.select("id", F.col("component").alias("f")), "id")
    own = staged(own.coalesce(_files(member)), "family-members")
    sizes = own.groupBy("f", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("f").agg(F.sum("n").alias("n"), F.max(F.struct("n", "c")).alias("x"))
    several = sizes.where(F.col("n") > F.col("x.n")).select("f", F.col("x.c").alias("large"), _tiles(F.col("n")).alias("right"), _tiles(F.col("n") - F.col("x.n")).alias("left"))
    placed = own.join(several, "f").join(sets, "id").withColumn("h", F.xxhash64("id"))

    def dealt(rows: DataFrame, side: int, here: str, there: str) -> DataFrame:
        tile, others = F.pmod("h", here).cast("int").alias("t"), F.explode(F.sequence(F.lit(0), F.col(there) - 1)).alias("o")
        out = rows.select("f", tile, others, "id", "c", "s")
        return out.select("f", F.lit(side).alias("side"), *((F.col("t").alias("i"), F.col("o").alias("j")) if side == 0 else (F.col("o").alias("i"), F.col("t").alias("j"))), "id", "c", "s")

    both = dealt(placed.where("c <> large"), 0, "left", "right").union(dealt(placed, 1, "right", "left"))
    group = ("f", "i", "j")
    return both.repartition(*group).sortWithinPartitions(*group, "side").select(*group, "side", "id", "c", "s").mapInArrow(_tile_links, "a long, b long").distinct()


#: Sets in a tile.
TILE = 128


def _tiles(n):
    return F.greatest(F.lit(1), F.ceil(n / TILE)).cast("int")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over a stretch of shingles at a time."""
    every = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    _, code, count = np.unique(every, return_inverse=True, return_counts=True)
    keep = count[code] > 1
    code, row = np.unique(code[keep], return_inverse=True)[1], row[keep]
    out = np.zeros((len(left), len(right)), np.float32)
    for k in range(0, int(code.max(initial=-1)) + 1, 4096):
        a, b = np.searchsorted(code, (k, k + 4096))
        ones = np.zeros((len(left) + len(right), 4096), np.float32)
        ones[row[a:b], code[a:b] - k] = 1
        out += ones[: len(left)] @ ones[len(left) :].T
    return out.astype(np.int64)


@lean
def _tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each left set, a link to every other component that has one in the right tile."""
    sides: list[list[tuple[int, int, np.ndarray]]] = [[], []]
    at: tuple | None = None

    def done() -> pa.RecordBatch:
        (left, right), found = sides, []
        if left and right:
            both = _overlaps([x[2] for x in left], [x[2] for x in right])
            n, m = (np.array([len(x[2]) for x in side]) for side in sides)
            c, d = (np.array([x[1] for x in side]) for side in sides)
            linked = (DENOMINATOR * both >= NUMERATOR * (n[:, None] + m[None, :] - both)) & (c[:, None] != d[None, :])
            for k in np.nonzero(linked.any(1))[0]:
                _, first = np.unique(d[linked[k]], return_index=True)
                found += [(left[k][0], right[j][0]) for j in np.nonzero(linked[k])[0][first]]
        for side in sides:
            side.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[e] for x in found], pa.int64()) for e in (0, 1)], ["a", "b"])

    for batch in batches:
        for *group, side, i, c, s in zip(*(batch.column(k).to_pylist() for k in range(7))):
            if at is not None and at != group:
                yield done()
            at = group
            sides[side].append((i, c, np.frombuffer(s, np.uint64)))
    if at is not None:
        yield done()


def duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Two documents are linked if their sets of five-word shingles have a Jaccard
    similarity of 0.75 or more; ``component_id`` is the least id reachable.

    A null or empty text has no shingles and is linked with nothing, not even
    with another such text.  Rows that repeat an id are one document: whatever
    any of its texts is linked with is one component, which all its rows have.
    A row with a null id can't be named by a link: its component is null and it
    is kept.  No rows give an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    signed = staged(rows.mapInArrow(_sign, _SIGNED), "signatures")
    named = signed.where("doc_id is not null and n_shingles > 0")
    # the least document of each class of equal sets; minima are taken before the shuffle
    few = _files(signed)
    classes = staged(named.groupBy("digest").agg(F.min("doc_id").alias("id")).coalesce(few), "classes")
    reps = named.join(classes, (named.digest == classes.digest) & (named.doc_id == classes.id)).select("id", "n_shingles", "halves", "sketch")
    reps = staged(reps.dropDuplicates(["id", "sketch"]).coalesce(few), "representatives")

    buckets = _buckets(reps)
    stars = staged(_sketched(buckets.where("a <> id").select("a", F.col("id").alias("b")).distinct(), reps).coalesce(few), "stars")
    met = buckets.select("id").distinct()
    sets = staged(rows.join(met, rows.doc_id == met.id, "left_semi").select("doc_id", "text").mapInArrow(_sets, "id long, s binary").dropDuplicates(["id", "s"]), "sets")
    # the likeliest link of each class first, then those that still join two components
    likely = stars.groupBy("b").agg(F.max(F.struct("n", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    links = staged(_full(likely, sets), "links-likely")
    labels = staged(components(links), "labels")
    more = _labelled(stars, labels).where("ca <> cb").join(likely, ["a", "b"], "left_anti")
    more = staged(_full(more, sets), "links-stars")
    if not more.isEmpty():
        links = links.union(more)
        labels = staged(components(links), "labels")
    # what else shares a bucket across components
    named_components = labels.select("id", F.col("component").alias("c"))
    member = _mixed(buckets.join(named_components, "id", "left").withColumn("c", F.coalesce("c", "id")), "key", few)
    drop(buckets)
    shared = _shared(sets.join(member.select("id").distinct(), "id", "left_semi"), reps)
    member = _mixed(member.join(shared, "id", "left_semi"), "a", few)
    found = staged(_within_families(member, sets), "links-rest")
    if not found.isEmpty():
        labels = staged(components(links.union(found)), "labels")
    for table in (sets, stars, member, reps):
        drop(table)

    by_class = classes.join(labels, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    every = signed.select("doc_id", "n_shingles", "digest").join(by_class, "digest", "left").drop("digest")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    # an id with several texts is one document: their components are one
    repeated = every.where("doc_id is not null").groupBy("doc_id").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("component").alias("k"), F.count(F.lit(1)).alias("n"))
    repeated = staged(repeated.where("lo <> hi or (k > 0 and k < n)").select("doc_id", "lo").coalesce(few), "repeated")
    if not repeated.isEmpty():
        every = staged(every.join(repeated, "doc_id", "left"), "every")
        ties = every.where("component <> lo").select(F.col("lo").alias("a"), F.col("component").alias("b"))
        merged = staged(components(ties), "merged").select(F.col("id").alias("of"), F.col("component").alias("least"))
        own = F.coalesce("component", "lo", "doc_id")
        every = every.withColumn("of", own).join(merged, "of", "left").select("doc_id", "n_shingles", F.coalesce("least", "of").alias("component"))
    return every.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of one document of each component (that with the least id).

    Rows without words, and rows with a null id, stay; of rows that repeat the
    least id all stay; an empty table stays empty.
    """
    kept = duplicate_components(docs, id_col, text_col)
    out = staged(kept.where(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct(), "dropped")
    column_index(docs, id_col)
    carried = with_row(docs, id=id_col)
    return row_columns(carried.join(out, "id", "left_anti"), docs)


def query(spark, sf_dir: str) -> DataFrame:
    return duplicate_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with recursive t as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents where doc_id is not null and text is not null
), g as (
  select distinct doc_id, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g
  from t where len(w) > 0
), c as (select doc_id, count(*) as k from g group by doc_id
), pair as (select x.doc_id as a, y.doc_id as b, count(*) as k from g x join g y on x.g = y.g and x.doc_id < y.doc_id group by all
), links as (
  select pair.a, pair.b from pair join c x on x.doc_id = pair.a join c y on y.doc_id = pair.b where 100 * pair.k >= 75 * (x.k + y.k - pair.k)
), e as (select a, b from links union all select b, a from links
), r(id, reached) as (select doc_id, doc_id from c union select r.id, e.b from r join e on r.reached = e.a
), m as (select id, min(reached) as component from r group by id)
select d.doc_id, coalesce(c.k, 0) as n_shingles, coalesce(m.component, d.doc_id) as component_id, d.doc_id = coalesce(m.component, d.doc_id) as kept
from documents d left join c on c.doc_id = d.doc_id left join m on m.id = d.doc_id
"""

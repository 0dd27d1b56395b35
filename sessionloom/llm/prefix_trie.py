"""A trie of conversations' shared beginnings, rolled up by pointer jumping.

A node is a distinct sequence of first turns.  Its key is a sum of digests, one
for each turn at its depth, so a running sum gives the keys of all prefixes of a
conversation and the edge to the parent is a subtraction.  What subtrees add up
to takes a logarithmic number of rounds: in each, a node adds to the ancestor
its pointer leads to what it has gathered, and the pointer then leads twice as far.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.running import CHUNK, chunked, totals, within
from .common import lean, pick, prepare, staged

#: Turns of a conversation that one window takes, and ends of a node that one list takes.
STRETCH = 4096
KEY = "decimal(38,0)"
_HALF = 44
EMPTY = hashlib.sha256(b"").hexdigest()


def _words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long")


def _element(digest: Column, depth: Column) -> Column:
    """88 bits that a turn adds to the key of its prefix."""
    low = (1 << _HALF) - 1

    def bits(salt: str) -> Column:
        return F.xxhash64(F.lit(salt), digest, depth).bitwiseAND(F.lit(low)).cast("decimal(15,0)")

    return (bits("high") * F.lit(1 << _HALF).cast("decimal(15,0)") + bits("low")).cast(KEY)


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns with ``chunk`` and their place in it, stretches of conversations with what lies before them).

    Turns go by ``turn`` (null first), and those alike by a digest of role and
    text; ranges of that order are dealt out, so one conversation of very many
    turns is spread.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    small = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", digest.alias("digest"), _words(text).alias("words"))
    rows = chunked(small, ("conv_id",), ("turn", "digest"), lambda x: staged(x, "turns"))
    placed = rows.withColumn("nth", F.row_number().over(within(("conv_id",), F.col("turn").asc_nulls_first(), "digest")))
    return placed, totals(rows, ("conv_id",), n=F.count(F.lit(1)))


def rebuilt(turns: DataFrame, family: int = 20, shared: int = 4) -> tuple[DataFrame, DataFrame]:
    """(``conv_id, depth, element, words, last``: turns of rebuilt conversations, ``conv_id, length``: every conversation).

    A conversation takes its first ``h`` turns from that of the smallest id of
    its family, and its own after the first ``h``; ``h`` comes from its id.
    """
    placed, stretches = numbered(turns)
    base = F.col("conv_id") - F.col("conv_id") % family
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared
    stretches = staged(stretches.select("conv_id", CHUNK, base.alias("base"), h.alias("h"), "n_before", "n_all"), "stretches")
    convs = stretches.where("n_before = 0").select("conv_id", "base", "h", "n_all")
    sizes = convs.where("conv_id = base").select("base", F.col("n_all").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    length = F.col("taken") + F.greatest(F.col("n_all") - F.col("h"), F.lit(0))
    known = stretches.join(sizes, "base", "left").withColumn("taken", taken).withColumn("length", length)
    whole = staged(known.where("n_before = 0").select("conv_id", "base", "taken", "length"), "conversations")
    own = placed.join(known.drop("base"), ["conv_id", CHUNK]).withColumn("at", F.col("n_before") + F.col("nth"))
    heads = own.where(f"conv_id % {family} = 0 and at < {shared}").select(F.col("conv_id").alias("base"), "at", "digest", "words")
    kept = own.where("at > h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("depth"), "digest", "words", "length")
    lent = whole.where("taken > 0").join(heads, "base").where("at <= taken").select("conv_id", F.col("at").alias("depth"), "digest", "words", "length")
    every = kept.union(lent)
    rows = every.select("conv_id", "depth", _element(F.col("digest"), F.col("depth")).alias("element"), "words", (F.col("depth") == F.col("length")).alias("last"))
    return rows, whole.select("conv_id", "length")


def prefixes(rows: DataFrame) -> DataFrame:
    """``key`` and ``parent`` of the prefix that ends at each turn: running sums over stretches of a conversation."""
    rows = staged(rows.withColumn(CHUNK, F.floor((F.col("depth") - 1) / STRETCH).cast("int")), "rebuilt")
    upto = F.sum("element").over(within(("conv_id",), "depth"))
    long_ones = rows.where(f"{CHUNK} > 0").select("conv_id").distinct()
    before = totals(rows.join(long_ones, "conv_id", "left_semi"), ("conv_id",), sums=F.sum("element")).where(f"{CHUNK} > 0").select("conv_id", CHUNK, "sums_before")
    out = rows.withColumn("upto", upto).join(before, ["conv_id", CHUNK], "left")
    key = (F.col("upto") + F.coalesce("sums_before", F.lit(0).cast(KEY))).cast(KEY)
    return out.select("conv_id", "depth", "element", "words", "last", key.alias("key")).withColumn("parent", (F.col("key") - F.col("element")).cast(KEY)).drop("element")


def roll_up(nodes: DataFrame, sums: tuple[str, ...]) -> DataFrame:
    """``key`` and, for each of ``sums``, its total over the node's subtree.

    ``nodes`` is ``key, depth, parent`` (the root has key and depth 0) with the
    nodes' own values.  Before a round, a node has gathered what lies less than
    ``far`` below it, and its pointer leads ``far`` up; it adds that to the node
    there, which then has what lies less than twice as far below.  A node above
    the depth ``far`` has nowhere left to add to, so it leaves: later rounds take
    deeper nodes alone, and what is still added to those that left comes together
    at the end.  A pointer that reaches the root is known by depth, so the root is
    never a key of a join.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    live, far, parts = nodes.select("key", "depth", F.col("parent").alias("up"), *sums), 1, []
    parts.append(live.where("depth = 0").select("key", *sums))
    live = live.where("depth > 0")
    while far <= deepest:
        given = live.groupBy(F.col("up").alias("key")).agg(F.min(F.col("depth") - far).alias("depth"), *(F.sum(x).alias(f"_{x}") for x in sums))
        given = staged(given, "given")
        parts.append(given.where(F.col("depth") < 2 * far).select("key", *(F.col(f"_{x}").alias(x) for x in sums)))
        parts.append(live.where(F.col("depth") < 2 * far).select("key", *sums))
        rest = live.where(F.col("depth") >= 2 * far)
        jumped = rest.where(F.col("depth") > 2 * far).select("key", "up").join(live.select(F.col("key").alias("up"), F.col("up").alias("next")), "up").select("key", "next")
        out = rest.join(given.where(F.col("depth") >= 2 * far).drop("depth"), "key", "left").join(jumped, "key", "left")
        up = F.when(F.col("depth") == 2 * far, F.lit(0).cast(KEY)).otherwise(F.col("next"))
        live = staged(out.select("key", "depth", up.alias("up"), *((F.col(x) + F.coalesce(f"_{x}", F.lit(0))).alias(x) for x in sums)), "subtrees")
        far *= 2
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    return every.groupBy("key").agg(*(F.sum(x).cast("long").alias(x) for x in sums))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each key's pieces, which come in order; one running hash, whatever their number."""
    now, running, first = None, None, True
    for batch in batches:
        keys, out = [], []
        for key, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != now:
                if now is not None:
                    keys.append(now)
                    out.append(running.hexdigest())
                now, running, first = key, hashlib.sha256(), True
            running.update(piece.encode() if first else b"," + piece.encode())
            first = False
        yield _digest_rows(keys, out)
    if now is not None:
        yield _digest_rows([now], [running.hexdigest()])


def _digest_rows(keys: list, out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.decimal128(38, 0)), pa.array(out, pa.string())], ["key", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """``key, ends_sha256``: SHA-256 of the ascending, comma-joined ids (``key, conv_id``) that end at a node.

    Ids are joined by stretches of 4,096 numbers; a node with one stretch needs no
    more, and the stretches of the others go in order through one running hash.
    """
    stretch = F.floor(F.col("conv_id") / STRETCH)
    pieces = ends.groupBy("key", stretch.alias("stretch")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("piece"))
    pieces = staged(pieces, "ends")
    one = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("piece").alias("piece"))
    several = pieces.join(one.where("n > 1").select("key"), "key", "left_semi").repartition("key").sortWithinPartitions("key", "stretch")
    digests = several.select("key", "piece").mapInArrow(lean(_digests), f"key {KEY}, ends_sha256 string")
    return one.where("n = 1").select("key", F.sha2(F.col("piece").cast("binary"), 256).alias("ends_sha256")).union(digests)


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each node of the trie of rebuilt conversations.

    ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id``, ``n_convs``
    (members), ``n_children``, ``n_leaves``, ``saved_tokens`` (over the subtree,
    what members beyond the first need not repeat, in words) and ``ends_sha256``
    (of the ids that end there).

    A null role or text is an empty one; a null turn comes first; turns alike go
    by a digest of role and text, repeated rows are turns each; rows with a null
    conversation take no part; no rows give no nodes, not even a root.
    """
    spark = turns.sparkSession
    prepare(spark)
    rows, convs = rebuilt(pick(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col))
    rows = staged(prefixes(rows), "prefixes")
    zero = F.lit(0).cast(KEY)
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("key"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast(KEY).alias("parent"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"))
    below = rows.groupBy("key").agg(F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"))
    nodes = staged(below.select(root.columns).union(root), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = staged(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    valued = nodes.select("key", "depth", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    rolled = roll_up(valued, ("n_leaves", "saved_tokens"))
    ends = end_digests(rows.where("last").select("key", "conv_id").union(convs.where("length = 0").select(zero, "conv_id")))
    # the root has no parent and is that of all nodes at depth 1; only deeper ones look theirs up
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    top = nodes.where("depth = 0").select(F.col("conv_id").alias("parent_conv_id"))  # one row
    own = ["key", "conv_id", "depth", "n_convs", "n_children", "parent_conv_id"]
    deep = nodes.where("depth > 1").join(above, "parent").select(own)
    shallow = nodes.where("depth = 1").crossJoin(F.broadcast(top)).select(own)
    named = deep.union(shallow).union(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(own))
    out = named.join(rolled, "key").join(ends, "key", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: Prefixes as lists, ancestors by the prefixes of a node's smallest member.  CRC-32 is spelt out.
SQL = r"""
with o as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as i, count(*) over (partition by conv_id) as n
  from conversations where conv_id is not null
), ids as (
  select distinct c, n, c - c % 20 as base,
    xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::ubigint)),
      lambda a, x: list_reduce(list_prepend(xor(a, x), list_transform(range(8), lambda z: 0::ubigint)), lambda y, z: xor(y >> 1, (y & 1::ubigint) * 3988292384::ubigint))), 4294967295::ubigint) % 4 as h
  from o
), r as (
  select ids.c, o.i as d, o.role, o.text from ids join o on o.c = ids.base and o.i <= ids.h
  union all
  select ids.c, o.i - ids.h + least(ids.h, coalesce(b.n, 0)) as d, o.role, o.text from ids join o on o.c = ids.c and o.i > ids.h left join ids b on b.c = ids.base
), p as (
  select c, d, list({'r': role, 't': text}) over (partition by c order by d) as prefix, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as words from r
  union all select c, 0, [], 0 from ids
), longest as (select c, max(d) as d from p group by c
), m as (select p.d, prefix, words, min(p.c) as conv_id, count(*) as n_convs, list(p.c order by p.c) filter (longest.d = p.d) as ends from p join longest on longest.c = p.c group by all
), named as (select p.c, p.d, m.conv_id from p join m on m.d = p.d and m.prefix = p.prefix
), kids as (select named.conv_id, named.d, count(*) as n from m join named on named.c = m.conv_id and named.d = m.d - 1 group by all
), up as (select m.conv_id, m.d, named.conv_id as top, named.d as top_d, (m.n_convs - 1) * m.words as saved, kids.n is null as leaf
  from m join named on named.c = m.conv_id and named.d <= m.d left join kids on kids.conv_id = m.conv_id and kids.d = m.d
), below as (select top, top_d, sum(saved) as saved_tokens, sum(leaf::int) as n_leaves from up group by all)
select m.conv_id, m.d::bigint as depth, a.conv_id as parent_conv_id, m.n_convs::bigint as n_convs, coalesce(kids.n, 0)::bigint as n_children,
  below.n_leaves::bigint as n_leaves, below.saved_tokens::bigint as saved_tokens, sha256(coalesce(array_to_string(m.ends, ','), '')) as ends_sha256
from m join below on below.top = m.conv_id and below.top_d = m.d
left join named a on a.c = m.conv_id and a.d = m.d - 1
left join kids on kids.conv_id = m.conv_id and kids.d = m.d
"""

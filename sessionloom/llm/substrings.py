"""Long strings that occur twice are cut out of all texts: anchors deal them out, suffix arrays find them.

A window of ``length`` bytes belongs to the least hash of the k-byte strings in
it, so windows that are equal belong to the same key, wherever they are.  Windows
that follow one another and have that hash at the same place make a string, a
little longer than a window, in which no window is there twice.  Keys that occur once repeat nothing; strings that are alike as a whole
repeat in whole; where a key has different strings, one of each goes into a block
with its like, and a suffix array built by linear grouping (``suffix_groups``)
says which windows of them are equal.  A key with very many different strings is
dealt out anew by longer k-byte strings, and at last by the windows themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, lean, pick, prepare, shuffle_partitions, staged
from .suffix_groups import repeated
from .words import mix

#: Bytes of a repeated string.
LENGTH = 200
#: Different strings of one key that may go into one block.
GROUP = 512
#: Bytes of strings in one block, and for one task.
BLOCK, TASK = 1 << 19, 4 << 20
#: Bytes of a text that are hashed at once, and bits for a place among them.
SLICE, PLACE = 1 << 20, 21
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_STEP, _TAIL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def hashes(text: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` bytes in a row, by doubling."""
    h, size, step = _BYTES[text], 1, _STEP
    while 2 * size <= k:
        h = h[:-size] * step + h[size:]
        step, size = step * step, 2 * size
    if size < k:
        h = h[: len(h) - (k - size)] * _TAIL + h[k - size :]
    return mix(h)


def strings(text: bytes, k: int, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, first windows, windows) of the strings of a text: windows whose first least hash is at one place.

    The low bits of a hash give way to its place, so that of hashes alike the
    first counts; the key is the whole hash there.
    """
    place = np.uint64((1 << PLACE) - 1)
    for low in range(0, len(text) - length + 1, SLICE):
        whole = hashes(np.frombuffer(text[low : low + SLICE + length - 1], np.uint8), k)
        least, size, wide = (whole & ~place) | np.arange(len(whole), dtype=np.uint64), 1, length - k + 1
        while 2 * size <= wide:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        if size < wide:
            least = np.minimum(least[: len(least) - (wide - size)], least[wide - size :])
        begins = np.concatenate([[0], np.nonzero(least[1:] != least[:-1])[0] + 1])
        keys = whole[(least[begins] & place).astype(np.int64)].view(np.int64)
        yield keys, begins + low, np.diff(np.append(begins, len(least)))


def _cut(k: int, length: int):
    """``key, digest, sid, row, at, n, known`` of the strings of every source."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        with np.errstate(over="ignore"):
            for batch in batches:
                sids, rows, bases, knowns = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:4])
                for i, text in enumerate(batch.column(4)):
                    text = text.as_py()
                    for keys, at, n in strings(text, k, length):
                        ends = at + n + (length - 1)
                        digests = np.fromiter((digest(text[a:b]) for a, b in zip(at.tolist(), ends.tolist())), np.uint64, len(at)).view(np.int64)
                        size = len(keys)
                        columns = (keys, digests, np.full(size, sids[i]), np.full(size, rows[i]), at + bases[i], n.astype(np.int32), np.full(size, knowns[i]))
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "digest", "sid", "row", "at", "n", "known"])

    return run


def _slice(length: int):
    """The bytes of each wanted string of a source: one row in, one out for each of its ``wanted``."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                for low in range(0, len(wanted), 4096):
                    part = wanted[low : low + 4096]
                    cut = [text[w["at"] - base : w["at"] - base + w["n"] + length - 1] for w in part]
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array([w[x] for w in part], t) for x, t in (("key", pa.int64()), ("row", pa.int64()), ("at", pa.int64()), ("known", pa.bool_()))), pa.array(cut, pa.binary())],
                        ["key", "row", "at", "known", "text"],
                    )

    return run


_STRINGS = "key long, row long, at long, known boolean, text binary"


def _in_blocks(length: int):
    """``row, first, last``: bytes that repeated windows cover, from strings that come by key."""

    def found(block: list[tuple]) -> pa.RecordBatch:
        rows, first, last = [], [], []
        for (_, row, at, known, _), hit in zip(block, repeated([x[4] for x in block], length)):
            if not known and hit.any():
                edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                begins, ends = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
                rows += [row] * len(begins)
                first += (begins + at).tolist()
                last += (ends + at + length - 1).tolist()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rows, first, last)], ["row", "first", "last"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = [], 0
        for batch in batches:
            for item in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= BLOCK and item[0] != block[-1][0]:
                    yield found(block)
                    block, size = [], 0
                block.append(item)
                size += len(item[4])
        if block:
            yield found(block)

    return run


def _level(sources: DataFrame, k: int, length: int) -> tuple[DataFrame, DataFrame, bool]:
    """(``row, first, last`` that are repeated, strings of keys with too many, whether there are such) of ``sid, row, base, known, text``."""
    spark = sources.sparkSession
    every = staged(sources.select("sid", "row", "base", "known", "text").mapInArrow(_cut(k, length), "key long, digest long, sid long, row long, at long, n int, known boolean"), "anchors")
    # a table of its own, so that a hot key of the join below can be split
    often = staged(every.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "often")
    several = staged(every.join(often, "key", "left_semi"), "anchors")
    drop(every)
    drop(often)
    one = F.min(F.struct("sid", "row", "at", "n")).alias("one")
    alike = several.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("times"), F.max("known").alias("known"), one)
    alike = staged(alike, "strings")
    different = alike.groupBy("key").agg(F.count(F.lit(1)).alias("different")).where("different > 1")
    # strings that occur as a whole more than once; the join's hot keys are split by adaptive execution
    twice = several.where("not known").join(alike.where("times > 1").select("key", "digest"), ["key", "digest"], "left_semi")
    spans = staged(twice.select("row", F.col("at").alias("first"), (F.col("at") + F.col("n") + length - 1).alias("last")), "repeats")
    compared = alike.join(different, "key").select("key", "one.*", (F.col("known") | (F.col("times") > 1)).alias("known"), (F.col("different") > GROUP).alias("hot"))
    compared = staged(compared, "compared")
    drop(several)
    drop(alike)
    size, hot = compared.agg(F.coalesce(F.sum(F.when(~F.col("hot"), F.col("n") + length)), F.lit(0)), F.coalesce(F.max("hot"), F.lit(False))).first()
    wanted = compared.groupBy("sid").agg(F.collect_list(F.struct("key", "row", "at", "n", "known", "hot")).alias("wanted"))  # of one text, which has them
    with_text = sources.select("sid", "base", "text").join(wanted, "sid")
    few = with_text.select("base", "text", F.filter("wanted", lambda w: ~w["hot"]).alias("wanted")).mapInArrow(_slice(length), _STRINGS)
    tasks = max(shuffle_partitions(spark), min(size // TASK, 20000))
    found = few.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_in_blocks(length), "row long, first long, last long")
    spans = spans.union(staged(found, "repeats"))
    many = None
    if hot:
        many = with_text.select("base", "text", F.filter("wanted", lambda w: w["hot"]).alias("wanted")).where(F.size("wanted") > 0).mapInArrow(_slice(length), _STRINGS)
        many = staged(many.select(F.monotonically_increasing_id().alias("sid"), "row", F.col("at").alias("base"), "known", "text"), "hot")
    return spans, many, hot


def _merged(spans: list[dict] | None) -> list[dict]:
    """Spans that neither overlap nor touch."""
    out: list[dict] = []
    for first, last in sorted((s["first"], s["last"]) for s in spans or ()):
        if out and first <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], last)
        else:
            out.append({"start": first, "end": last})
    return out


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, kept, sizes = [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            own = _merged(spans)
            borders = [0, *(x for s in own for x in (s["start"], s["end"])), len(text)]
            removed.append(own)
            kept.append(b"".join(text[a:b] for a, b in zip(borders[::2], borders[1::2])))
            sizes.append(len(text))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "removed", "kept"],
        )


def cut_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, removed, kept`` of every document.

    ``removed`` are the spans (start, end) of the UTF-8 text whose bytes lie in a
    string of ``length`` bytes that begins at another place too, in this text or
    another's; ``kept`` is the rest, as bytes, since a cut may split a character.
    All copies go, and strings are judged on the texts as they are.

    A null text is an empty one; a null id stays null; repeated rows are copies
    of one another; a text shorter than ``length`` stays whole; no rows give none.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = staged(rows.select(F.monotonically_increasing_id().alias("sid"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text")), "texts")
    sources = rows.select("sid", F.col("sid").alias("row"), F.lit(0).cast("long").alias("base"), F.lit(False).alias("known"), "text")
    spans = None
    for k in (max(1, length * 8 // 25), max(1, length * 22 // 25), length):
        found, sources, more = _level(sources, k, length)
        spans = found if spans is None else spans.union(found)
        if not more:
            break
    by_row = spans.groupBy(F.col("row").alias("sid")).agg(F.collect_list(F.struct("first", "last")).alias("spans"))  # of one text
    return rows.join(by_row, "sid", "left").select("doc_id", "text", "spans").mapInArrow(lean(_remove), "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    cut = cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
with t as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x from documents
), w as (
  select r, p, md5_number(substr(x, 2 * p - 1, 400)) as h from (select r, x, unnest(range(1, length(x) // 2 - 198)) as p from t)
), twice as (select h from w group by h having count(*) > 1
), starts as (
  select r, p, lag(p) over (partition by r order by p) as before from w where h in (select h from twice)
), runs as (select r, p, sum(case when before is null or p > before + 200 then 1 else 0 end) over (partition by r order by p) as g from starts
), spans as (select r, g, min(p) as a, max(p) + 199 as b from runs group by r, g
), kept as (
  select r, count(*) as n_spans, sum(b - a + 1) as n_removed, list(a order by a) as starts, list(b order by a) as ends from spans group by r
)
select t.doc_id, (length(x) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(case when n_spans is null then x else
    array_to_string(list_transform(range(1, n_spans + 2), lambda i: substr(x, case when i = 1 then 1 else 2 * ends[i - 1] + 1 end,
      case when i > n_spans then length(x) else 2 * (starts[i] - 1) - case when i = 1 then 0 else 2 * ends[i - 1] end end)), '') end)) as kept_sha256
from t left join kept using (r)
"""

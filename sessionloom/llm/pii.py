"""Personal data: base identifiers, and others found by bootstrapped contexts.

Four kinds have fixed rules.  Their mentions are seeds: the words before them,
and the label a token begins with (``mail:``), are patterns.  Patterns and the
tokens in their slots form a graph, on which confidence goes from instances to
patterns, against how often each pattern stands before anything else, and from
patterns of high confidence to tokens that no rule knows, if their shape suits
the kind.  Those are instances of the next round, whose own contexts may be
patterns in turn, until a round finds nothing new.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_index, lean, pick, prepare, staged, with_row
from .words import grams, hashed, mix

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: What a token has that could be an identifier: a digit, a sign that addresses have, or a label.
_SIGN = re.compile(r"[0-9@:=]|[\[(]at[\])]")
_SPACE = re.compile(r"\s")
#: What may follow a group of digits after one space and be of the same number.
_GROUP = re.compile(r" [0-9().+/-]*[0-9](?=[().,;!?\"'>\]}]*(?:\s|\Z))")
_GROUPED = re.compile(r"[0-9().+/-]+")
#: An address in words.
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++")
_LABEL = re.compile(r"([A-Za-z][A-Za-z_-]+[:=])[\"']?(?=\S)")
_EDGE = "\"'()[]{}<>,;.!?"
_SHAPES = (
    re.compile(r"[^\s@]{1,64}(?:@|[\[(]at[\])])[^\s@]{1,255}|\S{1,64} at \S+(?: dot \S+)+", re.I),
    re.compile(r"[0-9]{1,3}(?:[.:\-\[\]()]{1,4}[0-9]{1,3}){3}|[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}"),
    re.compile(r"[^0-9]{0,3}[0-9](?:[^0-9]{0,3}[0-9]){11,18}[^0-9]{0,3}"),
    re.compile(r"[^0-9]{0,3}[0-9](?:[^0-9]{0,3}[0-9]){6,14}[^0-9]{0,3}"),
)
_LABEL_TYPE = np.uint64(0x6A09E667F3BCC909)
_BITMAP = 1 << 20


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four kinds, in order; code points, end exclusive.

    Every kind is found leftmost and without overlaps.  The rules run in linear
    time on any text: an address is looked for around its ``@`` alone, and a
    number only from the first digit of a run.
    """
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _context(text: str, start: int, floor: int) -> list[bytes]:
    """The two words before a place, in lower case and without marks at their ends.

    Where an identifier of the same token ends at ``floor``, it is what stands
    between the two.
    """
    found, at = [], start
    while len(found) < 2 and at > 0:
        end = at
        while at > 0 and at != floor and not text[at - 1].isspace():
            at -= 1
        if end > at:
            found.append(text[at:end])
        if at and at == floor and not text[at - 1].isspace():
            break
        while at > 0 and text[at - 1].isspace():
            at -= 1
    return [w.strip(_EDGE).lower().encode("utf-8", "replace") for w in reversed(found)]


def _patterns(text: str, start: int, floor: int = -1) -> list[int]:
    """Hashes of what stands before a token: the word, and the two words."""
    h = hashed(_context(text, start, floor))
    out = [h[-1:]] if len(h) else []
    if len(h) == 2:
        out.append(grams(h, 2))
    return [int(x) for x in np.concatenate(out).view(np.int64)] if out else []


def _value(token: str) -> int:
    return int(hashed([token.lower().encode("utf-8", "replace")]).view(np.int64)[0])


def slots(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, list[int]]]:
    """(start, end, kind or -1, value, patterns) of base mentions and of other tokens that could be identifiers.

    A token goes from space to space, less marks at its ends and a label at its
    begin.  Groups of digits that follow each other after one space are one, and
    so is an address in words (``joe at host dot org``).  Every character is
    looked at a bounded number of times, however many identifiers there are.
    """
    out, floor, ends = [], -1, []
    for s, k, e in spans:
        while ends and ends[0] <= s:
            floor = heapq.heappop(ends)
        out.append((s, e, k, _value(text[s:e]), _patterns(text, s, floor)))
        heapq.heappush(ends, e)
    spelled = []
    if " dot " in text:
        for m in _SPELLED.finditer(text):
            spelled.append((m.start(), m.end()))
            out.append((*spelled[-1], -1, _value(m[0]), _patterns(text, m.start())))
    at = word = done = 0
    while m := _SIGN.search(text, done):
        start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        space = _SPACE.search(text, m.end())
        end = done = space.start() if space else len(text)
        while word < len(spelled) and spelled[word][1] <= start:
            word += 1
        if word < len(spelled) and spelled[word][0] < end:
            continue
        while start < end and text[start] in _EDGE and not (text[start] == "(" and ")" in text[start:end]):
            start += 1
        while end > start and text[end - 1] in _EDGE and not (text[end - 1] == ")" and "(" in text[start:end]):
            end -= 1
        label = _LABEL.match(text, start, end)
        patterns = []
        if label:
            patterns = [int(mix(hashed([label[1].lower().encode()]) ^ _LABEL_TYPE).view(np.int64)[0])]
        begin = label.end() if label else start
        if end == done and _GROUPED.fullmatch(text, begin, end):
            while more := _GROUP.match(text, end):
                end = more.end()
            done = max(done, end)
        while at < len(spans) and spans[at][2] <= begin:
            at += 1
        inside, near = [], max(0, at - 4)
        while near < len(spans) and spans[near][0] < end:
            if spans[near][2] > begin:
                inside.append(spans[near])
            near += 1
        if inside:
            if patterns and inside[0][0] == begin:
                out.append((*inside[0][::2], inside[0][1], _value(text[begin : inside[0][2]]), patterns))
            continue
        if end - begin >= 5:
            out.append((begin, end, -1, _value(text[begin:end]), patterns + (_patterns(text, start) if not label else [])))
    return out


_ROWS = (
    "doc_id long, row long, key long, base array<struct<start:int,kind:int,end:int>>, base_sha256 string, "
    "slots array<struct<start:int,end:int,kind:int,value:long,suits:int,patterns:array<long>>>"
)
_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_SLOT = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("value", pa.int64()), ("suits", pa.int32()), ("patterns", pa.list_(pa.int64()))])


@lean
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        bases, digests, found = [], [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            spans = base_spans(text)
            bases.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            digests.append(hashlib.sha256(joined(spans).encode()).hexdigest())
            own = []
            for start, end, kind, value, patterns in slots(text, spans):
                suits = sum(1 << k for k, shape in enumerate(_SHAPES) if shape.fullmatch(text, start, end)) if kind < 0 else 0
                own.append({"start": start, "end": end, "kind": kind, "value": value, "suits": suits, "patterns": patterns})
            found.append(own)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.arange(row, row + n)), batch.column(2), pa.array(bases, pa.list_(_SPAN)), pa.array(digests, pa.string()), pa.array(found, pa.list_(_SLOT))],
            ["doc_id", "row", "key", "base", "base_sha256", "slots"],
        )
        row += n


def _totals(bitmap):
    """How often each word, or two words, of a fixed-size set stands before another."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(bitmap.value, np.uint8), bitorder="little").astype(bool)
        mask = np.uint64(_BITMAP - 1)
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["pattern", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                h = hashed([w.strip(_EDGE).lower().encode("utf-8", "replace") for w in (text or "").split()])
                for x in (h[:-1], grams(h, 2)[:-1] if len(h) > 2 else h[:0]):
                    x = x[bits[(x & mask).astype(np.int64)]] if len(x) else x
                    held.append(x)
                    size += len(x)
            if size > 1 << 20:
                yield flush()
                size = 0
        if size:
            yield flush()

    return run


def learn_patterns(scanned: DataFrame, rows: DataFrame, support: int = 3, confidence: float = 0.7) -> DataFrame:
    """``pattern, kind, confidence`` of the patterns that mark a kind.

    A pattern needs ``support`` different instances of a kind, and a share of
    ``confidence`` of its mentions that are such; instances are the rules' seeds
    and, from the second round on, tokens of the kind's shape that patterns have
    found, which count as much as the best of those is worth.  It ends after a
    round without a new instance, however far a chain of contexts leads from the
    seeds: what patterns are worth only grows with their instances, so there are
    at most as many rounds as instances.
    """
    slot = scanned.select(F.explode("slots").alias("s")).select(F.col("s.kind").alias("seed"), F.col("s.value").alias("value"), F.col("s.suits").alias("suits"), F.explode("s.patterns").alias("pattern"))
    edges = slot.groupBy("pattern", "value", "seed").agg(F.count(F.lit(1)).alias("n"), F.max("suits").alias("suits"))
    kinds = F.array(*(F.lit(k) for k in range(len(KINDS))))
    fits = F.filter(kinds, lambda k: F.when(F.col("seed") >= 0, F.col("seed") == k).otherwise(F.expr("suits").bitwiseAND(F.call_function("shiftleft", F.lit(1), k)) != 0))
    edges = staged(edges.withColumn("kind", F.explode(fits)).select("pattern", "value", "seed", "kind", "n"), "pii-edges")
    # what could come to have support in any round; a pattern is only looked at for such kinds
    possible = edges.groupBy("pattern", "kind").agg(F.countDistinct("value").alias("k")).where(F.col("k") >= support).select("pattern", "kind")
    known = staged(edges.join(possible, ["pattern", "kind"]), "pii-known")
    seeds = known.where("seed >= 0").select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    marks = rows.sparkSession.createDataFrame([], "pattern long, kind int, confidence double")
    n_seeds = seeds.count()
    if n_seeds < support:
        return marks
    # a bitmap of fixed size tells a scan which contexts to count; the join after it is exact
    places = F.col("pattern").bitwiseAND(F.lit(_BITMAP - 1))
    words = known.select(F.shiftright(places, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(pattern & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    bitmap = np.zeros(_BITMAP // 64, np.uint64)
    for r in words:
        bitmap[r["w"]] = np.uint64(r["b"] & (1 << 64) - 1)
    sent = rows.sparkSession.sparkContext.broadcast(bitmap.tobytes())
    everywhere = rows.select("text").mapInArrow(_totals(sent), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    own = known.groupBy("pattern", "value").agg(F.max("n").alias("n")).groupBy("pattern").agg(F.sum("n").alias("mentions"))
    mentions = staged(own.join(everywhere, "pattern", "left").select("pattern", F.greatest("mentions", F.coalesce("n", F.lit(0))).alias("mentions")), "pii-mentions")
    held = staged(known.groupBy("pattern", "value", "kind").agg(F.sum("n").alias("n"), F.max("seed").alias("seed")), "pii-held")
    scores, before = seeds, n_seeds
    while True:
        mass = held.join(scores, ["value", "kind"]).groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("mass"), F.count(F.lit(1)).alias("k")).where(F.col("k") >= support)
        share = F.least(F.col("mass") / (F.col("mentions") + 1), F.lit(0.999))
        marks = mass.join(mentions, "pattern").select("pattern", "kind", share.alias("confidence")).where(F.col("confidence") >= confidence)
        marks = staged(marks, "pii-marks")
        new = held.where("seed < 0").join(marks, ["pattern", "kind"]).groupBy("value", "kind").agg(F.max("confidence").alias("score"))
        scores = staged(seeds.union(new.join(seeds, ["value", "kind"], "left_anti").select("value", "kind", "score")), "pii-scores")
        now = scores.count()
        if now == before:
            break
        before = now
    return marks


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _bootstrapped(rows: DataFrame, support: int, confidence: float) -> tuple[DataFrame, DataFrame]:
    """The scanned rows (``doc_id, text``), and the spans that patterns add: ``row, key, start, kind, end``."""
    keyed = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    scanned = staged(keyed.mapInArrow(_scan, _ROWS), "pii")
    patterns = learn_patterns(scanned, rows, support, confidence)
    slot = scanned.select("row", "key", F.explode("slots").alias("s")).where("s.kind < 0 and s.suits > 0")
    slot = slot.select("row", "key", "s.start", "s.end", "s.suits", F.explode("s.patterns").alias("pattern"))
    found = slot.join(patterns, "pattern").where("(suits & shiftleft(1, kind)) <> 0")
    best = F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("x")
    found = found.groupBy("row", "key", "start", "end").agg(best)
    return scanned, found.select("row", "key", F.struct("start", (-F.col("x.k")).cast("int").alias("kind"), "end").alias("s"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 3, confidence: float = 0.7) -> DataFrame:
    """``doc_id, base, all, base_sha256`` of every row, spans as (start, kind, end).

    ``base`` has what the four rules find, ``all`` also what patterns find beside
    it; kinds are numbered as in :data:`KINDS`.  What patterns may find is a token
    between spaces (of 5 characters or more, with a digit, ``@``, ``:``, ``=`` or
    ``[at]``), digits in groups one space apart, or an address with `` at `` and
    `` dot ``; names and other words without such a sign stay out, and so does an
    identifier whose own context has fewer than ``support`` known ones.

    A null text is an empty one without spans; a null id stays null; repeated
    rows each give a row; no rows give an empty result.
    """
    prepare(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    scanned, found = _bootstrapped(rows, support, confidence)
    by_row = found.groupBy("row").agg(F.collect_list("s").alias("more"))
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(_SPANS))))
    return scanned.drop("slots").join(by_row, "row", "left").select("doc_id", "base", every.alias("all"), "base_sha256")


def _redacted(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    if text is None or not spans:
        return text
    parts, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            parts += [text[at:start], f"<{KINDS[kind]}>"]
        # of spans that overlap the first names the place, and all of both goes
        at = max(at, end)
    return "".join([*parts, text[at:]])


@lean
def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            spans = base_spans(text or "")
            out.append(_redacted(text, spans + [(s["start"], s["kind"], s["end"]) for s in more or ()]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "text"])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", support: int = 3, confidence: float = 0.7) -> DataFrame:
    """``docs`` with every span replaced by ``<kind>``, and ``chars_col``, if there, set to the new length.

    Spans of patterns come by a join on the hash of id and text; the rules' are
    found anew where the text is.  What is found is said at :func:`find_pii`.  A
    null text stays null with its length, an empty one empty; rows with a null id
    and repeated rows are redacted like others; no rows give none.
    """
    prepare(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    _, found = _bootstrapped(rows, support, confidence)
    by_key = staged(found.groupBy("key").agg(F.collect_set("s").alias("more")), "pii-found")
    carried = with_row(docs, doc_id=id_col, text=text_col).withColumn("key", F.xxhash64(F.col("doc_id").cast("long"), "text"))
    joined = carried.join(by_key, "key", "left").select("row", "text", "more")
    schema = joined.select("row", "text").schema
    done = joined.mapInArrow(_redact, schema)
    text_at, lowered = column_index(docs, text_col), [c.lower() for c in docs.columns]
    columns = [F.col("text") if i == text_at else F.col(f"row._{i}") for i in range(len(docs.columns))]
    if chars_col.lower() in lowered:
        at = column_index(docs, chars_col)
        columns[at] = F.when(F.col("text").isNull(), F.col(f"row._{at}")).otherwise(F.char_length("text").cast(docs.schema[at].dataType))
    return done.select(*(c.alias(f"_{i}") for i, c in enumerate(columns))).toDF(*docs.columns)


def _is(kind: int):
    return lambda x: x == kind


def query(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_remove(F.transform(kinds, _is(k)), False)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    names = F.array(*(F.lit(x) for x in KINDS))
    text = F.array_join(F.transform("all", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *counts, "base_sha256", text.alias("spans"))

"""Sessions as trajectories of steps, many sessions at once."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.running import CHUNK, chunked, last_before, totals, within
from ..functions.workspace import ship, staged
from .query import SESSION


#: Writes rows under a label to a folder that all executors share, and reads them back.
Store = Callable[[DataFrame, str], DataFrame]


def chronology(events: DataFrame) -> DataFrame:
    """``at``: each event's place in its session.

    A session of one source goes by position; one of several by time, where an
    event without a time is an error.
    """
    whole = Window.partitionBy(*SESSION)  # spread_chronology is for sessions beyond a task
    several = F.min("source_id").over(whole) != F.max("source_id").over(whole)
    timed = F.when(several, F.coalesce("timestamp", F.raise_error(F.lit("events of several sources need timestamps")).cast("string")))
    own = whole.orderBy("_time", *(("_source", "position", "sub_index", "id")))
    out = events.withColumn("_time", timed).withColumn("_source", F.when(several, F.col("source_id")))
    return out.withColumn("at", F.row_number().over(own)).drop("_time", "_source")


def steps(events: DataFrame) -> DataFrame:
    """``step`` (from 0) and ``is_head`` for each event that belongs to a step.

    A step begins with an assistant's message or a tool call; a result goes to
    the latest call of its id before it, or is a step itself if there is none.
    Needs ``at``.
    """
    kept = events.where(F.col("kind").isin("tool_call", "tool_result") | ((F.col("kind") == "message") & (F.col("role") == "assistant")))
    calls = Window.partitionBy(*SESSION, "tool_call_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    call_at = F.when((F.col("kind") == "tool_result") & F.col("tool_call_id").isNotNull(), F.last(F.when(F.col("kind") == "tool_call", F.col("at")), True).over(calls))
    marked = kept.withColumn("call_at", call_at).withColumn("is_head", F.col("call_at").isNull())
    number = F.sum(F.col("is_head").cast("long")).over(Window.partitionBy(*SESSION).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) - 1
    numbered = marked.withColumn("_own", number)
    # an attached result takes its call's number
    by_call = Window.partitionBy(*SESSION, F.coalesce("call_at", "at"))
    return numbered.withColumn("step", F.max(F.when(F.col("is_head"), F.col("_own"))).over(by_call)).drop("_own")


def _sources(events: DataFrame) -> DataFrame:
    """``harness, session_id, several``: whether a session's events are of several sources; a row for each session, whatever its size."""
    ends = events.groupBy(*SESSION).agg(F.min("source_id").alias("lo"), F.max("source_id").alias("hi"))
    return ends.select(*SESSION, (F.col("lo") != F.col("hi")).alias("several"))


def spread_chronology(events: DataFrame, store: Store = staged) -> DataFrame:
    """:func:`chronology` where one session may hold most of the events; also ``_chunk``, which :func:`spread_steps` needs.

    Events are dealt by ranges of session and order, so a large session lies in
    several chunks; an event's place is its place in the chunk and what the chunks
    before it hold.
    """
    kept = events.join(_sources(events), list(SESSION))
    timed = F.when(F.col("several"), F.coalesce("timestamp", F.raise_error(F.lit("events of several sources need timestamps")).cast("string")))
    order = ("_time", "_source", "position", "sub_index", "id")
    placed = kept.withColumn("_time", timed).withColumn("_source", F.when(F.col("several"), F.col("source_id"))).drop("several")
    rows = chunked(placed, SESSION, order, lambda x: store(x, "chronology"))
    before = totals(rows, SESSION, n=F.count(F.lit(1))).select(*SESSION, CHUNK, "n_before")
    nth = F.row_number().over(within(SESSION, *order))
    return rows.withColumn("_nth", nth).join(before, [*SESSION, CHUNK]).withColumn("at", (F.col("_nth") + F.col("n_before")).cast("int")).drop("_nth", "n_before", "_time", "_source")


def spread_steps(events: DataFrame, store: Store = staged) -> DataFrame:
    """:func:`steps` for events as :func:`spread_chronology` gives them.

    The latest call before a result is the last of its chunk, or else the one that
    the chunks before carry over; a step's number is a running sum over chunks; an
    attached result looks its number up at its call's place.
    """
    kept = events.where(F.col("kind").isin("tool_call", "tool_result") | ((F.col("kind") == "message") & (F.col("role") == "assistant")))
    kept = kept.withColumn("_call", F.when((F.col("kind") == "tool_call") & F.col("tool_call_id").isNotNull(), F.col("at")))
    known = (*SESSION, "tool_call_id")
    here, carried = last_before(kept.where("tool_call_id is not null"), known, "at", call=F.col("_call"))
    # null ids are nobody's, and all of them would be one group
    attached = kept.where("tool_call_id is not null").withColumn("_here", here["call"]).join(carried, [*known, CHUNK])
    attached = attached.withColumn("call_at", F.when(F.col("kind") == "tool_result", F.coalesce("_here", "call_carried"))).drop("_here", "call_carried")
    marked = attached.unionByName(kept.where("tool_call_id is null").withColumn("call_at", F.lit(None).cast("int"))).drop("_call")
    marked = store(marked.withColumn("is_head", F.col("call_at").isNull()), "steps")
    heads = F.col("is_head").cast("long")
    before = totals(marked, SESSION, heads=F.sum(heads)).select(*SESSION, CHUNK, "heads_before")
    numbered = marked.withColumn("_own", F.sum(heads).over(within(SESSION, "at"))).join(before, [*SESSION, CHUNK])
    numbered = store(numbered.withColumn("_own", F.col("_own") + F.col("heads_before") - 1).drop("heads_before"), "steps")
    lead = numbered.where("is_head").select(*SESSION, F.col("at").alias("call_at"), F.col("_own").alias("step"))
    own = numbered.where("is_head").withColumn("step", F.col("_own"))
    return own.unionByName(numbered.where("not is_head").join(lead, [*SESSION, "call_at"])).drop("_own", CHUNK)


def outputs(events: DataFrame) -> DataFrame:
    """``final_output`` and ``final_output_source`` of every session.  Needs ``at``.

    The output is the texts of the last assistant message's record, if nothing
    was said or done after it; it is null where that message has no text.
    """
    heard = events.where(F.col("kind").isin("message", "tool_call", "tool_result"))
    last = heard.groupBy(*SESSION).agg(F.max_by(F.struct("kind", "role", "record_id"), "at").alias("last"))
    said = last.where((F.col("last.kind") == "message") & (F.col("last.role") == "assistant")).select(*SESSION, F.col("last.record_id").alias("record_id"))
    texts = events.where((F.col("kind") == "message") & (F.col("role") == "assistant") & F.col("text").isNotNull()).join(said, [*SESSION, "record_id"])
    parts = F.array_sort(F.collect_list(F.struct("at", "text")))
    joined = texts.groupBy(*SESSION).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("final_output"))
    sources = said.select(*SESSION, F.lit("trailing_assistant_message").alias("final_output_source"))
    every = events.select(*SESSION).distinct().join(sources, list(SESSION), "left").join(joined, list(SESSION), "left")
    return every.select(*SESSION, "final_output", F.coalesce("final_output_source", F.lit("unavailable")).alias("final_output_source"))


def final_output(events: DataFrame) -> DataFrame:
    """The sessions that have a final output, with it.  Needs ``at``."""
    return outputs(events).where("final_output is not null").drop("final_output_source")


def _way(parents: dict, leaf) -> list:
    """Ids from a leaf to its root; a loop, or an entry that isn't there, is an error."""
    way, at = [], leaf
    seen = set()
    while at is not None:
        if at in seen:
            raise ValueError(f"entries form a loop at {at!r}")
        if at not in parents:
            raise ValueError(f"the way from {leaf!r} leads to {at!r}, which isn't among the entries")
        seen.add(at)
        way.append(at)
        at = parents[at]
    return way


#: A session of more entries isn't walked in one group.
WALK = 200_000


def ancestry(entries: DataFrame, leaves: DataFrame, bound: int = WALK, store: Store = staged) -> DataFrame:
    """Every entry (``session_id, id, parent_id``) on the way from a leaf (``session_id, leaf``) to its root, with its ``hops``.

    A session's entries are one group (their ids alone, not what they hold), so
    a way of any length takes one shuffle; sessions of more than ``bound`` entries
    take a logarithmic number of joins instead (:func:`doubled`).  A loop, or a
    parent or leaf that isn't there, is an error either way.
    """
    kinds = dict(entries.dtypes)
    own = entries.where("id is not null").select("session_id", "id", "parent_id")
    ends = leaves.select("session_id", F.col("leaf").cast(kinds["id"]).alias("leaf"))
    large = store(own.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bound), "large")
    if large.isEmpty():
        return _walked(own, ends)
    sessions = large.select("session_id")
    few = _walked(own.join(sessions, "session_id", "left_anti"), ends.join(sessions, "session_id", "left_anti"))
    return few.union(doubled(own.join(sessions, "session_id", "left_semi"), ends.join(sessions, "session_id", "left_semi"), store))


def _walked(entries: DataFrame, leaves: DataFrame) -> DataFrame:
    """:func:`ancestry`, a session at a time."""
    ship(entries.sparkSession)
    kinds = dict(entries.dtypes)

    def walk(own: pa.Table, ends: pa.Table) -> pa.Table:
        parents = dict(zip(own.column("id").to_pylist(), own.column("parent_id").to_pylist()))
        rows = []
        for session, leaf in zip(ends.column("session").to_pylist(), ends.column("leaf").to_pylist()):
            rows += [(session, leaf, at, hops) for hops, at in enumerate(_way(parents, leaf))]
        types = (ends.schema.field("session").type, own.schema.field("id").type, own.schema.field("id").type, pa.int32())
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["session_id", "leaf", "id", "hops"])

    schema = f"session_id {kinds['session_id']}, leaf {kinds['id']}, id {kinds['id']}, hops int"
    return entries.groupBy("session_id").cogroup(leaves.select(F.col("session_id").alias("session"), "leaf").groupBy("session")).applyInArrow(walk, schema)


def doubled(entries: DataFrame, leaves: DataFrame, store: Store = staged) -> DataFrame:
    """:func:`ancestry` by pointer doubling: rounds of joins, of which a way of n entries takes about log2(n).

    Before a round, the ways have their first ``far`` entries and ``jumps`` lead
    ``far`` up; the round adds to each of them the entry ``far`` above it, and
    jumps over jumps lead twice as far.  A way still growing after as many hops as
    its session has entries is a loop.  A round's tables are written, so a lost
    executor costs a reread.
    """
    key = ["session_id", "id"]
    own = store(entries.dropDuplicates(key), "entries")
    ways = [store(leaves.distinct().join(own.select("session_id", F.col("id").alias("leaf")), ["session_id", "leaf"], "left_semi").select("session_id", "leaf", F.col("leaf").alias("id"), F.lit(0).alias("hops")), "ways")]
    lost = leaves.join(own.select("session_id", F.col("id").alias("leaf")), ["session_id", "leaf"], "left_anti").first()
    if lost:
        raise ValueError(f"the leaf {lost['leaf']!r} isn't among the entries")
    jumps = store(own.where("parent_id is not null").select("session_id", "id", F.col("parent_id").alias("up")), "jumps")
    gaps = store(jumps.join(own.select("session_id", F.col("id").alias("up")), ["session_id", "up"], "left_anti"), "gaps")
    most, far = own.groupBy("session_id").count().agg(F.max("count")).first()[0] or 0, 1
    while True:
        so_far = ways[0]
        for more in ways[1:]:
            so_far = so_far.union(more)
        new = store(so_far.join(jumps, key).select("session_id", "leaf", F.col("up").alias("id"), (F.col("hops") + far).alias("hops")), "ways")
        if new.isEmpty():
            break
        if far > most:
            raise ValueError("entries form a loop")
        ways.append(new)
        jumps = store(jumps.join(jumps.select("session_id", F.col("id").alias("up"), F.col("up").alias("next")), ["session_id", "up"]).select("session_id", "id", F.col("next").alias("up")), "jumps")
        far *= 2
    gap = so_far.join(gaps.select(*key, "up"), key).first()
    if gap:
        raise ValueError(f"the way from {gap['leaf']!r} leads to {gap['up']!r}, which isn't among the entries")
    return so_far.select("session_id", "leaf", "id", "hops")


def leaves_of(entries: DataFrame) -> DataFrame:
    """Entries that no other entry of their session names as its parent."""
    parents = entries.select("session_id", F.col("parent_id").alias("id")).where("id is not null").distinct()
    return entries.join(parents, ["session_id", "id"], "left_anti").select("session_id", F.col("id").alias("leaf"))


def on_branch(events: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """Events of one branch of each session whose entries form a tree (``pi``), and all events of others.

    ``leaves`` (``harness, session_id, leaf``) chooses; a session with one leaf
    needs no choice, one with several is an error without it, and so are loops,
    missing ancestors and a choice for another kind of session.  The tree leaves
    out the header; entries without a parent that only describe the session stay.
    """
    ship(events.sparkSession)
    trees = events.where("harness = 'pi'")
    if leaves is None:
        leaves = events.sparkSession.createDataFrame([], "harness string, session_id string, leaf string")
    elif not leaves.join(trees.select(*SESSION).distinct(), list(SESSION), "left_anti").isEmpty():
        raise ValueError("a leaf is chosen for a session without entries that form a tree")
    header = F.coalesce(F.get_json_object("payload_json", "$.type") == "session", F.lit(False))

    def choose(own: pa.Table, ends: pa.Table) -> pa.Table:
        rows = list(zip(*(own.column(c).to_pylist() for c in ("id", "native_id", "parent_id", "kind", "header"))))
        chosen = ends.column("leaf").to_pylist()
        parents = {native: parent for _, native, parent, _, head in rows if native is not None and not head}
        ends_ = sorted(set(parents) - set(parents.values()))
        if parents and not ends_:
            raise ValueError("entries form a loop")
        if not chosen and len(ends_) > 1:
            raise ValueError("a session has several branches; choose a leaf")
        leaf = chosen[0] if chosen else ends_[0] if ends_ else None
        way = set(_way(parents, leaf)) if leaf is not None else None
        kept = [i for i, native, parent, kind, _ in rows if way is None or native in way or (kind == "metadata" and parent is None)]
        return pa.table({"id": pa.array(kept, pa.string())})

    own = trees.select("session_id", "id", "native_id", "parent_id", "kind", header.alias("header")).groupBy("session_id")
    kept = own.cogroup(leaves.select(F.col("session_id").alias("session"), F.col("leaf").alias("leaf")).groupBy("session")).applyInArrow(choose, "id string")
    return events.where("harness <> 'pi'").unionByName(trees.join(kept, "id", "left_semi").select(events.columns))


def judge_prefix(events: DataFrame) -> DataFrame:
    """What a judge reads up to each event: how many events, and how many characters.  Needs ``at``."""
    upto = Window.partitionBy(*SESSION).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return events.select(*SESSION, "at", F.count("*").over(upto).alias("prefix_events"), F.sum(F.char_length(F.coalesce("text", F.lit("")))).over(upto).alias("prefix_chars"))

"""Registered queries of the session-analytics engine and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions.variants import action_key
from ..operators import assessment as A
from ..operators import matching as M
from ..operators import query as Q
from ..operators import trajectory as T
from ..operators.catalog import active_manifests, compaction_groups, status, upload_backlog
from ..operators.outcomes import result_text, tool_name
from ..operators.textindex import bm25_top
from ..sources import lift
from .registration import register

EV = """
with ev as (
  select cast(event_id as varchar) as id, cast(event_id as varchar) as record_id,
    case user_id % 3 when 0 then 'codex' when 1 then 'pi' else 'cursor' end as harness,
    'u' || user_id as session_id, event_id % 4 = 0 as is_hook,
    'u' || user_id || case when event_id % 4 = 0 then ':hooks' else ':rollout' end as source_id,
    event_id as position, cast(0 as bigint) as sub_index, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') as "timestamp",
    case event_type when 'view' then 'tool_call' when 'click' then 'tool_result' when 'purchase' then 'message' when 'signup' then 'metadata' when 'error' then 'unknown' end as kind,
    case when event_type = 'purchase' then case when value < 10 then 'assistant' else 'user' end end as role,
    event_type || ' ' || props as text,
    case when event_type in ('view', 'click') then cast(cast(json_extract_string(props, '$.k') as bigint) % 10 as varchar) end as tool_call_id,
    event_id as batch_ord, props
  from events
)"""
COLLAPSED = """, ranked as (
  select *, row_number() over (partition by harness, session_id, kind, tool_call_id, case when not (kind in ('tool_call', 'tool_result') and tool_call_id is not null) then id end
    order by is_hook, source_id, position, sub_index) as n
  from {source}
), col as (select * from ranked where n = 1 or tool_call_id is null or kind not in ('tool_call', 'tool_result'))"""
AT = EV + """, seen as (
  select *, row_number() over (partition by harness, session_id order by "timestamp", source_id, position, sub_index, id) as nth from ev
)"""
STEPS = AT + """, kept as (
  select * from seen where kind in ('tool_call', 'tool_result') or (kind = 'message' and role = 'assistant')
), calls as (
  select *, case when kind = 'tool_result' and tool_call_id is not null then
    max(case when kind = 'tool_call' then nth end) over (partition by harness, session_id, tool_call_id order by nth rows between unbounded preceding and 1 preceding) end as call_at
  from kept
), own as (
  select *, call_at is null as is_head, sum(case when call_at is null then 1 else 0 end) over (partition by harness, session_id order by nth rows between unbounded preceding and current row) - 1 as o from calls
), steps as (
  select *, max(case when is_head then o end) over (partition by harness, session_id, coalesce(call_at, nth)) as step from own
)"""
PAIRS = """
with st as (
  select conv_id - conv_id % 2 as pair, conv_id % 2 as side, turn as idx, role || '/' || cast(length(text) // 100 as varchar) as key, text from conversations
), o as (select pair, idx, key, text from st where side = 0), c as (select pair, idx, key, text from st where side = 1)"""
UNORDERED = PAIRS + """, ro as (select *, row_number() over (partition by pair, key order by idx) as nth from o),
rc as (select *, row_number() over (partition by pair, key order by idx) as nth from c),
m as (select rc.pair, rc.idx as candidate_step, ro.idx as oracle_step from rc join ro on rc.pair = ro.pair and rc.key = ro.key and rc.nth = ro.nth)"""


# --- filters and selection -------------------------------------------------

_CONJ = Q.Query(harness="pi", kind="tool_call", text='"k": 1')


@register("event_filter_conj", EV + " select id, session_id, position, text from ev where harness = 'pi' and kind = 'tool_call' and contains(text, '\"k\": 1')")
def event_filter_conj(spark, d):
    return lift.events(spark, d).where(_CONJ.checked().on_events()).select("id", "session_id", "position", "text")


@register("text_contains_cs", "select 'c' || conv_id as session_id, turn as position, text from conversations where contains(text, 'The')")
def text_contains_cs(spark, d):
    return lift.messages(spark, d).where(Q.Query(text="The").checked().on_events()).select("session_id", "position", "text")


@register("time_range_inclusive", EV + " select id, \"timestamp\" from ev where \"timestamp\" >= '2024-01-02T00:00:00.123Z' and \"timestamp\" <= '2024-01-05T10:30:00.000Z'")
def time_range_inclusive(spark, d):
    q = Q.Query(since="2024-01-02T02:00:00.1239+02:00", until="2024-01-05T10:30:00Z")
    return lift.events(spark, d).where(q.checked().on_events()).select("id", "timestamp")


@register("stable_ids", EV + " select id, sha256(to_json([source_id, cast(position as varchar), sha256(text)])) as record_key from ev")
def stable_ids(spark, d):
    return lift.events(spark, d).select("id", X.stable_id("source_id", "position", F.sha2("text", 256)).alias("record_key"))


@register("ts_normalize_ms", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') as canonical from events")
def ts_normalize_ms(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    text = F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'")
    return e.select("event_id", X.canonical_time(X.instant(text)).alias("canonical"))


@register("dedupe_first_by_id", EV + ", two as (select *, 0 as b from ev where event_id_mod < 2 union all select *, 1 as b from ev where event_id_mod > 0) select id, min(b) as batch from two group by id".replace("event_id_mod", "position % 3"))
def dedupe_first_by_id(spark, d):
    e = lift.events(spark, d).drop("batch_ord")
    two = e.where("position % 3 < 2").withColumn("batch", F.lit(0)).union(e.where("position % 3 > 0").withColumn("batch", F.lit(1)))
    return Q.distinct_first(two.withColumn("batch_ord", F.col("batch"))).select("id", "batch")


@register("hook_collapse", EV + COLLAPSED.format(source="ev") + " select id, kind, tool_call_id, is_hook from col")
def hook_collapse(spark, d):
    return Q.collapse_hooks(lift.events(spark, d)).select("id", "kind", "tool_call_id", "is_hook")


@register("filter_then_collapse", EV + ", f as (select * from ev where contains(text, '7'))" + COLLAPSED.format(source="f") + " select id, session_id, is_hook from col")
def filter_then_collapse(spark, d):
    return Q.select_events(lift.events(spark, d), Q.Query(text="7")).select("id", "session_id", "is_hook")


@register(
    "query_ordered_page",
    EV + ", f as (select * from ev where kind = 'message')" + COLLAPSED.format(source="f")
    + ", p as (select *, row_number() over (order by harness, session_id, source_id, position, sub_index) as place from col) select cast(place as integer) as place, id, harness, session_id, text from p where place > 40 and place <= 60",
)
def query_ordered_page(spark, d):
    chosen = Q.select_events(lift.events(spark, d), Q.Query(kind="message"))
    return Q.ordered_page(chosen, offset=40, limit=20).select("place", "id", "harness", "session_id", "text")


@register("keyset_page", EV + ", k as (select distinct hex(harness) || ':' || hex(session_id) as key from ev), p as (select key from k where key > '636F646578:7533' order by key limit 11) select key, row_number() over (order by key) > 10 as beyond from p")
def keyset_page(spark, d):
    keys = lift.events(spark, d).select(F.concat_ws(":", F.hex("harness"), F.hex("session_id")).alias("key")).distinct()
    page = Q.keyset_page(keys, "636F646578:7533", limit=10)
    # at most eleven rows are numbered
    return page.withColumn("beyond", F.row_number().over(Window.orderBy("key")) > 10)


_BYTES = "octet_length(encode(text))"


@register("byte_budget_prefix", f"with r as (select conv_id, turn, cast(coalesce(sum({_BYTES}) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as bigint) as bytes_before from conversations) select * from r where bytes_before < 1000")
def byte_budget_prefix(spark, d):
    rows = lift.messages(spark, d)
    return Q.byte_budget(rows, F.octet_length("text"), 1000, "turn", partition=("conv_id",)).select("conv_id", "turn", "bytes_before")


@register("page_byte_budget", f"with r as (select conv_id, turn, sum({_BYTES}) over (partition by conv_id order by turn) as upto from conversations) select conv_id, turn from r where upto <= 1000")
def page_byte_budget(spark, d):
    return Q.byte_budget(lift.messages(spark, d), F.octet_length("text"), 1000, "turn", partition=("conv_id",), crossing=False).select("conv_id", "turn")


_SUMMARY = ", r as (select harness, session_id, count(distinct id) as records from ev group by all), e as (select harness, session_id, count(*) as events, min(\"timestamp\") as first_timestamp, max(\"timestamp\") as last_timestamp from col group by all) select r.harness, r.session_id, r.records, {n} as events, first_timestamp, last_timestamp from r {join} e on r.harness = e.harness and r.session_id = e.session_id"


@register("session_summaries", EV + COLLAPSED.format(source="ev") + _SUMMARY.format(n="coalesce(e.events, 0)", join="left join"))
def session_summaries(spark, d):
    e = lift.events(spark, d)
    return Q.summaries(e.select(F.col("record_id").alias("id"), *Q.SESSION), e, Q.Query())


@register("session_summaries_filtered", EV + ", f as (select * from ev where kind = 'tool_result' and contains(text, '42'))" + COLLAPSED.format(source="f") + _SUMMARY.format(n="e.events", join="join"))
def session_summaries_filtered(spark, d):
    e = lift.events(spark, d)
    return Q.summaries(e.select(F.col("record_id").alias("id"), *Q.SESSION), e, Q.Query(kind="tool_result", text="42"))


@register("record_keys", EV + " select id, harness, session_id from ev where harness = 'codex' and session_id = 'u3'")
def record_keys(spark, d):
    records = lift.events(spark, d).select(F.col("record_id").alias("id"), *Q.SESSION, "text")
    return Q.record_keys(records, Q.Query(harness="codex", session="u3"))


@register(
    "session_search",
    "select 'pi' as harness, 'c' || conv_id as session_id, count(*) as events, arg_min(left(text, 100), turn) filter (where text <> '') as preview from conversations group by conv_id having bool_or(coalesce(contains(lower(text), 'tion'), false))",
)
def session_search(spark, d):
    return Q.search_sessions(lift.messages(spark, d), "TION")


@register("session_ambiguity", "with s as (select case user_id % 3 when 0 then 'codex' when 1 then 'pi' else 'cursor' end as harness, 's' || (user_id % 40) as session_id from events) select session_id, count(distinct harness) as harnesses from s group by session_id having count(distinct harness) > 1")
def session_ambiguity(spark, d):
    e = lift.events(spark, d).withColumn("session_id", F.concat(F.lit("s"), (F.substring("session_id", 2, 20).cast("long") % 40).cast("string")))
    return Q.ambiguous_sessions(e)


@register("find_event", EV + " select id, kind, text, is_hook from ev where id = '4' order by batch_ord limit 1")
def find_event(spark, d):
    return Q.find_event(lift.events(spark, d), "4").select("id", "kind", "text", "is_hook")


@register("export_semi", EV + ", f as (select * from ev where kind = 'message' and contains(text, '1'))" + COLLAPSED.format(source="f") + " select id, session_id from ev where id in (select record_id from col)")
def export_semi(spark, d):
    e = lift.events(spark, d)
    recs, _ = Q.export(e.select(F.col("record_id").alias("id"), *Q.SESSION), e, Q.Query(kind="message", text="1"))
    return recs.select("id", "session_id")


@register("bounded_items", "with i as (select conv_id, turn, text, octet_length(encode(cast(to_json({conv_id: conv_id, turn: turn, text: text}) as varchar))) as size, cast(to_json({conv_id: conv_id, turn: turn, text: text}) as varchar) as j from conversations) select conv_id, turn, size > 600 as truncated, case when size > 600 then cast(size as bigint) end as bytes, left(j, 40) as shown from i")
def bounded_items(spark, d):
    m = lift.messages(spark, d).select("conv_id", "turn", "text")
    item = Q.bounded_item(m, 600, 40, keep=("conv_id", "turn"))
    shown = F.coalesce(F.get_json_object("item", "$.preview"), F.substring("item", 1, 40))
    return item.select("conv_id", "turn", (F.get_json_object("item", "$.truncated") == "true").alias("t"), F.get_json_object("item", "$.bytes").cast("long").alias("bytes"), shown.alias("shown")).select("conv_id", "turn", F.coalesce("t", F.lit(False)).alias("truncated"), "bytes", "shown")


@register(
    "status_counts",
    EV + ", b as (select distinct harness, 'b' || strftime(cast(\"timestamp\" as timestamp), '%m%d') || harness as batch_id from ev), m as (select 'east' as remote, 1 as k union all select 'west', 2), "
    "l as (select b.harness, count(*) as n from b, m where not (m.remote = 'east' and b.batch_id < 'b0110') group by 1), u as (select harness, max(batch_id) as newest from b where batch_id < 'b0110' group by 1) "
    "select ev.harness, count(distinct source_id) as sources, count(*) as captured_records, count(*) filter (where kind = 'metadata') as parse_failures, count(*) filter (where kind = 'unknown') as unknown_records, count(*) filter (where is_hook) as pending_records, "
    "cast(coalesce(sum(octet_length(encode(text))) filter (where is_hook), 0) as bigint) as pending_bytes, (select count(*) from b where b.harness = ev.harness) as batches, coalesce(max(l.n), 0) as pending_uploads, max(u.newest) as last_upload "
    "from ev left join l on l.harness = ev.harness left join u on u.harness = ev.harness group by ev.harness",
)
def status_counts(spark, d):
    """What each harness's collector has seen; a batch a day, of which one remote has those of the first nine."""
    e = lift.events(spark, d)
    seen = e.select("harness", F.when(F.col("kind") == "metadata", "malformed").when(F.col("kind") == "unknown", "unknown").otherwise("parsed").alias("status"))
    batches = e.select("harness", F.concat(F.lit("b"), F.substring("timestamp", 6, 2), F.substring("timestamp", 9, 2), "harness").alias("batch_id")).distinct()
    done = batches.where("batch_id < 'b0110'").select(F.lit("east").alias("remote"), "batch_id", F.col("batch_id").alias("completed_at"))
    remotes = spark.createDataFrame([("east",), ("west",)], "remote string")
    return status(e.select("harness", "source_id").distinct(), seen, e.where("is_hook").select("harness", F.octet_length("text").alias("bytes")), batches, done, remotes, by="harness")


def _blocks(batches):
    """Events of one message for each row, by the content's JSON."""
    import pyarrow as pa

    from ..functions import payloads
    from ..sources import normalize

    for batch in batches:
        rows = []
        for event_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = normalize._contents({"content": payloads.loads(content)}, "assistant")
            rows += [(event_id, k, e["kind"], e["text"], e["tool_call_id"]) for k, e in enumerate(found)]
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["event_id", "sub_index", "kind", "text", "tool_call_id"])


@register(
    "block_explode",
    "with e as (select event_id, event_type, cast(json_extract_string(props, '$.k') as bigint) as k from events), x as (select *, unnest(range(case when k % 5 = 4 then 1 else k % 5 end)) as sub_index from e) "
    "select event_id, sub_index, case when k % 5 = 4 then 'message' else case sub_index when 0 then 'message' when 1 then 'tool_call' else 'unknown' end end as kind, "
    "case when k % 5 = 4 or sub_index = 0 then event_type end as text, case when k % 5 <> 4 and sub_index = 1 then 'c' || k end as tool_call_id from x",
)
def block_explode(spark, d):
    """Messages whose content is a string, or a list of up to three parts."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    parts = [F.to_json(F.struct(F.lit("text").alias("type"), F.col("event_type").alias("text"))), F.to_json(F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("c"), "k").alias("id"))), F.lit('{"type":"of no kind"}')]
    listed = F.concat(F.lit("["), F.array_join(F.slice(F.array(*parts), F.lit(1), (F.col("k") % 5).cast("int")), ","), F.lit("]"))
    content = F.when(F.col("k") % 5 == 4, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise(listed)
    return e.select("event_id", content.alias("content")).mapInArrow(_blocks, "event_id long, sub_index long, kind string, text string, tool_call_id string")


@register("tool_parts_json", "select event_id, event_type as name, case when event_id % 3 = 0 then 'nested' end as shape from events where event_type in ('view', 'click')")
def tool_parts_json(spark, d):
    """The tool's name in two shapes of payload, by the operator that outcome checks use."""
    e = spark.read.parquet(f"{d}/events.parquet").where(F.col("event_type").isin("view", "click"))
    nested = F.col("event_id") % 3 == 0
    flat, tagged = F.to_json(F.struct(F.col("event_type").alias("name"), F.col("props").alias("arguments"))), F.concat(F.lit('{"tool_call":{"'), "event_type", F.lit('":{"args":'), "props", F.lit("}}}"))
    return e.select("event_id", tool_name(F.when(nested, tagged).otherwise(flat)).alias("name"), F.when(nested, "nested").alias("shape"))


_SHAPES = """
with e as (select event_id, event_type, replace(props, ' ', '') as p, event_id % 5 as shape from events where event_type in ('view', 'click'))"""


def _tool_events(spark, d):
    """Calls (views) and results (clicks), each in five shapes of payload."""
    e = spark.read.parquet(f"{d}/events.parquet").where(F.col("event_type").isin("view", "click"))
    p, shape = F.col("props"), F.col("event_id") % 5
    escaped = F.replace(p, F.lit('"'), F.lit('\\"'))

    def made(*shapes):
        out = None
        for k, parts in enumerate(shapes):
            one = F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in parts))
            out = F.when(shape == k, one) if out is None else out.when(shape == k, one)
        return out

    call = made(
        ('{"name": "view", "id": "', F.col("event_id").cast("string"), '", "arguments": ', p, "}"),
        ('{"input": "', escaped, '", "tool_name": "view"}'),
        ('{"tool_call": {"view": {"args": ', p, "}}}"),
        ('{"what": [', p, ", null]}"),
        ('{"name": null, "arguments": "not {json"}',),
    )
    result = made(
        ('{"output": ', p, ', "content": 1}'),
        ('{"result": {"b": ', p, ', "a": "x"}}'),
        ('{"tool_call": {"view": {"result": ', p, '}, "other": 1}}'),
        ('{"output": null, "content": ', p, "}"),
        ('{"said": ', p, "}"),
    )
    return e.select("event_id", F.when(F.col("event_type") == "view", "tool_call").otherwise("tool_result").alias("kind"), F.when(F.col("event_type") == "view", call).otherwise(result).alias("payload_json"))


@register(
    "action_keys",
    _SHAPES + """ select event_id, case when shape < 3 then '{"arguments":' || p || ',"kind":"tool_call","name":"view"}'
      when shape = 3 then '{"kind":"tool_call","payload":{"what":[' || p || ',null]},"text":null}'
      else '{"arguments":"not {json","kind":"tool_call","name":null}' end as key from e where event_type = 'view'""",
)
def action_keys(spark, d):
    """Keys of tool calls in five shapes: alike for the same tool and arguments, whatever the shape."""
    calls = _tool_events(spark, d).where("kind = 'tool_call'")
    return calls.select("event_id", action_key("kind", F.lit(None).cast("string"), F.lit(None).cast("string"), "payload_json").alias("key"))


@register(
    "result_contents",
    _SHAPES + """ select event_id, case shape when 0 then p when 1 then '{"a":"x","b":' || p || '}' when 2 then '{"view":' || p || '}' end as content from e where event_type = 'click'""",
)
def result_contents(spark, d):
    """What results hold: the first field there is counts, even if it holds null."""
    return _tool_events(spark, d).where("kind = 'tool_result'").select("event_id", result_text("payload_json").alias("content"))


# --- catalog of batches ----------------------------------------------------


def _batches(spark, d):
    """One batch a day; every third replaces the two days before it."""
    e = spark.read.parquet(f"{d}/events.parquet")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    b = e.groupBy(day.cast("long").alias("day")).agg(F.sum(F.octet_length("props")).alias("bytes"), F.count("*").alias("ids"))
    name = lambda c: F.concat(F.lit("b"), c.cast("string"))
    replaces = F.when(F.col("day") % 3 == 2, F.array(name(F.col("day") - 1), name(F.col("day") - 2))).otherwise(F.array().cast("array<string>"))
    return b.select(F.lit("me").alias("collector_id"), name(F.col("day")).alias("batch_id"), "day", "bytes", "ids", replaces.alias("replaces"))


_B = "with b as (select date_diff('day', date '2024-01-01', cast(ts as date)) as day, cast(sum(octet_length(encode(props))) as bigint) as bytes, count(*) as ids from events group by 1)"


@register("manifest_active_anti", _B + " select 'b' || day as batch_id, bytes from b where day not in (select day - 1 from b where day % 3 = 2 union all select day - 2 from b where day % 3 = 2)")
def manifest_active_anti(spark, d):
    return active_manifests(_batches(spark, d)).select("batch_id", "bytes")


@register("upload_backlog", _B + " select r.remote, count(*) as backlog, cast(sum(bytes) as bigint) as bytes from b, (values ('east', 2), ('west', 5)) r(remote, k) where b.day % r.k <> 0 group by r.remote")
def upload_backlog_query(spark, d):
    b = _batches(spark, d)
    remotes = spark.createDataFrame([("east", 2), ("west", 5)], "remote string, k int")
    done = b.join(F.broadcast(remotes), F.col("day") % F.col("k") == 0).select("remote", "batch_id")
    return upload_backlog(b, remotes.select("remote"), done)


@register(
    "compaction_groups",
    _B.replace("with", "with recursive") + ", m as (select cast(sum(bytes) * 7 // (count(*) * 2) as bigint) as most from b), s as (select b.*, most, row_number() over (order by day) as r from b, m), f as (select r, day, case when bytes > most then 0 else bytes end as size, 0 as g, bytes <= most as member from s where r = 1 union all select s.r, s.day, "
    "case when s.bytes > most then 0 when f.size + s.bytes > most then s.bytes else f.size + s.bytes end, f.g + case when f.size > 0 and f.size + s.bytes > most then 1 else 0 end, s.bytes <= most from f join s on s.r = f.r + 1), "
    "n as (select g, count(*) as members, min(day) as first_day, max(day) as last_day from f where member group by g having count(*) >= 2) select members, first_day, last_day from n",
)
def compaction_groups_query(spark, d):
    """Groups within three and a half times the mean size of a batch."""
    b = _batches(spark, d)
    total = b.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).first()
    groups = compaction_groups(b, total["bytes"] * 7 // (total["n"] * 2), order="day")
    return groups.groupBy("group").agg(F.count("*").alias("members"), F.min("day").alias("first_day"), F.max("day").alias("last_day")).drop("group")


@register(
    "manifest_validate",
    """
with m as (
  select doc_id, doc_id % 13 as k, case doc_id % 13 when 1 then 2 else 1 end as version, case doc_id % 13 when 2 then '../b' else 'b' || doc_id end as batch_id,
    case doc_id % 13 when 3 then '2026-02-30T10:00:00Z' else '2026-10-01T10:00:00.000Z' end as created_at, sha256(coalesce(text, '')) as h, octet_length(encode(coalesce(text, ''))) as size
  from documents
), f as (
  select *, case k when 6 then 'records/../x' else 'records/part-' || doc_id end as p1, case k when 8 then 'records/other' else 'events/part-' || doc_id end as p2, case k when 7 then upper(h) || 'A' else h end as s1,
    case k when 12 then 9007199254740992 else size end as z1 from m
), v as (
  select doc_id,
    case when version <> 1 then 'another schema version' end as a,
    case when not regexp_full_match(batch_id, '[A-Za-z0-9_-]{1,128}') then 'ids that may not be paths' end as b,
    case when try_cast(replace(created_at, 'Z', '') as timestamp) is null then 'no time of creation' end as c,
    case when k = 4 or contains(p1, '/../') or not regexp_full_match(s1, '[0-9a-f]{64}') or z1 > 9007199254740991 or (k = 5) then 'an inventory out of order' end as d,
    case when k = 4 or not starts_with(p2, 'events/') then 'a table without files' end as e,
    case when k in (9, 10) then 'a list of replaced batches out of order' end as g
  from f
)
select doc_id, concat_ws('; ', a, b, c, d, e, g) as problems, concat_ws('; ', a, b, c, d, e, g) = '' as valid from v""",
)
def manifest_validate(spark, d):
    """Manifests made of documents, each thirteenth with another fault."""
    from ..operators.catalog import manifest_problems

    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", (F.col("doc_id") % 13).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    is_ = lambda n: F.col("k") == n
    own = F.sha2("text", 256)
    size = F.when(is_(12), F.lit(1 << 53)).otherwise(F.octet_length("text").cast("long"))
    one = F.struct(F.when(is_(6), F.lit("records/../x")).otherwise(F.concat(F.lit("records/part-"), "doc_id")).alias("path"), size.alias("size"), F.when(is_(7), F.concat(F.upper(own), F.lit("A"))).otherwise(own).alias("sha256"))
    two = F.struct(F.when(is_(8), F.lit("records/other")).otherwise(F.concat(F.lit("events/part-"), "doc_id")).alias("path"), F.lit(1).cast("long").alias("size"), F.sha2(F.lit("x"), 256).alias("sha256"))
    none = F.array().cast("array<struct<path:string,size:bigint,sha256:string>>")
    batch = F.when(is_(2), F.lit("../b")).otherwise(F.concat(F.lit("b"), "doc_id"))
    m = t.select(
        "doc_id", F.when(is_(1), 2).otherwise(1).cast("long").alias("schema_version"), F.lit("me").alias("collector_id"), batch.alias("batch_id"),
        F.when(is_(3), F.lit("2026-02-30T10:00:00Z")).otherwise(F.lit("2026-10-01T10:00:00.000Z")).alias("created_at"),
        F.array().cast("array<struct<harness:string,session_id:string,records:bigint,events:bigint,first_timestamp:string,last_timestamp:string>>").alias("sessions"),
        F.when(is_(4), none).when(is_(5), F.array(one, one, two)).otherwise(F.array(one, two)).alias("files"),
        F.when(is_(9), F.array(batch)).when(is_(10), F.array(F.lit("x"), F.lit("x"))).when(is_(11), F.array(F.lit("x"), F.lit("y"))).otherwise(F.array().cast("array<string>")).alias("replaces"),
    )
    problems = manifest_problems()
    return m.select("doc_id", F.array_join(problems, "; ").alias("problems"), (F.size(problems) == 0).alias("valid"))


# --- trajectories ----------------------------------------------------------


@register("steps_asof_attach", STEPS + " select harness, session_id, id, cast(call_at as bigint) as call_at from steps where kind = 'tool_result'")
def steps_asof_attach(spark, d):
    s = T.spread_steps(T.spread_chronology(lift.events(spark, d)))
    return s.where("kind = 'tool_result'").select("harness", "session_id", "id", F.col("call_at").cast("long").alias("call_at"))


@register("step_numbering", STEPS + " select harness, session_id, id, cast(step as bigint) as step, is_head from steps")
def step_numbering(spark, d):
    return T.spread_steps(T.spread_chronology(lift.events(spark, d))).select("harness", "session_id", "id", F.col("step").cast("long").alias("step"), "is_head")


@register("final_output", AT + ", h as (select harness, session_id, arg_max(kind, nth) as k, arg_max(role, nth) as r, arg_max(text, nth) as t from seen where kind in ('message', 'tool_call', 'tool_result') group by all) select harness, session_id, t as final_output from h where k = 'message' and r = 'assistant'")
def final_output(spark, d):
    return T.final_output(T.chronology(lift.events(spark, d)))


@register(
    "branch_ancestry",
    "with recursive e as (select 'u' || user_id as session_id, event_id as id, lag(event_id) over (partition by user_id order by event_id) as parent_id from events), l as (select session_id, max(id) as leaf from e group by 1), "
    "w as (select e.session_id, l.leaf, e.id, e.parent_id, 0 as hops from e join l on e.session_id = l.session_id and e.id = l.leaf union all select w.session_id, w.leaf, e.id, e.parent_id, w.hops + 1 from w join e on e.session_id = w.session_id and e.id = w.parent_id) select session_id, leaf, id, hops from w",
)
def branch_ancestry(spark, d):
    return _chains(spark.read.parquet(f"{d}/events.parquet"))


def _chains(e):
    entry = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_id").alias("id"), F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("parent_id"))
    return T.ancestry(entry, T.leaves_of(entry))


@register("judge_prefix_len", "select 'c' || conv_id as session_id, turn as position, row_number() over w as prefix_events, cast(sum(length(text)) over w as bigint) as prefix_chars from conversations window w as (partition by conv_id order by turn rows between unbounded preceding and current row)")
def judge_prefix_len(spark, d):
    m = lift.messages(spark, d).withColumn("at", F.col("turn"))
    p = T.judge_prefix(m)
    return p.select("session_id", F.col("at").alias("position"), "prefix_events", "prefix_chars")


# --- matching --------------------------------------------------------------


@register("match_strict", PAIRS + " select c.pair, c.idx as candidate_step, o.idx as oracle_step from c join o on c.pair = o.pair and c.idx = o.idx and c.key = o.key")
def match_strict(spark, d):
    return M.strict(*lift.run_pairs(spark, d))


@register("match_unordered", UNORDERED + " select * from m")
def match_unordered(spark, d):
    return M.unordered(*lift.run_pairs(spark, d))


#: The alignment's recurrence and its way back over scores (pair, c, o, s) above a threshold, on dense numbers of the steps that have one.
ALIGN = """
, sc as (select pair, c, o, s, dense_rank() over (partition by pair order by c) as i, dense_rank() over (partition by pair order by o) as j from scored),
dims as (select pair, max(i) as n, max(j) as m from sc group by 1),
dp(pair, i, j, v) as (
  select pair, cast(0 as bigint), unnest(range(m + 1)), cast(0 as double) from dims
  union all
  select pair, i + 1, j, max(b) over (partition by pair order by j) from (
    select d.pair, d.i, d.j, greatest(d.v, case when sc.s > {least} then lag(d.v) over (partition by d.pair order by d.j) + sc.s else 0 end) as b
    from dp d join dims on dims.pair = d.pair and d.i < dims.n left join sc on sc.pair = d.pair and sc.i = d.i + 1 and sc.j = d.j
  )
), back(pair, i, j, hit) as (
  select pair, n, m, false from dims
  union all
  select b.pair, case when x.v = up.v then b.i - 1 when x.v = le.v then b.i else b.i - 1 end, case when x.v = up.v then b.j when x.v = le.v then b.j - 1 else b.j - 1 end, x.v <> up.v and x.v <> le.v
  from back b join dp x on x.pair = b.pair and x.i = b.i and x.j = b.j join dp up on up.pair = b.pair and up.i = b.i - 1 and up.j = b.j join dp le on le.pair = b.pair and le.i = b.i and le.j = b.j - 1 where b.i > 0 and b.j > 0
), hits as (select b.pair, sc.c as candidate_step, sc.o as oracle_step, sc.s as similarity from back b join sc on sc.pair = b.pair and sc.i = b.i + 1 and sc.j = b.j + 1 where b.hit)"""


@register("match_required", PAIRS.replace("with st", "with recursive st") + ", scored as (select c.pair, c.idx as c, o.idx as o, cast(1 as double) as s from c join o on c.pair = o.pair and c.key = o.key where o.idx % 2 = 0)" + ALIGN.format(least="0.5") + " select pair, candidate_step, oracle_step from hits")
def match_required(spark, d):
    o, c = lift.run_pairs(spark, d)
    return M.required(o, c, o.where("idx % 2 = 0").select("pair", "idx"))


@register(
    "align_monotone",
    PAIRS.replace("with st", "with recursive st")
    + r""", ow as (select pair, idx, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as term from o), ot as (select pair, idx, term, count(*) as tf from ow group by all), sz as (select pair, idx, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as size from o),
st2 as (select pair, count(*) as docs, avg(size) as av from sz group by 1), df as (select pair, term, count(*) as df from ot group by all), q as (select distinct pair, idx, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as term from c),
scored as (select q.pair, q.idx as c, ot.idx as o, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / av))) as s from q join ot on ot.pair = q.pair and ot.term = q.term join df on df.pair = q.pair and df.term = q.term join sz on sz.pair = q.pair and sz.idx = ot.idx join st2 on st2.pair = q.pair group by all)"""
    + ALIGN.format(least="0.1") + " select pair, candidate_step, oracle_step, round(similarity, 6) as similarity from hits",
)
def align_monotone(spark, d):
    o, c = lift.run_pairs(spark, d)
    scored = M.bm25(o.select("pair", F.col("idx").alias("doc"), "text"), c.select("pair", F.col("idx").alias("query"), "text"), ("pair",))
    aligned = M.monotone(scored.select("pair", F.col("query").alias("candidate_step"), F.col("doc").alias("oracle_step"), "score", "weight"))
    return aligned.withColumn("similarity", F.round("similarity", 6))


_BM25 = """
with cw as (select doc_id as doc, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from documents where text is not null), ct as (select doc, term, count(*) as tf from cw group by all),
sz as (select doc_id as doc, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as size from documents where text is not null), st as (select count(*) as docs, avg(size) as av from sz), df as (select term, count(*) as df from ct group by 1),
q as (select distinct item_id as query, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from benchmark)
, s as (select ct.doc, q.query, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / av))) as score from q join ct on q.term = ct.term join df on df.term = q.term join sz on sz.doc = ct.doc cross join st group by all)
"""


def _bm25_documents(spark, d):
    docs, items = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    return M.bm25_corpus(docs.where("text is not null").select(F.col("doc_id").alias("doc"), "text"), items.select(F.col("item_id").alias("query"), "text"))


@register("bm25_scores", _BM25 + "select doc, query, round(score, 6) as score from s")
def bm25_scores(spark, d):
    return _bm25_documents(spark, d).select("doc", "query", F.round("score", 6).alias("score"))


@register("bm25_topk", _BM25 + ", r as (select *, row_number() over (partition by query order by round(score, 6) desc, doc) as rank from s) select query, doc, cast(rank as integer) as rank from r where rank <= 5")
def bm25_topk(spark, d):
    docs, items = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    return bm25_top(docs.where("text is not null").select(F.col("doc_id").alias("doc"), "text"), items.select(F.col("item_id").alias("query"), "text"), 5).select("query", "doc", "rank")


@register("diff_strict", PAIRS + " select coalesce(o.pair, c.pair) as pair, coalesce(o.idx, c.idx) + 1 as step, case when o.key is null then 'added' when c.key is null then 'missing' else 'changed' end as change from o full join c on o.pair = c.pair and o.idx = c.idx where o.key is distinct from c.key")
def diff_strict(spark, d):
    return M.diff_strict(*lift.run_pairs(spark, d))


_ALIGNED = UNORDERED + ", x as (select c.pair, c.idx + 1 as step, 'added' as change from c left join m on m.pair = c.pair and m.candidate_step = c.idx where m.pair is null union all select o.pair, o.idx + 1, 'missing' from o left join m on m.pair = o.pair and m.oracle_step = o.idx where m.pair is null)"


@register("diff_aligned", _ALIGNED + " select * from x")
def diff_aligned(spark, d):
    o, c = lift.run_pairs(spark, d)
    return M.diff_aligned(o, c, M.unordered(o, c))


@register("repeated_steps", PAIRS + ", r as (select pair, idx, row_number() over (partition by pair, key order by idx) as n from c) select pair, idx + 1 as step from r where n > 1")
def repeated_steps(spark, d):
    return M.repeated(lift.run_pairs(spark, d)[1])


_COVER = ", os as (select pair, count(*) as n from o group by 1), cs as (select pair, count(*) as n, count(distinct key) as k from c group by 1), ms as (select pair, count(distinct oracle_step) as n from m group by 1), g as (select os.pair, round(coalesce(ms.n, 0) / os.n, 6) as coverage, round((cs.n - cs.k) / cs.n, 6) as repetition from os join cs on os.pair = cs.pair left join ms on ms.pair = os.pair)"


def _diagnosed(spark, d):
    o, c = lift.run_pairs(spark, d)
    g = M.diagnostics(o, c, M.unordered(o, c))
    return g.withColumns({k: F.round(k, 6) for k in ("coverage", "repetition")})


@register("reference_coverage", UNORDERED + _COVER + " select * from g")
def reference_coverage(spark, d):
    return _diagnosed(spark, d)


@register(
    "gate_assess",
    UNORDERED + _COVER + ", f as (select pair, case when coverage < 0.5 then 'coverage ' || printf('%.4f', coverage) || ' is below 0.5000' end as a, case when repetition > 0.2 then 'repetition ' || printf('%.4f', repetition) || ' is above 0.2000' end as b from g) select pair, concat_ws('; ', a, b) as failures, a is null and b is null as passed from f",
)
def gate_assess(spark, d):
    out = A.gate_failures(_diagnosed(spark, d), {"coverage": 0.5}, {"repetition": 0.2})
    return out.select("pair", F.array_join("failures", "; ").alias("failures"), "passed")


@register(
    "best_variant",
    _ALIGNED + ", v as (select pair, 'aligned' as variant, count(*) as n, 1 as ord from x group by 1 union all select coalesce(o.pair, c.pair), 'strict', count(*), 0 from o full join c on o.pair = c.pair and o.idx = c.idx where o.key is distinct from c.key group by 1), "
    "r as (select *, row_number() over (partition by pair order by n > 3, case when n <= 3 then 0 else n end, ord) as k from v) select pair, variant, n <= 3 as passed from r where k = 1",
)
def best_variant(spark, d):
    o, c = lift.run_pairs(spark, d)
    variants = [("strict", 0, M.diff_strict(o, c)), ("aligned", 1, M.diff_aligned(o, c, M.unordered(o, c)))]
    checks = None
    for name, order, changes in variants:
        v = changes.groupBy("pair").agg(F.count("*").alias("n_changes")).select("pair", F.lit(name).alias("variant"), (F.col("n_changes") <= 3).alias("passed"), (F.col("n_changes") > 3).cast("int").alias("n_failures"), "n_changes", F.lit(order).alias("ord"))
        checks = v if checks is None else checks.union(v)
    return A.best_variant(checks)


@register("last_oracle_so_far", UNORDERED + " select c.pair, c.idx as candidate_step, last_value(m.oracle_step ignore nulls) over (partition by c.pair order by c.idx rows between unbounded preceding and current row) as oracle_so_far from c left join m on m.pair = c.pair and m.candidate_step = c.idx")
def last_oracle_so_far(spark, d):
    o, c = lift.run_pairs(spark, d)
    return M.last_matched(c, M.unordered(o, c))


# --- labels ----------------------------------------------------------------


def _revisions(spark, d):
    """Labels as revisions: every seventh document is a task, of whose steps some are relabelled."""
    r = spark.read.parquet(f"{d}/labels.parquet")
    key = [(F.col("doc_id") % 7).cast("string").alias("task"), (F.floor(F.col("doc_id") / 7) % 5).cast("string").alias("trajectory"), F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 4).alias("step")]
    rows = r.select(*key, F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("id"), F.col("quality").alias("reward"), "toxic")
    before = F.lag("id").over(Window.partitionBy(*A.LABEL_KEY).orderBy("seq"))
    return rows.withColumn("supersedes", F.when(F.col("seq") % 11 != 0, before))


_REV = "with k as (select cast(doc_id % 7 as varchar) as task, cast((doc_id // 7) % 5 as varchar) as trajectory, case when doc_id % 4 <> 0 then doc_id % 4 end as step, doc_id as seq, cast(doc_id as varchar) as id, quality as reward, toxic from labels), rev as (select *, lag(id) over (partition by task, trajectory, step order by seq) as prev from k), cur as (select * from rev qualify row_number() over (partition by task, trajectory, step order by seq desc) = 1)"


@register("labels_current", _REV + " select task, trajectory, step, id, reward from cur")
def labels_current(spark, d):
    return A.current_labels(_revisions(spark, d)).select("task", "trajectory", "step", "id", "reward")


@register("label_chain_valid", _REV + " select id, case when seq % 11 <> 0 then prev end is not distinct from prev as valid from rev")
def label_chain_valid(spark, d):
    return A.label_chain(_revisions(spark, d)).select("id", "valid")


@register("human_assess", _REV + ", s as (select cast(t as varchar) as trajectory, 4 as steps from range(5) r(t)) select task, cur.trajectory, max(case when step is null then reward end) as task_reward, round(avg(case when step is not null then reward end), 6) as mean_reward, round(count(step) / max(s.steps), 6) as coverage from cur join s on s.trajectory = cur.trajectory group by all")
def human_assess(spark, d):
    steps = spark.range(20).select((F.col("id") % 5).cast("string").alias("trajectory"))
    out = A.human_assessment(_revisions(spark, d), steps)
    return out.withColumns({"mean_reward": F.round("mean_reward", 6), "coverage": F.round("coverage", 6)})


@register(
    "calibrate_grouping_sets",
    "with p as (select 'j' || (doc_id % 3) as judge, quality as human, case when doc_id % 5 = 0 then 1 - quality else quality end as predicted from labels), t as (select judge, count(*) as n, count(*) filter (where predicted = 1 and human = 1) as tp, count(*) filter (where predicted = 0 and human = 0) as tn, count(*) filter (where predicted = 1 and human = 0) as fp, count(*) filter (where predicted = 0 and human = 1) as fn from p group by grouping sets ((), (judge))) "
    "select judge, n, tp, tn, fp, fn, round((tp + tn) / n, 6) as agreement, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall from t",
)
def calibrate_grouping_sets(spark, d):
    r = spark.read.parquet(f"{d}/labels.parquet")
    pairs = r.select(F.concat(F.lit("j"), (F.col("doc_id") % 3).cast("string")).alias("judge"), F.col("quality").alias("human"), F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("predicted"))
    out = A.calibrate(pairs)
    return out.withColumns({k: F.round(k, 6) for k in ("agreement", "precision", "recall")})


@register("required_work_coverage", "select doc_id % 9 as pair, round(count(*) filter (where quality = 1) / count(*), 6) as coverage from labels group by 1")
def required_work_coverage(spark, d):
    r = spark.read.parquet(f"{d}/labels.parquet").select((F.col("doc_id") % 9).alias("pair"), (F.col("quality") == 1).alias("passed"))
    return A.work_coverage(r).withColumn("coverage", F.round("coverage", 6))


@register("mean_rewards", "select doc_id % 9 as pair, d.dimension, round(avg(case d.dimension when 'quality' then quality else toxic end), 6) as mean_reward from labels, (values ('quality'), ('toxic')) d(dimension) group by all")
def mean_rewards(spark, d):
    r = spark.read.parquet(f"{d}/labels.parquet")
    scores = r.select((F.col("doc_id") % 9).alias("pair"), F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).alias("dimension", "reward"))
    return A.mean_rewards(scores).withColumn("mean_reward", F.round("mean_reward", 6))


# --- ingest ----------------------------------------------------------------


def _positions(batches):
    import pyarrow as pa

    from ..sources import normalize

    for batch in batches:
        rows = [(user, nth, at) for user, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for nth, (at, _) in enumerate(normalize.lines(content))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["user_id", "nth", "position"])


@register(
    "jsonl_ingest_offsets",
    "with r as (select user_id, event_id, row_number() over w - 1 as nth, cast(coalesce(sum(octet_length(encode(props)) + 1) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as bigint) as position from events window w as (partition by user_id order by event_id)) select user_id, nth, position from r",
)
def jsonl_ingest_offsets(spark, d):
    """Byte positions of complete lines, were each user's properties a file that ends in the middle of a line."""
    e = spark.read.parquet(f"{d}/events.parquet")
    own = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "props"))), lambda x: F.concat(x["props"], F.lit("\n")))
    files = e.groupBy("user_id").agg(F.concat(F.array_join(own, ""), F.lit('{"cut o')).cast("binary").alias("content"))
    return files.mapInArrow(_positions, "user_id long, nth long, position long")


def _statuses(batches):
    import pyarrow as pa

    from ..sources import normalize

    source = {"harness": "pi", "session": "s", "source_id": "x"}
    for batch in batches:
        found = [normalize.parse(source, i, raw.encode()) for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x["status"] for x in found]), pa.array([len(x["events"]) for x in found], pa.int64())], ["event_id", "status", "events"])


@register("record_status", "select event_id, case event_id % 4 when 0 then 'malformed' when 1 then 'malformed' when 2 then 'parsed' else 'unknown' end as status, cast(case when event_id % 4 < 2 then 0 else 1 end as bigint) as events from events")
def record_status(spark, d):
    """Status of lines: cut off, followed by something, of a known type, of none."""
    e = spark.read.parquet(f"{d}/events.parquet")
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.substring("props", 1, 4)).when(k == 1, F.concat("props", F.lit(" x"))).when(k == 2, F.replace("props", F.lit('{"k"'), F.lit('{"type": "compaction", "k"'))).otherwise(F.col("props"))
    return e.select("event_id", raw.alias("raw")).mapInArrow(_statuses, "event_id long, status string, events long")


@register(
    "inventory_verify",
    "select cast(doc_id as varchar) as path, case when doc_id % 10 = 1 then 'missing' when doc_id % 10 = 2 then 'unlisted' else 'changed' end as problem from documents where text is not null and (doc_id % 10 in (1, 2) or (doc_id % 10 = 3 and text <> ''))",
)
def inventory_verify(spark, d):
    """An inventory of texts as files against files of which some are lost, added or cut."""
    from ..operators.catalog import verify_inventory

    t = spark.read.parquet(f"{d}/documents.parquet").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), "text", (F.col("doc_id") % 10).alias("k"))
    inventory = t.where("k <> 2").select("path", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"))
    content = F.when(F.col("k") == 3, F.expr("left(text, char_length(text) - 1)")).otherwise(F.col("text")).cast("binary")
    files = t.where("k <> 1").select("path", content.alias("content")).withColumn("length", F.octet_length("content").cast("long"))
    return verify_inventory(files, inventory)

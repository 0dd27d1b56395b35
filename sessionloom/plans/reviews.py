"""Registered queries of comparisons, labels and upkeep, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions.workspace import fresh_dir
from ..operators import assessment as A
from ..operators import catalog as C
from ..operators import human as H
from ..operators import plan as PL
from ..operators import runs as R
from ..operators import trajectory as T
from ..operators.evaluation import Evidence, judge_inputs
from ..operators.outcomes import all_of, final_contains, final_equals
from ..operators.policy import Criteria, Gates, HumanGates, Policy
from ..sources import lift
from . import catalogue
from .registration import ORACLE_SQL, register

# --- runs and plans over conversations ---------------------------------------

#: Steps are assistant messages; a pair is a conversation of an even number and the one after it.
RUN = """
with s as (
  select conv_id, turn, text, row_number() over (partition by conv_id order by turn) - 1 as idx from conversations where role = 'assistant'
), n as (
  select c.conv_id, count(*) filter (where role = 'assistant') as steps, arg_max(role, turn) as last_role, arg_max(text, turn) as last_text from conversations c group by 1
), p as (
  select a.conv_id as o, b.conv_id as c, a.last_role = 'assistant' as o_out, case when a.last_role = 'assistant' then a.last_text end as o_text, case when b.last_role = 'assistant' then b.last_text end as c_text, a.steps as o_steps, b.steps as c_steps
  from n a join n b on b.conv_id = a.conv_id + 1 where a.conv_id % 2 = 0 and a.steps > 0 and b.steps > 0
), k as (
  select 'p' || p.o as pair, s.idx, s.text from p join s on s.conv_id = p.o
), m as (
  select 'p' || p.o as pair, s.idx, s.text from p join s on s.conv_id = p.c
)"""


def _runs(spark, d):
    """All conversations as runs; written once, as a query reads them several times."""
    return R.trajectories(lift.conversation_events(spark, d), keep=R.keeper(spark, fresh_dir(spark, "runs")))


def _pairs(runs):
    """Pairs of runs that both have steps."""
    own = runs.runs.where("steps > 0").select("run", F.substring("session_id", 2, 20).cast("long").alias("n"))
    a, b = own.where("n % 2 = 0").select(F.col("run").alias("oracle"), "n"), own.where("n % 2 = 1").select(F.col("run").alias("candidate"), (F.col("n") - 1).alias("n"))
    return a.join(b, "n").select(F.concat(F.lit("p"), F.col("n").cast("string")).alias("pair"), "oracle", "candidate")


def _plan(spark, d, policy):
    runs = _runs(spark, d)
    return runs, PL.plan(_pairs(runs), runs, policy)


@register("run_summaries", RUN + " select 'c' || conv_id as session_id, steps, case when last_role = 'assistant' then last_text end as final_output, case when last_role = 'assistant' then 'trailing_assistant_message' else 'unavailable' end as final_output_source from n")
def run_summaries(spark, d):
    return _runs(spark, d).runs.select("session_id", "steps", "final_output", "final_output_source")


@register("plan_strict_alignment", RUN + " select m.pair, m.idx as candidate_step, k.idx as oracle_step from m left join k on k.pair = m.pair and k.idx = m.idx and k.text = m.text")
def plan_strict_alignment(spark, d):
    return _plan(spark, d, Policy(matching="strict"))[1].alignment.select("pair", "candidate_step", "oracle_step")


@register("plan_unmatched", RUN + " select k.pair, k.idx as oracle_step from k where not exists (select 1 from m where m.pair = k.pair and m.idx = k.idx and m.text = k.text)")
def plan_unmatched(spark, d):
    return _plan(spark, d, Policy(matching="strict"))[1].unmatched


@register("plan_differences", RUN + " select coalesce(k.pair, m.pair) as pair, case when k.idx is null then 'extra' when m.idx is null then 'missing' else 'changed' end as kind, k.idx + 1 as oracle_step, m.idx + 1 as candidate_step from k full join m on m.pair = k.pair and m.idx = k.idx where k.text is distinct from m.text")
def plan_differences(spark, d):
    return PL.differences(_plan(spark, d, Policy(matching="strict"))[1]).select("pair", "kind", "oracle_step", "candidate_step")


@register(
    "plan_diagnostics",
    RUN + ", h as (select m.pair, count(*) as n from m join k on k.pair = m.pair and k.idx = m.idx and k.text = m.text group by 1) select 'p' || p.o as pair, o_steps as oracle_steps, c_steps as candidate_steps, round(coalesce(h.n, 0) / o_steps, 6) as reference_step_coverage, (coalesce(c_text, '') <> '' and contains(c_text, 'e')) as outcome_passed from p left join h on h.pair = 'p' || p.o",
)
def plan_diagnostics(spark, d):
    criteria = Criteria.read({"outcome_checks": [{"kind": "final_contains", "id": "an e", "text": "e"}]})
    g = _plan(spark, d, Policy(matching="strict", criteria=criteria))[1].diagnostics
    return g.select("pair", "oracle_steps", "candidate_steps", F.round("reference_step_coverage", 6).alias("reference_step_coverage"), "outcome_passed")


_CHECK = RUN + """, x as (
  select coalesce(k.pair, m.pair) as pair, count(*) filter (where m.idx is null) as missing, count(*) filter (where k.idx is null) as extra, count(*) filter (where k.idx is not null and m.idx is not null) as changed
  from k full join m on m.pair = k.pair and m.idx = k.idx where k.text is distinct from m.text group by 1
), g as (
  select 'p' || p.o as pair, coalesce(missing, 0) as missing, coalesce(extra, 0) as extra, coalesce(changed, 0) as changed, o_text is distinct from c_text as out from p left join x on x.pair = 'p' || p.o
)"""


@register("check_gates", _CHECK + " select pair, missing, extra, changed, cast(missing > 0 as int) + cast(extra > 1 as int) + cast(changed > 2 as int) as n_failures, missing = 0 and extra <= 1 and changed <= 2 as passed from g")
def check_gates(spark, d):
    _, p = _plan(spark, d, Policy(matching="strict"))
    out = PL.assess(p, Gates(max_extra_steps=1, max_changed_steps=2))
    return out.select("pair", "missing", "extra", "changed", F.size("failures").alias("n_failures"), "passed")


@register(
    "check_variants",
    _CHECK + ", r as (select pair, missing + extra + changed as changes, cast(missing > 0 as int) + cast(extra > 0 as int) + cast(changed > 0 as int) + cast(out as int) as f, cast(substr(pair, 2) as bigint) as n from g), "
    "q as (select *, row_number() over (partition by n % 5 order by f > 0, case when f = 0 then 0 else f end, case when f = 0 then 0 else changes end, n) as k from r) select cast(n % 5 as varchar) as candidate, pair as variant, f = 0 as passed from q where k = 1",
)
def check_variants(spark, d):
    """Which of the pairs that share a remainder stands for them: the first that passed, else that with the fewest failures, then changes."""
    _, p = _plan(spark, d, Policy(matching="strict"))
    n = F.substring("pair", 2, 20).cast("long")
    order = p.pairs.select("pair", (n % 5).cast("string").alias("candidate"), F.col("pair").alias("variant"), n.alias("ord"))
    return PL.select_variants(PL.assess(p, Gates()), order)


@register(
    "judge_contexts",
    RUN + ", sofar as (select m.pair, m.idx, max(case when k.text = m.text then k.idx end) over (partition by m.pair order by m.idx) as o from m left join k on k.pair = m.pair and k.idx = m.idx), "
    "turns as (select 'p' || p.o as pair, s.idx, s.turn as c_turn from p join s on s.conv_id = p.c), back as (select 'p' || p.o as pair, s.idx, s.turn as o_turn from p join s on s.conv_id = p.o) "
    "select f.pair, f.idx as candidate_step, (select count(*) from conversations x where x.conv_id = cast(substr(f.pair, 2) as bigint) + 1 and x.turn <= t.c_turn) as candidate_events, "
    "(select count(*) from conversations x where x.conv_id = cast(substr(f.pair, 2) as bigint) and case when f.o is null then x.turn < b0.o_turn else x.turn <= b.o_turn end) as oracle_events "
    "from sofar f join turns t on t.pair = f.pair and t.idx = f.idx left join back b on b.pair = f.pair and b.idx = f.o join back b0 on b0.pair = f.pair and b0.idx = 0",
)
def judge_contexts(spark, d):
    """How many events a judge is shown of both runs at each step."""
    runs, p = _plan(spark, d, Policy(matching="strict"))
    asked = judge_inputs(Evidence(p, runs.events))
    n = lambda name: F.json_array_length(F.get_json_object("input", f"$.{name}")).cast("long")
    return asked.select("pair", "candidate_step", n("candidate_context").alias("candidate_events"), n("oracle_context").alias("oracle_events"))


@register("outcome_all_of", RUN + " select 'codex' as harness, 'c' || conv_id as session_id, last_role = 'assistant' and contains(last_text, 'an') and last_text <> 'x' and contains(last_text, 'e') as passed from n")
def outcome_all_of(spark, d):
    e = lift.conversation_events(spark, d).withColumn("at", F.col("position"))
    finals = T.outputs(e)
    unlike = final_equals(finals, "x").withColumn("passed", ~F.col("passed"))
    return all_of(final_contains(finals, "an"), final_contains(finals, "e"), unlike)


# --- runs of tool calls ------------------------------------------------------

_TOOLS = """with recursive e as (
  select event_id, user_id, event_type = 'view' as call, cast(json_extract_string(props, '$.k') as bigint) as k, row_number() over (partition by user_id order by event_id) as nth from events where event_type in ('view', 'click')
), b as (
  select *, case when not call then max(case when call then nth end) over (partition by user_id, k % 3 order by nth rows between unbounded preceding and 1 preceding) end as call_at from e
), h as (
  select *, row_number() over (partition by user_id order by nth) - 1 as idx,
    case when call then '{"arguments":{"k":' || k % 2 || ',"q":"shelf ' || k % 4 || '"},"kind":"tool_call","name":"view"}' else '{"kind":"tool_result","role":null,"text":"found ' || k % 5 || '"}' end as key,
    case when not call then 'found ' || k % 5 when event_id % 2 = 0 then 'view' || chr(10) || 'shelf ' || k % 4 else 'shelf ' || k % 4 end as said
  from b where call_at is null
), r as (
  select user_id, coalesce(call_at, nth) as nth, string_agg('{"payload":{"output":' || k % 5 || '},"text":"found ' || k % 5 || '"}', ',' order by nth) as results, string_agg('found ' || k % 5, chr(10) order by nth) filter (where call_at is not null) as more from b where not call group by 1, 2
), t as (
  select h.user_id, h.idx, h.key, '{"action":"' || replace(h.key, '"', '\\"') || '","results":[' || coalesce(r.results, '') || ']}' as evidence, h.said || coalesce(chr(10) || r.more, '') as search from h left join r on r.user_id = h.user_id and r.nth = h.nth
)"""
#: Pairs of users, in the form that matching works on.
_TOOL_PAIRS = _TOOLS + """, both_sides as (
  select user_id - user_id % 2 as pair from t group by 1 having count(distinct user_id % 2) = 2
), o as (select 'p' || pair as pair, idx, key, search as text from t join both_sides on user_id = pair), c as (select 'p' || pair as pair, idx, key, search as text from t join both_sides on user_id = pair + 1)"""


def _tool_runs(spark, d):
    return R.trajectories(lift.tool_events(spark, d), keep=R.keeper(spark, fresh_dir(spark, "runs")))


def _tool_plan(spark, d, mode, required=()):
    runs = _tool_runs(spark, d)
    p = PL.plan(_pairs(runs), runs, Policy(matching=mode, criteria=Criteria.read({"required_steps": list(required)})))
    return p.alignment.where("oracle_step is not null")


@register("tool_steps", _TOOLS + " select 'u' || user_id as session_id, idx, key, evidence, search from t")
def tool_steps(spark, d):
    """What identifies, proves and finds each step of runs of tool calls."""
    runs = _tool_runs(spark, d)
    return runs.steps.join(runs.runs.select("run", "session_id"), "run").select("session_id", "idx", "key", "evidence", "search")


@register("tool_match_strict", _TOOL_PAIRS + " select c.pair, c.idx as candidate_step, o.idx as oracle_step from c join o on o.pair = c.pair and o.idx = c.idx and o.key = c.key")
def tool_match_strict(spark, d):
    return _tool_plan(spark, d, "strict").select("pair", "candidate_step", "oracle_step")


@register("tool_match_unordered", _TOOL_PAIRS + catalogue.UNORDERED.removeprefix(catalogue.PAIRS) + " select pair, candidate_step, oracle_step from m")
def tool_match_unordered(spark, d):
    return _tool_plan(spark, d, "unordered").select("pair", "candidate_step", "oracle_step")


@register("tool_match_required", _TOOL_PAIRS + ", scored as (select c.pair, c.idx as c, o.idx as o, cast(1 as double) as s from c join o on c.pair = o.pair and c.key = o.key where o.idx in (0, 2))" + catalogue.ALIGN.format(least="0.5") + " select pair, candidate_step, oracle_step from hits")
def tool_match_required(spark, d):
    """The first and the third step of each reference, which every reference here has."""
    return _tool_plan(spark, d, "required", (1, 3)).select("pair", "candidate_step", "oracle_step")


@register("tool_match_bm25", _TOOL_PAIRS + ORACLE_SQL["align_monotone"].removeprefix(catalogue.PAIRS.replace("with st", "with recursive st")))
def tool_match_bm25(spark, d):
    return _tool_plan(spark, d, "bm25").select("pair", "candidate_step", "oracle_step", F.round("similarity", 6).alias("similarity"))


# --- labels ------------------------------------------------------------------

_LAB = "with k as (select cast(doc_id % 7 as varchar) as task, cast(doc_id // 7 % 9 as varchar) as trajectory, case when doc_id % 4 <> 0 then doc_id % 4 end as step, doc_id as seq, cast(doc_id as varchar) as id, quality as reward, quality = 1 and doc_id % 4 = 0 as oracle from labels), cur as (select * from k qualify row_number() over (partition by task, trajectory, step order by seq desc) = 1), acc as (select * from cur where step is null and oracle and reward = 1)"


def _labels(spark, d):
    r = spark.read.parquet(f"{d}/labels.parquet")
    step = F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 4)
    return r.select((F.col("doc_id") % 7).cast("string").alias("task"), (F.floor(F.col("doc_id") / 7) % 9).cast("string").alias("trajectory"), step.alias("step"), F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("id"), F.col("quality").alias("reward"), ((F.col("quality") == 1) & (F.col("doc_id") % 4 == 0)).alias("oracle"))


def _candidates(spark):
    return spark.range(35).select((F.col("id") % 7).cast("string").alias("task"), (F.floor(F.col("id") / 7) * 3).cast("string").alias("candidate"))


_CHOICE = _LAB + ", c as (select cast(i % 7 as varchar) as task, cast(i // 7 * 3 as varchar) as candidate from range(35) r(i)), j as (select c.task, c.candidate, acc.trajectory as oracle, count(acc.trajectory) over w as n, max(cast(acc.trajectory = c.candidate as int)) over w as self, row_number() over (partition by c.task, c.candidate order by acc.seq) - 1 as ord from c left join acc on acc.task = c.task window w as (partition by c.task, c.candidate))"


@register("oracle_choice", _CHOICE + " select task, candidate, oracle, cast(ord as integer) as ord, case when n = 0 then 'no reference is accepted' when n > 5 then 'too many references are accepted' when self = 1 then 'the candidate is its own reference' end as problem from j")
def oracle_choice(spark, d):
    return H.oracle_choice(_labels(spark, d), _candidates(spark))


@register("applied_labels", _CHOICE + " select j.task, j.candidate, acc.id, 'oracle' as role from j join acc on acc.task = j.task and acc.trajectory = j.oracle union all select x.task, x.candidate, cur.id, 'candidate' from (select distinct task, candidate from j) x join cur on cur.task = x.task and cur.trajectory = x.candidate")
def applied_labels(spark, d):
    labels = _labels(spark, d)
    return H.applied_labels(labels, H.oracle_choice(labels, _candidates(spark)))


@register("label_listing", _LAB + " select k.id, k.task, k.step, cur.id is not null as current from k left join cur on cur.id = k.id")
def label_listing(spark, d):
    return H.listing(_labels(spark, d)).select("id", "task", "step", "current")


@register("human_gates", _LAB + ", s as (select task, trajectory, max(case when step is null then reward end) as t, avg(case when step is not null then reward end) as m, count(step) / 4 as c from cur group by 1, 2) select task, trajectory, cast(coalesce(t = 0, false) as int) + cast(t is null as int) + cast(m is null or m < 0.6 as int) + cast(c < 0.5 as int) as n_failures from s")
def human_gates(spark, d):
    steps = spark.range(36).select((F.col("id") % 9).cast("string").alias("trajectory"))
    out = A.human_assessment(_labels(spark, d), steps)
    return out.select("task", "trajectory", F.size(H.human_failures(HumanGates(True, 0.6, 0.5))).alias("n_failures"))


@register("milestone_states", "with d as (select cast(i % 40 as varchar) as pair, 'm' || (i // 40) as subject from range(120) r(i)), s as (select cast(doc_id % 40 as varchar) as pair, 'm' || (doc_id % 5) as subject, max(quality) as reward from labels where doc_id % 3 > 0 group by 1, 2) select d.pair, d.subject, case when s.reward is null then 'unjudged' when s.reward = 1 then 'reached' else 'failed' end as state from d left join s on s.pair = d.pair and s.subject = d.subject")
def milestone_states(spark, d):
    declared = spark.range(120).select((F.col("id") % 40).cast("string").alias("pair"), F.concat(F.lit("m"), F.floor(F.col("id") / 40).cast("string")).alias("subject"))
    r = spark.read.parquet(f"{d}/labels.parquet").where("doc_id % 3 > 0")
    scores = r.groupBy((F.col("doc_id") % 40).cast("string").alias("pair"), F.concat(F.lit("m"), (F.col("doc_id") % 5).cast("string")).alias("subject")).agg(F.max("quality").alias("reward"))
    return A.milestone_states(declared, scores)


@register("dimension_means", "with s as (select doc_id % 9 as pair, doc_id as step, case doc_id % 3 when 0 then 'message' when 1 then 'tool_call' else 'tool_result' end as head, quality, toxic from labels) select pair, 'tool_correctness' as dimension, round(avg(quality), 6) as mean, count(*) as judged from s where head <> 'message' group by 1 union all select pair, 'progress', round(avg(toxic), 6), count(*) from s group by 1")
def dimension_means(spark, d):
    r = spark.read.parquet(f"{d}/labels.parquet").select((F.col("doc_id") % 9).alias("pair"), F.col("doc_id").alias("step"), "quality", "toxic")
    kinds = F.array(*(F.lit(x) for x in ("message", "tool_call", "tool_result")))
    steps = r.select("pair", "step", F.element_at(kinds, (F.col("step") % 3 + 1).cast("int")).alias("head"))
    scores = r.select("pair", "step", F.explode(F.create_map(F.lit("tool_correctness"), "quality", F.lit("progress"), "toxic")).alias("dimension", "reward"))
    return A.dimension_means(steps, scores, ("tool_correctness", "progress")).withColumn("mean", F.round("mean", 6))


@register("calibration_lookup", "select 'j' || (doc_id % 2) as judge, quality as predicted, toxic as human, count(*) as n from labels group by all")
def calibration_lookup(spark, d):
    r = spark.read.parquet(f"{d}/labels.parquet")
    folder = F.concat(F.lit("e"), (F.col("doc_id") % 10).cast("string")).alias("evaluation")
    labels = r.select(folder, (F.floor(F.col("doc_id") / 10) + 1).alias("candidate_step"), F.col("toxic").alias("human_reward"))
    scores = r.select(folder, F.col("doc_id").cast("string").alias("_"), F.concat(F.lit("plan"), (F.col("doc_id") % 10).cast("string")).alias("plan_id"), F.lit("quality").alias("part"), F.concat(F.lit("step:"), (F.floor(F.col("doc_id") / 10) + 1).cast("string")).alias("subject"), F.col("quality").alias("reward"), F.lit(None).cast("string").alias("error"), F.concat(F.lit("j"), (F.col("doc_id") % 2).cast("string")).alias("model"))
    return A.calibration_pairs(labels, scores).groupBy("judge", "predicted", "human").agg(F.count("*").alias("n"))


# --- upkeep ------------------------------------------------------------------

_DAYS = "with b as (select date_diff('day', date '2024-01-01', cast(ts as date)) as day, user_id, props from events), s as (select day, 'codex' as harness, 'u' || user_id % 20 as session_id, count(*) as n, cast(sum(octet_length(encode(props))) as bigint) as bytes from b group by all)"


def _manifests(spark, d):
    """A batch a day, with its sessions and one file for each; every third replaces the two before."""
    e = spark.read.parquet(f"{d}/events.parquet")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    own = e.groupBy(day.alias("day"), F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("session_id")).agg(F.count("*").alias("n"), F.sum(F.octet_length("props")).alias("bytes"))
    listed = own.groupBy("day").agg(
        F.collect_list(F.struct(F.lit("codex").alias("harness"), "session_id", F.col("n").alias("records"), F.col("n").alias("events"))).alias("sessions"),
        F.collect_list(F.struct(F.concat(F.lit("events/"), "session_id").alias("path"), F.col("bytes").alias("size"))).alias("files"),
    )
    name = lambda c: F.concat(F.lit("b"), c.cast("string"))
    gone = F.when(F.col("day") % 3 == 2, F.array(name(F.col("day") - 1), name(F.col("day") - 2))).otherwise(F.array().cast("array<string>"))
    return listed.select(F.lit("me").alias("collector_id"), name(F.col("day")).alias("batch_id"), "day", "sessions", "files", gone.alias("replaces"))


@register("manifest_bytes", _DAYS + " select 'b' || day as batch_id, cast(sum(bytes) as bigint) as bytes from s group by 1")
def manifest_bytes(spark, d):
    return C.manifest_bytes(_manifests(spark, d)).select("batch_id", "bytes")


@register("session_batches", _DAYS + " select harness, session_id, array_to_string(list_sort(list(distinct 'b' || day)), ',') as batches from s group by 1, 2")
def session_batches(spark, d):
    return C.session_batches(_manifests(spark, d)).withColumn("batches", F.array_join("batches", ","))


@register("replaced_union", _DAYS + ", m as (select distinct day from s where day % 3 = 2 and day < 20) select array_to_string(list_sort(list(distinct x)), ',') as replaces from (select unnest(['b' || day, 'b' || (day - 1), 'b' || (day - 2)]) as x from m)")
def replaced_union(spark, d):
    m = _manifests(spark, d)
    return C.replaced_union(m, (F.col("day") % 3 == 2) & (F.col("day") < 20)).withColumn("replaces", F.array_join("replaces", ","))


@register("replaced_due", _DAYS + ", m as (select distinct day from s) select 'b' || m.day as batch_id from m join m by_ on by_.day % 3 = 2 and (m.day = by_.day - 1 or m.day = by_.day - 2) where by_.day <= 11")
def replaced_due(spark, d):
    m = _manifests(spark, d)
    gone = m.select(F.explode("replaces").alias("batch_id"), F.col("day").alias("replaced_at"))
    return C.due_for_deletion(m.select("batch_id"), gone, F.lit(11))


@register("session_keyset", _DAYS + ", c as (select 'b' || day || ':' || hex(harness) || ':' || hex(session_id) as key, n as records from s where day % 2 = 0), p as (select * from c where key > 'b1:' order by key limit 101) select key, records, row_number() over (order by key) <= 100 as shown from p")
def session_keyset(spark, d):
    """Sessions of committed batches after a cursor: a page, and the one row that tells that there is another."""
    from ..operators.query import keyset_page

    own = _manifests(spark, d).where("day % 2 = 0").select("batch_id", F.explode("sessions").alias("s"))
    keyed = own.select(F.concat_ws(":", "batch_id", F.hex("s.harness"), F.hex("s.session_id")).alias("key"), F.col("s.records").alias("records"))
    page = keyset_page(keyed, "b1:", 100)
    # at most 101 rows are numbered
    return page.withColumn("shown", F.row_number().over(Window.orderBy("key")) <= 100)


# --- scalar rules ------------------------------------------------------------


@register("valid_ids", "with t as (select doc_id, case doc_id % 5 when 0 then 'b-' || doc_id when 1 then 'b ' || doc_id when 2 then '' when 3 then repeat('x', 100 + doc_id % 60) else 'ü' || doc_id end as s from documents) select doc_id, regexp_full_match(s, '[A-Za-z0-9_-]{1,128}') as valid from t")
def valid_ids(spark, d):
    n, k = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    s = F.when(k == 0, F.concat(F.lit("b-"), n)).when(k == 1, F.concat(F.lit("b "), n)).when(k == 2, F.lit("")).when(k == 3, F.expr("repeat('x', cast(100 + doc_id % 60 as int))")).otherwise(F.concat(F.lit("ü"), n))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", X.valid_id(s).alias("valid"))


@register("safe_paths", "with t as (select doc_id, case doc_id % 6 when 0 then 'a/' || doc_id when 1 then '/a/' || doc_id when 2 then 'a/../' || doc_id when 3 then 'a//' || doc_id when 4 then 'a\\' || doc_id else './' || doc_id end as s from documents) select doc_id, not contains(s, '\\') and len(list_filter(string_split(s, '/'), lambda x: x in ('', '.', '..'))) = 0 as safe from t")
def safe_paths(spark, d):
    heads = F.array(*(F.lit(x) for x in ("a/", "/a/", "a/../", "a//", "a\\", "./")))
    s = F.concat(F.element_at(heads, (F.col("doc_id") % 6 + 1).cast("int")), F.col("doc_id").cast("string"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", X.safe_relative(s).alias("safe"))


@register("valid_times", "with t as (select event_id, strftime(ts, '%Y-%m-%d') as d, strftime(ts, '%H:%M:%S') as h from events), x as (select event_id, case event_id % 6 when 0 then d || 'T' || h || 'Z' when 1 then d || 't' || h || 'z' when 2 then d || 'T' || h || '.25+02:00' when 3 then d || ' ' || h when 4 then d || 'T25' || substr(h, 3) || 'Z' else '2024-02-3' || event_id % 2 || 'T' || h || 'Z' end as s from t) select event_id, event_id % 6 in (0, 2) as valid from x")
def valid_times(spark, d):
    day, hour, k = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"), F.col("event_id") % 6
    bad = F.concat(F.lit("2024-02-3"), (F.col("event_id") % 2).cast("string"), F.lit("T"), hour, F.lit("Z"))
    s = F.when(k == 0, F.concat(day, F.lit("T"), hour, F.lit("Z"))).when(k == 1, F.concat(day, F.lit("t"), hour, F.lit("z"))).when(k == 2, F.concat(day, F.lit("T"), hour, F.lit(".25+02:00"))).when(k == 3, F.concat_ws(" ", day, hour)).when(k == 4, F.concat(day, F.lit("T25"), F.substring(hour, 3, 20), F.lit("Z"))).otherwise(bad)
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", X.valid_timestamp(s).alias("valid"))


@register("hook_flags", "select event_id, event_id % 4 = 1 as is_hook from events")
def hook_flags(spark, d):
    from ..sources.transcripts import with_hook_flag

    k = F.col("event_id") % 4
    payload = F.when(k == 0, F.col("props")).when(k == 1, F.lit('{"hook_event_name":"stop"}')).when(k == 2, F.lit('{"hook_event_name":1}')).otherwise(F.lit('{"in":{"hook_event_name":"stop"}}'))
    return with_hook_flag(spark.read.parquet(f"{d}/events.parquet").select("event_id", payload.alias("payload_json"))).select("event_id", "is_hook")


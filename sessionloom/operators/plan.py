"""Comparison of candidate runs with reference runs, many pairs at once: alignment, diagnostics, changes, gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filesystem import exists
from . import matching as M
from . import outcomes as O
from .assessment import best_variant
from .policy import Gates, Policy, need
from .query import SESSION
from .runs import Runs

VERSION = 1


@dataclass(frozen=True)
class Plan:
    """``pairs`` has ``pair, oracle, candidate, plan_id`` and both outputs; steps are numbered from 0 in ``alignment`` and ``unmatched``, from 1 in ``diagnostics``."""

    policy: Policy
    pairs: DataFrame
    oracle: DataFrame
    candidate: DataFrame
    alignment: DataFrame
    unmatched: DataFrame
    diagnostics: DataFrame


def match_steps(oracle: DataFrame, candidate: DataFrame, mode: str, required: tuple[int, ...] = (), threshold: float = 0.1) -> DataFrame:
    """``pair, candidate_step, oracle_step, similarity`` for every candidate step.

    Both sides are ``pair, idx, key, search``.  A step that matches nothing has a
    null ``oracle_step``; ``similarity`` is there for ``bm25`` alone, where the
    reference's steps are the corpus and each candidate step asks.
    """
    if mode == "bm25":
        found = M.bm25(oracle.select("pair", F.col("idx").alias("doc"), F.col("search").alias("text")), candidate.select("pair", F.col("idx").alias("query"), F.col("search").alias("text")), ("pair",))
        matched = M.monotone(found.select("pair", F.col("query").alias("candidate_step"), F.col("doc").alias("oracle_step"), "score", "weight"), threshold)
    elif mode in ("strict", "unordered"):
        matched = (M.strict if mode == "strict" else M.unordered)(oracle, candidate).withColumn("similarity", F.lit(None).cast("double"))
    elif mode == "required":
        need(bool(required), "matching by required steps needs some")
        matched = required_matches(oracle, candidate, required).withColumn("similarity", F.lit(None).cast("double"))
    else:
        raise ValueError(f"no way of matching is called {mode!r}")
    every = candidate.select("pair", F.col("idx").alias("candidate_step"))
    return every.join(matched, ["pair", "candidate_step"], "left")


def required_matches(oracle: DataFrame, candidate: DataFrame, required: tuple[int, ...]) -> DataFrame:
    """Ordered one-to-one matches by key of the reference's required steps (from 1)."""
    wanted = oracle.where(F.col("idx").isin([n - 1 for n in required])).select("pair", "idx")
    return M.required(oracle, candidate, wanted)


def _outcomes(policy: Policy, candidate: DataFrame, pairs: DataFrame) -> DataFrame | None:
    """``pair, id, passed, evidence`` of every declared outcome."""
    out = None
    for c in policy.criteria.outcome_checks:
        if c.kind in ("final_equals", "final_contains"):
            own = F.col("candidate_output")
            hit = own == F.lit(c["expected"]) if c.kind == "final_equals" else F.contains(own, F.lit(c["text"]))
            rows = pairs.select("pair", F.coalesce(hit, F.lit(False)).alias("passed"), F.to_json(F.struct(F.col("candidate_output_source").alias("source"), own.alias("observed"))).alias("evidence"))
        elif c.kind == "tool_result_contains":
            event = candidate.where("kind = 'tool_call'").where(O.tool_name(F.col("events")[0]["payload_json"]) == F.lit(c["tool"])).select("pair", F.explode("events").alias("e")).where("e.kind = 'tool_result'")
            said = F.coalesce(F.contains("e.text", F.lit(c["text"])), F.lit(False)) | F.coalesce(F.contains(O.result_text("e.payload_json"), F.lit(c["text"])), F.lit(False))
            hits = event.where(said).groupBy("pair").agg(F.collect_list(F.struct("e.at", "e.id")).alias("hits"))
            ids = F.transform(F.array_sort(F.coalesce("hits", F.array())), lambda h: h["id"])
            rows = pairs.select("pair").join(hits.select("pair", F.col("hits")), "pair", "left").select("pair", F.col("hits").isNotNull().alias("passed"), F.to_json(F.struct(F.lit("recorded_tool_result").alias("source"), F.when(F.col("hits").isNotNull(), ids).otherwise(F.array().cast("array<string>")).alias("event_ids"))).alias("evidence"))
        else:
            found = O.file_digest(c["path"])
            passed = found is not None and found[1] == c["sha256"].lower()
            said = F.to_json(F.struct(F.lit("local_artifact").alias("source"), F.lit(c["path"]).alias("path"), *([F.lit(True).alias("missing")] if found is None else [F.lit(found[0]).alias("size"), F.lit(found[1]).alias("sha256")])))
            rows = pairs.select("pair", F.lit(passed).alias("passed"), said.alias("evidence"))
        rows = rows.select("pair", F.lit(c.id).alias("id"), "passed", "evidence")
        out = rows if out is None else out.unionByName(rows)
    return out


def diagnose(policy: Policy, pairs: DataFrame, oracle: DataFrame, candidate: DataFrame, alignment: DataFrame) -> DataFrame:
    """Per pair: share of the reference matched, required steps passed and missing, repeated steps, outcomes.

    Required steps are matched by key and in order whatever the alignment's way
    is: likeness of words never satisfies one.
    """
    numbers = F.array(*(F.lit(n) for n in policy.criteria.required_steps)).cast("array<int>")
    o = oracle.groupBy("pair").agg(F.count(F.lit(1)).alias("oracle_steps"))
    c = candidate.groupBy("pair").agg(F.count(F.lit(1)).alias("candidate_steps"))
    m = alignment.groupBy("pair").agg(F.countDistinct("oracle_step").alias("matched"))
    again = M.repeated(candidate).groupBy("pair").agg(F.array_sort(F.collect_list(F.col("step").cast("int"))).alias("repeated_candidate_steps"))
    out = o.join(c, "pair").join(m, "pair", "left").join(again, "pair", "left")
    if policy.criteria.required_steps:
        hit = required_matches(oracle, candidate, policy.criteria.required_steps).groupBy("pair").agg(F.collect_set((F.col("oracle_step") + 1).cast("int")).alias("hit"))
        out = out.join(hit, "pair", "left").withColumn("hit", F.coalesce("hit", F.array().cast("array<int>")))
    else:
        out = out.withColumn("hit", F.array().cast("array<int>"))
    results = _outcomes(policy, candidate, pairs)
    if results is not None:
        order = F.array_position(F.array(*(F.lit(x.id) for x in policy.criteria.outcome_checks)), F.col("id"))
        results = results.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct(order.alias("n"), "id", "passed", "evidence"))).alias("outcome_checks"), F.bool_and("passed").alias("outcome_passed"))
        out = out.join(results, "pair", "left")
    else:
        out = out.withColumns({"outcome_checks": F.lit(None).cast("array<struct<n:bigint,id:string,passed:boolean,evidence:string>>"), "outcome_passed": F.lit(None).cast("boolean")})
    repeated = F.coalesce("repeated_candidate_steps", F.array().cast("array<int>"))
    return out.select(
        "pair", "oracle_steps", "candidate_steps",
        (F.coalesce("matched", F.lit(0)) / F.col("oracle_steps")).alias("reference_step_coverage"),
        F.filter(numbers, lambda n: F.array_contains(F.col("hit"), n)).alias("required_steps_passed"),
        F.filter(numbers, lambda n: ~F.array_contains(F.col("hit"), n)).alias("required_steps_missing"),
        repeated.alias("repeated_candidate_steps"), (F.size(repeated) / F.col("candidate_steps")).alias("repetition_ratio"), "outcome_checks", "outcome_passed",
    )


def plan(pairs: DataFrame, runs: Runs, policy: Policy) -> Plan:
    """Compare ``pairs`` (``pair, oracle, candidate``: two runs) under a policy.

    A run without steps or with more than ``max_steps``, and criteria that a
    reference can't meet, are errors found before anything is matched.
    """
    policy.checked()
    heads = runs.runs.select(F.col("run"), "steps", "trajectory_id", "final_output", "final_output_source", *SESSION)
    o = heads.select(F.col("run").alias("oracle"), F.col("steps").alias("oracle_steps"), F.col("trajectory_id").alias("oracle_id"), F.col("final_output").alias("oracle_output"))
    c = heads.select(F.col("run").alias("candidate"), F.col("steps").alias("candidate_steps"), F.col("trajectory_id").alias("candidate_id"), F.col("final_output").alias("candidate_output"), F.col("final_output_source").alias("candidate_output_source"), *SESSION)
    known = pairs.join(o, "oracle", "left").join(c, "candidate", "left")
    least = F.least("oracle_steps", "candidate_steps")
    bad = known.agg(
        F.count_if(F.col("oracle_id").isNull() | F.col("candidate_id").isNull()).alias("unknown"), F.count_if(least < 1).alias("empty"),
        F.count_if(F.greatest("oracle_steps", "candidate_steps") > policy.max_steps).alias("long"), F.min("oracle_steps").alias("shortest"),
    ).first()
    need(not bad["unknown"], "a pair names a run that isn't there")
    need(not bad["empty"], "a run without steps can't be compared")
    need(not bad["long"], f"a run has more than max_steps ({policy.max_steps}) steps")
    if bad["shortest"] is not None:
        policy.checked(bad["shortest"])
    steps = runs.steps
    oracle = pairs.select("pair", F.col("oracle").alias("run")).join(steps, "run").drop("run")
    candidate = pairs.select("pair", F.col("candidate").alias("run")).join(steps, "run").drop("run")
    alignment = match_steps(oracle, candidate, policy.matching, policy.criteria.required_steps, policy.min_similarity)
    unmatched = oracle.select("pair", F.col("idx").alias("oracle_step")).join(alignment.where("oracle_step is not null").select("pair", "oracle_step"), ["pair", "oracle_step"], "left_anti")
    diagnostics = diagnose(policy, known, oracle, candidate, alignment)
    listed = alignment.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("candidate_step", "oracle_step", F.round("similarity", 9).alias("similarity")))).alias("_alignment"))
    marks = known.join(listed, "pair").join(diagnostics.select("pair", F.struct(*(x for x in diagnostics.columns if x != "pair")).alias("_diagnostics")), "pair")
    plan_id = F.sha2(F.to_json(F.struct(F.lit(VERSION).alias("version"), F.lit(policy.text()).alias("policy"), "oracle_id", "candidate_id", F.col("_alignment").alias("alignment"), F.col("_diagnostics").alias("diagnostics"))), 256)
    named = marks.withColumn("plan_id", plan_id).drop("_alignment", "_diagnostics")
    return Plan(policy, named, oracle, candidate, alignment, unmatched, diagnostics)


def stored(p: Plan, folder: str) -> Plan:
    """The plan as it is kept in a folder, which belongs to this comparison and policy from then on."""
    spark = p.pairs.sparkSession
    names = ("oracle", "candidate", "alignment", "unmatched", "diagnostics", "pairs")
    if exists(spark, f"{folder}/pairs/_SUCCESS"):
        kept = spark.read.schema(p.pairs.schema).parquet(f"{folder}/pairs").select("pair", "plan_id")
        own = p.pairs.select("pair", "plan_id")
        need(kept.exceptAll(own).isEmpty() and own.exceptAll(kept).isEmpty(), "the folder belongs to another comparison or policy; use a new one")
    else:
        for name in names:  # the pairs, with the plans' ids, last
            getattr(p, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    return Plan(p.policy, **{n: spark.read.schema(getattr(p, n).schema).parquet(f"{folder}/{n}") for n in names})


def differences(p: Plan) -> DataFrame:
    """``pair, kind, oracle_step, candidate_step, before, after`` (steps from 1) where what two runs did, or what came of it, differs."""
    o = p.oracle.select("pair", F.col("idx").alias("oracle_step"), F.col("evidence").alias("before"))
    c = p.candidate.select("pair", F.col("idx").alias("candidate_step"), F.col("evidence").alias("after"))
    if p.policy.matching == "strict":
        both = o.withColumn("at", F.col("oracle_step")).join(c.withColumn("at", F.col("candidate_step")), ["pair", "at"], "full_outer").select("pair", "oracle_step", "candidate_step", "before", "after")
    else:
        mine = c.join(p.alignment.select("pair", "candidate_step", "oracle_step"), ["pair", "candidate_step"], "left").join(o, ["pair", "oracle_step"], "left").select("pair", "oracle_step", "candidate_step", "before", "after")
        left = o.join(p.unmatched, ["pair", "oracle_step"], "left_semi")
        if p.policy.matching == "required":
            mine = mine.where("oracle_step is not null")
            left = left.where(F.col("oracle_step").isin([n - 1 for n in p.policy.criteria.required_steps]))
        none = F.lit(None).cast
        both = mine.unionByName(left.select("pair", "oracle_step", none("long").alias("candidate_step"), "before", none("string").alias("after")))
    kind = F.when(F.col("oracle_step").isNull(), "extra").when(F.col("candidate_step").isNull(), "missing").when(F.col("before") != F.col("after"), "changed")
    numbered = {k: F.col(k) + 1 for k in ("oracle_step", "candidate_step")}
    return both.select("pair", kind.alias("kind"), *(v.alias(k) for k, v in numbered.items()), "before", "after").where("kind is not null")


def change_counts(changes: DataFrame) -> DataFrame:
    """``pair, missing, extra, changed, changes``."""
    return changes.groupBy("pair").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("missing", "extra", "changed")), F.count(F.lit(1)).alias("changes"))


def _four(c: Column) -> Column:
    return F.format_string("%.4f", c.cast("double"))


def assess(p: Plan, gates: Gates, judged: DataFrame | None = None) -> DataFrame:
    """Per pair ``passed, failures`` and what they rest on.

    ``judged`` is ``pair, plan_id, mean_quality, tool_correctness, progress,
    required_work_coverage, milestones`` (a map of rewards), of
    ``evaluation.results``.  A value that a threshold needs and that isn't there
    fails it.
    """
    gates.checked()
    criteria = p.policy.criteria
    changes = change_counts(differences(p))
    t = p.pairs.join(p.diagnostics, "pair").join(changes, "pair", "left")
    for k in ("missing", "extra", "changed", "changes"):
        t = t.withColumn(k, F.coalesce(k, F.lit(0)))
    t = t.withColumn("output_changed", ~F.col("oracle_output").eqNullSafe(F.col("candidate_output")))
    none = F.lit(None).cast("double")
    if judged is not None:
        wrong = judged.join(p.pairs.select("pair", F.col("plan_id").alias("own")), "pair").where("plan_id <> own")
        need(wrong.isEmpty(), "an evaluation belongs to another comparison")
        t = t.join(judged.drop("plan_id"), "pair", "left")
    else:
        share = F.size("required_steps_passed") / F.lit(len(criteria.required_steps)) if criteria.required_steps and not criteria.milestones else none
        t = t.withColumns({"mean_quality": none, "tool_correctness": none, "progress": none, "required_work_coverage": share, "milestones": F.lit(None).cast("map<string,int>")})

    found: list[Column] = []
    for kind, most in (("missing", gates.max_missing_steps), ("extra", gates.max_extra_steps), ("changed", gates.max_changed_steps)):
        found.append(F.when(F.col(kind) > most, F.format_string(f"%d steps are {kind}, {most} may be", F.col(kind))))
    if gates.max_changed_steps == 0 and p.policy.matching != "required":
        found.append(F.when(F.col("output_changed"), F.lit("the final output differs")))
    shares = (("step quality", gates.min_quality, "mean_quality"), ("required work", gates.min_required_coverage, "required_work_coverage"), ("tool correctness", gates.min_tool_correctness, "tool_correctness"), ("progress", gates.min_progress, "progress"))
    for name, least, column in shares:
        if least is not None:
            found.append(F.when(F.col(column).isNull(), F.lit(f"{name} isn't known, so its threshold isn't met")).when(F.col(column) < least, F.concat(F.lit(f"{name} "), _four(F.col(column)), F.lit(f" is below {least:.4f}"))))
    found.append(F.when(F.size("required_steps_missing") > 0, F.concat(F.lit("required steps are missing: "), F.array_join(F.col("required_steps_missing").cast("array<string>"), ", "))))
    for m in criteria.milestones:
        reward = F.element_at("milestones", F.lit(m.id))
        found.append(F.when(reward.isNull(), F.lit(f"milestone {m.id} wasn't judged")).when(reward != 1, F.lit(f"milestone {m.id} wasn't reached")))
    found.append(F.when(F.col("outcome_passed") == False, F.lit("a declared outcome isn't there")))  # noqa: E712
    if gates.require_outcome:
        found.append(F.when(F.col("outcome_passed").isNull(), F.lit("no outcome is declared")))
    if gates.max_repetition_ratio is not None:
        found.append(F.when(F.col("repetition_ratio") > gates.max_repetition_ratio, F.concat(F.lit("repetition "), _four(F.col("repetition_ratio")), F.lit(f" is above {gates.max_repetition_ratio:.4f}"))))
    t = t.withColumn("failures", F.array_compact(F.array(*found)))
    return t.withColumn("passed", F.size("failures") == 0)


def select_variants(assessed: DataFrame, order: DataFrame) -> DataFrame:
    """The variant that stands for each candidate: the first that passed, else that with the fewest failures, then changes.

    ``order`` is ``pair, candidate, variant, ord``.
    """
    rows = order.join(assessed.select("pair", "passed", F.size("failures").alias("n_failures"), F.col("changes").alias("n_changes")), "pair")
    return best_variant(rows, "candidate")



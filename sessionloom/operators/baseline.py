"""Accepted reference runs, and checks of candidates against them."""

from __future__ import annotations

import json
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import Folder
from ..functions.payloads import dumps
from . import runs as R
from .evaluation import Evidence, evaluate
from .models import Complete
from .plan import Plan, assess, differences, plan, select_variants, stored
from .policy import Gates, Policy, need

VERSION, MAX_VARIANTS = 1, 5
NAME = "baseline.json"


def load(folder: str) -> dict:
    """``version, policy, variants`` of a stored baseline; each variant is what its id says, or it is an error."""
    value = json.loads(Folder(folder).read(NAME))
    need(isinstance(value, dict) and value.get("version") == VERSION and 1 <= len(value.get("variants", ())) <= MAX_VARIANTS, "the folder holds no baseline of this version with one to five variants")
    policy = Policy.read(value["policy"])
    for v in value["variants"]:
        run = R.verified(v["trajectory"])
        need(run["trajectory_id"] == v["id"], "a variant isn't what its id says")
        policy.checked(len(run["step_events"]))
    return value


def snapshot(folder: str, run: dict, policy: Policy, append: bool = False) -> dict:
    """Accept a run (:func:`runs.document`) as a variant: five at most, of one policy, each once.

    A baseline that is there already only grows with ``append``; the same run
    again changes nothing.  One writer at a time.
    """
    policy.checked(len(R.verified(run)["step_events"]))
    place = Folder(folder)
    with place.locked("baseline"):
        own = json.loads(dumps(asdict(policy)))
        if place.has(NAME):
            need(append, "there is a baseline already; append adds a variant to it")
            value = load(folder)
            need(value["policy"] == own, "the baseline has another policy; use a new folder")
        else:
            value = {"version": VERSION, "policy": own, "variants": []}
        if all(v["id"] != run["trajectory_id"] for v in value["variants"]):
            need(len(value["variants"]) < MAX_VARIANTS, f"a baseline has at most {MAX_VARIANTS} variants")
            value["variants"].append({"id": run["trajectory_id"], "accepted_at": datetime.now(timezone.utc).isoformat(), "trajectory": run})
            place.write(NAME, dumps(value).encode())
    return value


def union_runs(a: R.Runs, b: R.Runs) -> R.Runs:
    """Both, each run once."""
    columns = [c for c in a.events.columns if c in b.events.columns]
    return R.Runs(a.runs.unionByName(b.runs).dropDuplicates(["run"]), a.steps.unionByName(b.steps).dropDuplicates(["run", "idx"]), a.events.select(columns).unionByName(b.events.select(columns)).dropDuplicates(["run", "id"]))


def check_pairs(variants: DataFrame, candidates: DataFrame) -> DataFrame:
    """``pair, candidate, oracle, variant, ord``: each candidate with each variant of its baseline.

    ``variants`` is ``baseline, variant, run, ord``, ``candidates`` ``baseline, run``.
    """
    v = variants.select("baseline", "variant", F.col("run").alias("oracle"), "ord")
    both = candidates.select("baseline", F.col("run").alias("candidate")).join(v, "baseline")
    return both.select(F.concat_ws("|", "baseline", "candidate", "variant").alias("pair"), "baseline", "candidate", "oracle", "variant", "ord")


def check_runs(pairs: DataFrame, runs: R.Runs, policy: Policy, gates: Gates, judged=None, folder: str | None = None) -> tuple[Plan, DataFrame, DataFrame]:
    """(plan, assessment of each pair, what stands for each candidate).

    ``judged`` makes an evaluation of a plan, for thresholds that need one;
    ``folder`` keeps the plan, so that it is made once.
    """
    need(not gates.checked().needs_judge() or judged is not None, "thresholds of quality need a judge")
    p = plan(pairs.select("pair", "oracle", "candidate"), runs, policy)
    p = stored(p, folder) if folder else p
    assessed = assess(p, gates, judged(p) if judged else None).persist()
    return p, assessed, select_variants(assessed, pairs.select("pair", "candidate", "variant", "ord"))


def check(spark: SparkSession, baseline: dict, candidate: dict, gates: Gates, folder: str, models: tuple[Complete, Complete] | None = None) -> dict:
    """Check a run against every variant; the result also goes to ``check.json`` and ``check.md`` in ``folder``.

    A folder belongs to one check: another baseline, candidate or gates need a
    new one.  What an earlier try reported is removed first, so that a try that
    fails leaves no report that looks current.
    """
    gates.checked()
    need(not gates.needs_judge() or models is not None, "thresholds of quality need a judge")
    R.verified(candidate)
    place = Folder(folder)
    with place.locked("check"):
        inputs = json.loads(dumps({"version": VERSION, "baseline": baseline, "candidate": candidate, "gates": asdict(gates), "judged": models is not None}))
        place.pin("check-input.json", inputs, "the folder belongs to another check; use a new one")
        for name in ("check.json", "check.md"):
            place.remove(name)
        policy = Policy.read(baseline["policy"])
        runs = R.from_documents(spark, [*({v["id"]: v["trajectory"] for v in baseline["variants"]} | {candidate["trajectory_id"]: candidate}).values()])
        variants = spark.createDataFrame([("b", v["id"], v["id"], k) for k, v in enumerate(baseline["variants"])], "baseline string, variant string, run string, ord int")
        pairs = check_pairs(variants, spark.createDataFrame([("b", candidate["trajectory_id"])], "baseline string, run string"))

        def judged(p: Plan) -> DataFrame:
            return evaluate(Evidence(p, runs.events), f"{folder}/evaluation", *models, model=policy.judge.model if policy.judge else "unspecified").drop("report")

        p, assessed, chosen = check_runs(pairs, runs, policy, gates, judged if models else None, f"{folder}/plan")
        changes: dict[str, list] = {}
        for r in differences(p).orderBy("pair", "oracle_step", "candidate_step").collect():  # steps of at most five pairs of bounded runs
            changes.setdefault(r["pair"], []).append({k: v for k, v in r.asDict().items() if k != "pair"})
        rows = assessed.select("pair", "plan_id", "passed", "failures", "output_changed", "mean_quality", "tool_correctness", "progress", "required_work_coverage", "reference_step_coverage", "repetition_ratio", "required_steps_passed", "required_steps_missing", "repeated_candidate_steps", "outcome_passed").collect()
        found = [r.asDict() | {"variant": r["pair"].split("|")[2], "changes": changes.get(r["pair"], [])} for r in rows]
        order = {v["id"]: k for k, v in enumerate(baseline["variants"])}
        found.sort(key=lambda x: order[x["variant"]])
        best = chosen.first()
        result = {"version": VERSION, "candidate_session": candidate["session_id"], "selected_variant": best["variant"], "passed": best["passed"], "gates": asdict(gates), "variants": found}
        place.write("check.json", dumps(result).encode())
        place.write("check.md", report_text(result).encode())
    return result


def report_text(result: dict) -> str:
    """The result for a reader."""
    own = next(v for v in result["variants"] if v["variant"] == result["selected_variant"])
    failed = [f"- {f}" for f in own["failures"]] or ["none"]
    steps = [f"- {c['kind']}: reference step {c['oracle_step'] or '-'}, candidate step {c['candidate_step'] or '-'}" for c in own["changes"]] or ["none"]
    facts = [f"- {k}: {own[k]}" for k in ("reference_step_coverage", "repetition_ratio", "required_work_coverage", "mean_quality", "outcome_passed")]
    return "\n".join([f"# Check {'passed' if result['passed'] else 'failed'}", "", f"Candidate {result['candidate_session']}, nearest to variant {result['selected_variant']}.", "", "## Failures", "", *failed, "", "## Changes (steps from 1)", "", *steps, "", "## Facts", "", *facts, ""])

"""Runs, plans, checks, judged evaluations and people's labels on made-up sessions."""

import hashlib
import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sessionloom.operators import archive, baseline, evaluation, human, runs
from sessionloom.operators import plan as PL
from sessionloom.operators.policy import Check, Criteria, Gates, HumanGates, Milestone, Policy
from sessionloom.sources import transcripts

# judges of these tests run where workers can't import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def call(name, key, **arguments):
    return ("response_item", {"type": "function_call", "name": name, "call_id": key, "arguments": json.dumps(arguments)})


def result(key, text):
    return ("response_item", {"type": "function_call_output", "call_id": key, "output": text})


def says(text):
    return ("response_item", {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": text}]})


REFERENCE = [call("measure", "m", bed="roses"), result("m", "dry"), call("water", "w", bed="roses"), result("w", "12 litres"), says("The roses are watered.")]
SAME = [call("measure", "a", bed="roses"), result("a", "dry"), call("water", "b", bed="roses"), result("b", "12 litres"), says("The roses are watered.")]
OTHER = [call("measure", "a", bed="roses"), result("a", "dry"), call("measure", "c", bed="roses"), result("c", "dry"), call("water", "b", bed="roses"), result("b", "3 litres"), says("All done.")]


def session(path, name, steps):
    lines = [("session_meta", {"id": name, "cwd": "/garden"}), ("response_item", {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "water the roses"}]}), *steps]
    path.write_text("".join(json.dumps({"type": k, "timestamp": f"2025-05-01T08:00:{i:02d}Z", "payload": p}) + "\n" for i, (k, p) in enumerate(lines)))


@pytest.fixture(scope="module")
def garden(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("garden")
    for name, steps in (("reference", REFERENCE), ("same", SAME), ("other", OTHER)):
        session(at / f"{name}.jsonl", name, steps)
    made = runs.trajectories(transcripts.events_of(transcripts.read(spark, "codex", str(at))))
    return runs.stored(made, str(tmp_path_factory.mktemp("runs"))), None


@pytest.fixture(scope="module")
def made(garden):
    return garden[0]


def of(made, name):
    return made.runs.where(F.col("session_id") == name).first()["run"]


def compare(spark, made, policy, *names):
    rows = [(n, of(made, "reference"), of(made, n)) for n in names]
    return PL.plan(spark.createDataFrame(rows, "pair string, oracle string, candidate string"), made, policy)


def test_runs_have_steps_outputs_and_marks(spark, made):
    rows = {r.session_id: r for r in made.runs.collect()}
    assert {k: r.steps for k, r in rows.items()} == {"reference": 3, "same": 3, "other": 4}
    assert rows["other"].final_output == "All done." and rows["other"].final_output_source == "trailing_assistant_message"
    doc = runs.document(made, None, "reference")
    assert runs.verified(doc)["trajectory_id"] == rows["reference"].trajectory_id and [len(x) for x in doc["step_events"]] == [2, 2, 1]
    back = runs.from_documents(spark, [doc])
    assert back.runs.first().trajectory_id == doc["trajectory_id"] and sorted(r.key for r in back.steps.collect()) == sorted(r.key for r in made.steps.where(F.col("run") == rows["reference"].run).collect())
    doc["events"][2]["text"] = "changed"
    with pytest.raises(ValueError, match="checksum"):
        runs.verified(doc)
    with pytest.raises(ValueError, match="no such session"):
        runs.document(made, "pi", "reference")


def test_a_given_output_replaces_the_found_one(spark, made):
    given = spark.createDataFrame([("codex", "same", "something else")], "harness string, session_id string, final_output string")
    own = runs.trajectories(made.events.drop("at", "run"), given=given).runs
    got = {r.session_id: (r.final_output, r.final_output_source) for r in own.collect()}
    assert got["same"] == ("something else", "explicit_file") and got["other"][1] == "trailing_assistant_message"


TREE = [{"type": "session", "id": "p1", "cwd": "/garden"}, {"type": "session_info", "id": "i", "name": "roses"}, {"type": "message", "id": "q", "parentId": None, "message": {"role": "user", "content": "which bed?"}}]
ANSWER = {"type": "message", "message": {"role": "assistant", "content": "the roses"}}


def branches(spark, tmp_path, *more):
    (tmp_path / "p.jsonl").write_text("".join(json.dumps(x) + "\n" for x in [*TREE, *more]))
    return transcripts.events_of(transcripts.read(spark, "pi", str(tmp_path)))


def test_one_branch_of_a_tree(spark, tmp_path):
    events = branches(spark, tmp_path, ANSWER | {"id": "a", "parentId": "q"}, ANSWER | {"id": "b", "parentId": "q"})
    with pytest.raises(Exception, match="several branches"):
        runs.trajectories(events).runs.collect()
    leaf = spark.createDataFrame([("pi", "p1", "b")], "harness string, session_id string, leaf string")
    made = runs.trajectories(events, leaf)
    assert {r.native_id for r in made.events.collect()} == {"p1", "i", "q", "b"} and made.runs.first().steps == 1
    with pytest.raises(Exception, match="isn't among"):
        runs.trajectories(events, leaf.withColumn("leaf", F.lit("z"))).runs.collect()
    with pytest.raises(Exception, match="form a tree"):
        runs.trajectories(events.withColumn("harness", F.lit("codex")), leaf).runs.collect()


def test_loops_and_gaps_of_a_tree(spark, tmp_path):
    for k, (parents, what) in enumerate(((("b", "a"), "loop"), (("gone", "a"), "isn't among"))):
        at = tmp_path / str(k)
        at.mkdir()
        lines = [TREE[0], ANSWER | {"id": "a", "parentId": parents[0]}, ANSWER | {"id": "b", "parentId": parents[1]}]
        (at / "p.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
        with pytest.raises(Exception, match=what):
            runs.trajectories(transcripts.events_of(transcripts.read(spark, "pi", str(at)))).runs.collect()


@pytest.mark.parametrize("matching,want", [("strict", [0, None, None, None]), ("unordered", [0, None, 1, None]), ("required", [0, None, 1, None]), ("bm25", [0, None, 1, 2])])
def test_matching_dispatch(spark, made, matching, want):
    policy = Policy(matching=matching, min_similarity=0.05, criteria=Criteria(required_steps=(1, 2)))
    p = compare(spark, made, policy, "other")
    got = [r.oracle_step for r in p.alignment.orderBy("candidate_step").collect()]
    if matching == "bm25":
        # two equal steps: either may go with the reference's, and the last word goes with the last word at most
        assert [x for x in got if x is not None][:2] == [0, 1] and p.alignment.where("oracle_step is not null and similarity is null").isEmpty()
    else:
        assert got == want and p.alignment.where("similarity is not null").isEmpty()


def test_differences_and_gates(spark, made):
    p = compare(spark, made, Policy(matching="unordered"), "same", "other")
    assert sorted((r.pair, r.kind, r.oracle_step, r.candidate_step) for r in PL.differences(p).collect() if r.pair == "same") == []
    changes = sorted((r.kind, r.oracle_step or 0, r.candidate_step or 0) for r in PL.differences(p).where("pair = 'other'").collect())
    assert changes == [("changed", 2, 3), ("extra", 0, 2), ("extra", 0, 4), ("missing", 3, 0)]
    rows = {r.pair: r for r in PL.assess(p, Gates()).collect()}
    assert rows["same"].passed and not rows["other"].passed and len(rows["other"].failures) == 4 and rows["other"].output_changed
    loose = PL.assess(p, Gates(max_missing_steps=1, max_extra_steps=2, max_changed_steps=1, max_repetition_ratio=0.2, min_quality=0.5)).where("pair = 'other'").first()
    assert loose.failures == ["step quality isn't known, so its threshold isn't met", "repetition 0.2500 is above 0.2000"]
    strict = compare(spark, made, Policy(matching="strict"), "other")
    assert sorted((r.kind, r.oracle_step or 0, r.candidate_step or 0) for r in PL.differences(strict).collect()) == [("changed", 2, 2), ("changed", 3, 3), ("extra", 0, 4)]


def test_diagnostics_and_outcomes(spark, made, tmp_path):
    (tmp_path / "log").write_bytes(b"wet")
    digest = "e0" * 32
    checks = tuple(
        Check(kind, kind + str(k), tuple(sorted(values.items())))
        for k, (kind, values) in enumerate(
            [
                ("final_equals", {"expected": "All done."}), ("final_contains", {"text": "roses"}), ("tool_result_contains", {"tool": "water", "text": "litres"}),
                ("artifact_sha256", {"path": str(tmp_path / "log"), "sha256": digest}), ("artifact_sha256", {"path": str(tmp_path / "none"), "sha256": digest}),
            ]
        )
    )
    p = compare(spark, made, Policy(criteria=Criteria(required_steps=(2, 3), outcome_checks=checks)), "other")
    d = p.diagnostics.first()
    assert (d.required_steps_passed, d.required_steps_missing, d.repeated_candidate_steps, d.repetition_ratio) == ([2], [3], [2], 0.25)
    assert [c.passed for c in d.outcome_checks] == [True, False, True, False, False] and d.outcome_passed is False
    assert len(json.loads(d.outcome_checks[2].evidence)["event_ids"]) == 1 and json.loads(d.outcome_checks[4].evidence)["missing"]
    assert "a declared outcome isn't there" in PL.assess(p, Gates()).first().failures


def test_plans_are_named_after_all_they_rest_on(spark, made):
    one, two, other = (compare(spark, made, x, "same").pairs.first().plan_id for x in (Policy(), Policy(), Policy(rubric="another")))
    assert one == two != other


@pytest.mark.parametrize(
    "policy",
    [
        Policy(matching="guess"), Policy(min_similarity=float("nan")), Policy(max_steps=0), Policy(dimensions=("progress", "progress")), Policy(matching="required"),
        Policy(criteria=Criteria(required_steps=(4,))), Policy(criteria=Criteria(required_steps=(1, 1))), Policy(criteria=Criteria(milestones=(Milestone("a", "x"), Milestone("a", "y")))),
        Policy(criteria=Criteria(milestones=(Milestone("a", "x", (9,)),))), Policy(max_steps=2),
        Policy(criteria=Criteria(outcome_checks=(Check("artifact_sha256", "a", (("path", "not/absolute"), ("sha256", "0" * 64))),))),
    ],
)
def test_policies_that_are_refused(spark, made, policy):
    with pytest.raises(ValueError):
        compare(spark, made, policy, "same")


def test_unknown_fields_are_refused():
    assert Criteria.read({"milestones": [{"id": "m", "description": "d"}]}).milestones[0].id == "m"
    for value in ({"steps": [1]}, {"milestones": [{"id": "m", "description": "d", "weight": 1}]}, {"outcome_checks": [{"kind": "final_equals", "id": "x", "expected": "y", "more": 1}]}, {"outcome_checks": [{"kind": "nobody"}]}):
        with pytest.raises(ValueError):
            Criteria.read(value).checked()
    with pytest.raises(ValueError):
        Policy.read({"criterion": {}})


def reply(reward=1):
    return json.dumps({"reward": reward, "rationale": "seen"})


POLICY = Policy(matching="unordered", min_similarity=0.0, criteria=Criteria(required_steps=(1,), milestones=(Milestone("wet", "the roses are wet", (2,)),)))


def test_judged_evaluation_goes_on_where_it_stopped(spark, made, tmp_path):
    folder = str(tmp_path / "out")
    p = compare(spark, made, POLICY, "other")
    e = evaluation.Evidence(p, made.events)
    asked = evaluation.questions(e)
    parts = {(r.part, r.subject) for r in asked.collect()}
    # progress applies to all four steps, tool use to the three that are calls
    assert len(parts) == 4 + 4 + 3 + 1 and ("tool_correctness", "step:4") not in parts and ("milestone", "wet") in parts
    first = json.loads(asked.where("part = 'quality' and subject = 'step:2'").first().input)
    assert [x["kind"] for x in first["oracle_context"]][-1] == "tool_result" and len(first["candidate_context"]) == 2 + 4 and first["oracle_step"] is None
    last = json.loads(asked.where("part = 'progress' and subject = 'step:4'").first().input)
    assert "criterion" in last and last["candidate_step"][0]["text"] == "All done."

    def picky(system, text):
        return "no idea" if "All done." in json.dumps(json.loads(text).get("candidate_step", "")) and "criterion" not in text else reply(int("milestone" in text or "criterion" in text))

    with pytest.raises(ValueError, match="1 replies"):
        evaluation.evaluate(e, folder, picky, lambda s, t: "report")
    kept = spark.read.schema(evaluation.SCORES).parquet(f"{folder}/scores")
    assert kept.where("error is null").count() == 11 and kept.where("error is not null and reward is null").count() == 1
    out = evaluation.evaluate(e, folder, lambda s, t: reply(1) if "criterion" not in t and "All done." in t else "never asked again", lambda s, t: "all went well").first()
    assert out.report == "all went well" and out.mean_quality == 0.25 and out.progress == 1.0 and out.required_work_coverage == 1.0 and out.milestones == {"wet": 1}
    again = evaluation.evaluate(e, folder, lambda s, t: "x", lambda s, t: "x").first()
    assert again.report == out.report
    stored = archive.open_archive(spark, f"{folder}/archive")[1]
    assert {r.kind: r.n for r in stored.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"feedback_reward": 4, "feedback_dimension": 7, "feedback_milestone": 1, "feedback_diagnostics": 1, "feedback_report": 1}
    assessed = PL.assess(p, Gates(max_missing_steps=9, max_extra_steps=9, max_changed_steps=9, min_quality=0.5, min_progress=1.0), evaluation.evaluate(e, folder, None, None).drop("report")).first()
    assert assessed.failures == ["step quality 0.2500 is below 0.5000"]
    other = evaluation.Evidence(compare(spark, made, Policy(matching="strict"), "other"), made.events)
    with pytest.raises(ValueError, match="another comparison"):
        evaluation.evaluate(other, folder, lambda s, t: reply(), lambda s, t: "x")


def test_a_job_that_dies_half_way_asks_nothing_twice(spark, made, tmp_path):
    e = evaluation.Evidence(compare(spark, made, POLICY, "other"), made.events)
    folder, calls = str(tmp_path / "out"), tmp_path / "calls"
    calls.mkdir()

    def judge(system, text, last=5):
        """Notes each question that it answers; the connection breaks after a few."""
        mark = calls / hashlib.sha256((system + text).encode()).hexdigest()
        if len(list(calls.iterdir())) >= last:
            raise ConnectionError("the line is dead")
        assert not mark.exists(), "asked twice"
        mark.write_text("")
        return reply(1)

    with pytest.raises(Exception):  # what Spark makes of the judge's error
        evaluation.evaluate(e, folder, judge, lambda s, t: "report", at_once=1)
    assert not (tmp_path / "out" / "scores").exists() or spark.read.schema(evaluation.SCORES).parquet(f"{folder}/scores").isEmpty()
    assert len(list(calls.iterdir())) == 5 == len(list((tmp_path / "out" / "replies").iterdir()))
    out = evaluation.evaluate(e, folder, lambda s, t: judge(s, t, 100), lambda s, t: "report", at_once=2).first()
    assert out.report == "report" and out.mean_quality == 1.0 and len(list(calls.iterdir())) == 12


def test_nothing_is_asked_if_an_input_is_too_large(spark, made, tmp_path):
    from dataclasses import replace

    e = evaluation.Evidence(compare(spark, made, replace(POLICY, max_input_bytes=900), "other"), made.events)
    with pytest.raises(ValueError, match="max_input_bytes"):
        evaluation.evaluate(e, str(tmp_path / "x"), None, None)


def test_scores_that_were_changed_are_refused(spark, made, tmp_path):
    folder = str(tmp_path / "out")
    p = compare(spark, made, Policy(matching="unordered", dimensions=()), "same")
    e = evaluation.Evidence(p, made.events)
    rows = evaluation._judged(evaluation.questions(e), p.pairs.select("pair", "plan_id"), lambda s, t: reply(0), "m").withColumn("reward", F.lit(1))
    rows.write.parquet(f"{folder}/scores")
    with pytest.raises(Exception, match="isn't what its reply says"):
        evaluation.evaluate(e, folder, lambda s, t: reply(), lambda s, t: "x")


@pytest.fixture(scope="module")
def docs(made):
    return {n: runs.document(made, None, n) for n in ("reference", "same", "other")}


def test_baselines_and_checks(spark, docs, tmp_path):
    at = str(tmp_path / "base")
    policy = Policy(matching="strict")
    baseline.snapshot(at, docs["reference"], policy)
    with pytest.raises(ValueError, match="append"):
        baseline.snapshot(at, docs["other"], policy)
    with pytest.raises(ValueError, match="another policy"):
        baseline.snapshot(at, docs["other"], Policy(matching="unordered"), append=True)
    stored = baseline.load(at)
    good = baseline.check(spark, stored, docs["same"], Gates(), str(tmp_path / "good"))
    assert good["passed"] and (tmp_path / "good" / "check.md").read_text().startswith("# Check passed")
    bad = baseline.check(spark, stored, docs["other"], Gates(), str(tmp_path / "bad"))
    assert not bad["passed"] and bad["variants"][0]["failures"] and {c["kind"] for c in bad["variants"][0]["changes"]} == {"changed", "extra"}
    assert len(baseline.snapshot(at, docs["other"], policy, append=True)["variants"]) == 2 == len(baseline.snapshot(at, docs["other"], policy, append=True)["variants"])
    both = baseline.check(spark, baseline.load(at), docs["other"], Gates(), str(tmp_path / "both"))
    assert both["passed"] and both["selected_variant"] == docs["other"]["trajectory_id"] and [v["passed"] for v in both["variants"]] == [False, True]
    with pytest.raises(ValueError, match="another check"):
        baseline.check(spark, stored, docs["same"], Gates(), str(tmp_path / "both"))
    with pytest.raises(ValueError, match="need a judge"):
        baseline.check(spark, stored, docs["same"], Gates(min_quality=0.5), str(tmp_path / "none"))
    with pytest.raises(ValueError, match="from 0 to 1"):
        Gates(min_progress=1.5).checked()
    judged = baseline.check(spark, stored, docs["same"], Gates(min_quality=0.5), str(tmp_path / "judged"), (lambda s, t: reply(), lambda s, t: "fine"))
    assert judged["passed"] and judged["variants"][0]["mean_quality"] == 1.0
    text = (tmp_path / "base" / "baseline.json").read_text()
    (tmp_path / "base" / "baseline.json").write_text(text.replace("12 litres", "99 litres"))
    with pytest.raises(ValueError, match="checksum"):
        baseline.load(at)


def test_labels_are_a_history(docs, tmp_path):
    at = str(tmp_path)
    one = human.annotate(at, docs["reference"], "roses", 1, "kim", "looks right", oracle=True)
    assert human.annotate(at, docs["reference"], "roses", 1, "kim", "looks right", oracle=True) == one
    with pytest.raises(ValueError, match="replace"):
        human.annotate(at, docs["reference"], "roses", 0, "kim", "it isn't")
    two = human.annotate(at, docs["reference"], "roses", 0, "kim", "it isn't", replace=True)
    human.annotate(at, docs["reference"], "roses", 1, "kim", "good start", step=1)
    labels = human.load(at)
    assert two["supersedes"] == one["id"] and [x["id"] for x in human.current(labels)] == [two["id"], labels[2]["id"]]
    for wrong in ({"task": " "}, {"reviewer": ""}, {"note": "\n"}, {"step": 4}, {"step": 0}, {"reward": 2}, {"reward": 0, "oracle": True}, {"step": 1, "oracle": True}, {"origin": "guess"}):
        with pytest.raises(ValueError):
            human.annotate(at, docs["same"], **({"task": "roses", "reward": 1, "reviewer": "kim", "note": "n"} | wrong))
    text = (tmp_path / "labels.json").read_text()
    for changed in (text.replace("it isn't", "it is"), text.replace(f'"supersedes":"{one["id"]}"', '"supersedes":null'), text.replace('"version":1', '"version":2', 1)):
        (tmp_path / "labels.json").write_text(changed)
        with pytest.raises(ValueError):
            human.load(at)


def test_evaluation_against_accepted_runs(spark, docs, tmp_path):
    at = str(tmp_path / "labels")
    options = human.Options("roses", Policy(matching="strict"))
    with pytest.raises(ValueError, match="no run is accepted"):
        human.evaluate(spark, human.load(at), docs["same"], options, str(tmp_path / "a"))
    oracle = human.annotate(at, docs["reference"], "roses", 1, "kim", "right", oracle=True)
    plain = human.evaluate(spark, human.load(at), docs["same"], options, str(tmp_path / "b"))
    assert plain["passed"] and plain["human"]["task_reward"] is None and plain["oracle_label_ids"] == [oracle["id"]]
    assert archive.open_archive(spark, str(tmp_path / "b" / "archive"))[1].count() == 3
    with pytest.raises(ValueError, match="itself"):
        human.evaluate(spark, human.load(at), docs["reference"], options, str(tmp_path / "c"))
    human.annotate(at, docs["same"], "roses", 0, "kim", "too much water")
    human.annotate(at, docs["same"], "roses", 1, "kim", "good", step=1)
    with pytest.raises(ValueError, match="have changed"):
        human.evaluate(spark, human.load(at), docs["same"], options, str(tmp_path / "b"))
    gates = human.Options("roses", Policy(matching="strict"), human=HumanGates(True, 0.5, 0.9))
    failed = human.evaluate(spark, human.load(at), docs["same"], gates, str(tmp_path / "d"))
    assert not failed["passed"] and failed["regression"]["passed"] and failed["human"]["mean_step_reward"] == 1.0
    assert failed["human"]["failures"] == ["a reviewer marked the task as failed", "share of reviewed steps 0.3333 is below 0.9000"]
    seen = []
    human.evaluate(spark, human.load(at), docs["same"], human.Options("roses", Policy(matching="strict", dimensions=())), str(tmp_path / "e"), (lambda s, t: reply(), lambda s, t: t[:0] + "ok" if "human_review" in t and "too much water" in t else ""))
    assert (tmp_path / "e" / "report.md").read_text().startswith("# roses: failed") and not seen
    human.annotate(at, docs["other"], "roses", 1, "robot", "made up", origin="synthetic", oracle=True)
    with pytest.raises(ValueError, match="synthetic"):
        human.evaluate(spark, human.load(at), docs["same"], options, str(tmp_path / "f"))
    with pytest.raises(ValueError, match="named reference"):
        human.evaluate(spark, human.load(at), docs["same"], human.Options("roses", oracle_labels=("nothing",)), str(tmp_path / "g"))


def test_choice_of_references_as_a_table(spark, docs):
    rows = [(f"l{k}", "t", f"r{k}", None, 1, "kim", "n", "human", True, "", None, k) for k in range(6)] + [("s", "u", "r0", None, 1, "kim", "n", "human", True, "", None, 9), ("s2", "u", "r0", None, 0, "kim", "n", "human", False, "", "s", 10)]
    labels = spark.createDataFrame(rows, human.LABELS)
    got = human.oracle_choice(labels, spark.createDataFrame([("t", "x"), ("u", "x"), ("none", "x")], "task string, candidate string"))
    assert {(r.task, r.problem) for r in got.collect()} == {("t", "too many references are accepted"), ("u", "no reference is accepted"), ("none", "no reference is accepted")}
    few = human.oracle_choice(labels.where("seq < 2"), spark.createDataFrame([("t", "x"), ("t", "r1")], "task string, candidate string"))
    assert sorted((r.candidate, r.oracle, r.ord, r.problem) for r in few.collect()) == [("r1", "r0", 0, "the candidate is its own reference"), ("r1", "r1", 1, "the candidate is its own reference"), ("x", "r0", 0, None), ("x", "r1", 1, None)]
    assert {r.current for r in human.listing(labels).where("task = 'u'").collect()} == {True, False}

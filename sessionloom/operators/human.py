"""People's labels of runs as a revision history, and evaluations against runs that they accepted."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.files import Folder
from ..functions.payloads import dumps
from ..sources.normalize import stable_id
from . import baseline as B
from . import runs as R
from .archive import write_batch
from .assessment import current_labels, human_assessment
from .evaluation import as_batch
from .models import Complete, annotated
from .policy import Gates, HumanGates, Policy, need, only

NAME, VERSION, MAX_ORACLES = "labels.json", 1, 5
LABELS = "id string, task string, trajectory string, step long, reward int, reviewer string, note string, origin string, oracle boolean, created_at string, supersedes string, seq long"
FIELDS = ("id", "task", "trajectory_id", "trajectory", "step", "reward", "reviewer", "note", "origin", "oracle", "created_at", "supersedes")


def _digest(label: dict) -> str:
    return stable_id(dumps({k: v for k, v in label.items() if k != "id"}))


def _key(label: dict) -> tuple:
    return label["task"], label["trajectory_id"], label["step"]


def checked(label: dict) -> dict:
    """A label that says what, by whom and why; only a whole task that passed can be a reference."""
    need(all(isinstance(label[k], str) and label[k].strip() for k in ("task", "reviewer", "note")), "a label needs a task, a reviewer and a note")
    need(type(label["reward"]) is int and label["reward"] in (0, 1) and label["origin"] in ("human", "synthetic"), "a label's reward is 0 or 1 and its origin human or synthetic")
    steps = len(R.verified(label["trajectory"])["step_events"])
    need(label["step"] is None or (type(label["step"]) is int and 1 <= label["step"] <= steps), "a label's step is one of the run's, from 1 on")
    need(not label["oracle"] or (label["reward"] == 1 and label["step"] is None), "only a whole task that passed can be accepted as a reference")
    need(label["trajectory"]["trajectory_id"] == label["trajectory_id"], "a label names another run than it holds")
    return label


def load(folder: str) -> list[dict]:
    """All revisions in order, if their history is whole; no file is no labels."""
    place = Folder(folder)
    if not place.has(NAME):
        return []
    value = only(json.loads(place.read(NAME)), ("version", "labels"), "the registry of labels")
    need(value.get("version") == VERSION, "the registry of labels has another version")
    return verified(value["labels"])


def verified(labels: list[dict]) -> list[dict]:
    last: dict[tuple, str] = {}
    seen = set()
    for label in labels:
        only(label, FIELDS, "a label")
        checked(label)
        need(_digest(label) == label["id"] and label["id"] not in seen, "a label isn't what its id says")
        need(last.get(_key(label)) == label["supersedes"], "a revision doesn't supersede the one before it")
        seen.add(label["id"])
        last[_key(label)] = label["id"]
    return labels


def current(labels: Iterable[dict]) -> list[dict]:
    """The last revision of each key, in the order of the registry."""
    last = {_key(x): x["id"] for x in labels}
    return [x for x in labels if last[_key(x)] == x["id"]]


def annotate(folder: str, run: dict, task: str, reward: int, reviewer: str, note: str, step: int | None = None, origin: str = "human", oracle: bool = False, replace: bool = False) -> dict:
    """Add a label of a run (:func:`runs.document`).

    The same again changes nothing; another for the same task, run and step
    needs ``replace``, and supersedes the one before.
    """
    place = Folder(folder)
    with place.locked("labels"):
        labels = load(folder)
        label = {"id": "", "task": task, "trajectory_id": run["trajectory_id"], "trajectory": run, "step": step, "reward": reward, "reviewer": reviewer, "note": note, "origin": origin, "oracle": oracle, "created_at": datetime.now(timezone.utc).isoformat(), "supersedes": None}
        checked(label)
        old = next((x for x in current(labels) if _key(x) == _key(label)), None)
        if old and all(old[k] == label[k] for k in ("reward", "reviewer", "note", "origin", "oracle")):
            return old
        need(old is None or replace, "there is a label already; replace records a revision of it")
        label = json.loads(dumps(label | {"supersedes": old["id"] if old else None}))
        label["id"] = _digest(label)
        place.write(NAME, dumps({"version": VERSION, "labels": [*labels, label]}).encode())
    return label


def table(spark: SparkSession, labels: list[dict]) -> DataFrame:
    """The registry as ``id, task, trajectory, step, reward, reviewer, note, origin, oracle, created_at, supersedes, seq``."""
    rows = [(x["id"], x["task"], x["trajectory_id"], x["step"], x["reward"], x["reviewer"], x["note"], x["origin"], x["oracle"], x["created_at"], x["supersedes"], k) for k, x in enumerate(labels)]
    return spark.createDataFrame(rows, LABELS)


def listing(labels: DataFrame) -> DataFrame:
    """All revisions, with whether each is ``current``."""
    now = current_labels(labels).select("id", F.lit(True).alias("current"))
    return labels.join(now, "id", "left").withColumn("current", F.coalesce("current", F.lit(False)))


def oracle_choice(labels: DataFrame, candidates: DataFrame, most: int = MAX_ORACLES) -> DataFrame:
    """``task, candidate, oracle, ord, problem``: the accepted runs that a candidate of a task is held against.

    ``labels`` are revisions, ``candidates`` ``task, candidate`` (a run's id).  A
    task without a reference, with more than ``most``, or whose candidate is
    itself one has the ``problem`` in words, and null otherwise.
    """
    accepted = current_labels(labels).where("step is null and oracle and reward = 1").select("task", F.col("trajectory").alias("oracle"), "seq")
    own = Window.partitionBy("task", "candidate")
    t = candidates.join(accepted, "task", "left").withColumns({"ord": F.row_number().over(own.orderBy("seq")) - 1, "n": F.count("oracle").over(own), "self": F.max((F.col("oracle") == F.col("candidate")).cast("int")).over(own)})
    problem = F.when(F.col("n") == 0, "no reference is accepted").when(F.col("n") > most, "too many references are accepted").when(F.col("self") == 1, "the candidate is its own reference")
    return t.select("task", "candidate", "oracle", "ord", problem.alias("problem"))


def applied_labels(labels: DataFrame, choice: DataFrame) -> DataFrame:
    """``task, candidate, id, role``: the current labels that an evaluation rests on, references first, then the candidate's own."""
    now = current_labels(labels)
    oracles = now.where("step is null and oracle and reward = 1").select("task", F.col("trajectory").alias("oracle"), "id").join(choice.select("task", "candidate", "oracle"), ["task", "oracle"])
    mine = now.select("task", F.col("trajectory").alias("candidate"), "id").join(choice.select("task", "candidate").distinct(), ["task", "candidate"])
    return oracles.select("task", "candidate", "id", F.lit("oracle").alias("role")).unionByName(mine.select("task", "candidate", "id", F.lit("candidate").alias("role")))


def human_failures(gates: HumanGates) -> Column:
    """What people's labels fail, from ``task_reward, mean_reward, coverage`` of ``assessment.human_assessment``."""
    four = lambda c: F.format_string("%.4f", F.col(c).cast("double"))
    found = [F.when(F.col("task_reward") == 0, F.lit("a reviewer marked the task as failed"))]
    if gates.require_human_label:
        found.append(F.when(F.col("task_reward").isNull(), F.lit("no reviewer has labelled the whole task for this run")))
    if gates.min_human_quality is not None:
        low = F.concat(F.lit("reviewed step quality "), four("mean_reward"), F.lit(f" is below {gates.min_human_quality:.4f}"))
        found.append(F.when(F.col("mean_reward").isNull(), F.lit("no step is reviewed, so step quality isn't known")).when(F.col("mean_reward") < gates.min_human_quality, low))
    if gates.min_human_coverage is not None:
        low = F.concat(F.lit("share of reviewed steps "), four("coverage"), F.lit(f" is below {gates.min_human_coverage:.4f}"))
        found.append(F.when(F.coalesce("coverage", F.lit(0.0)) < gates.min_human_coverage, low))
    return F.array_compact(F.array(*found))


@dataclass(frozen=True)
class Options:
    task: str
    policy: Policy = field(default_factory=Policy)
    gates: Gates = field(default_factory=Gates)
    human: HumanGates = field(default_factory=HumanGates)
    oracle_labels: tuple[str, ...] = ()


def select(labels: list[dict], candidate: dict, options: Options) -> tuple[list[dict], list[dict]]:
    """(references, the candidate's own labels) of a task, by the rules of evaluations."""
    wanted = options.oracle_labels
    need(len(set(wanted)) == len(wanted), "a reference is named twice")
    now = [x for x in current(labels) if x["task"] == options.task]
    oracles = [x for x in now if x["oracle"] and (not wanted or x["id"] in wanted)]
    need(not wanted or len(oracles) == len(wanted), "a named reference isn't there, isn't accepted any more, or is of another task")
    need(bool(oracles), "no run is accepted as a reference for this task")
    need(len(oracles) <= MAX_ORACLES, f"at most {MAX_ORACLES} references are used; name some")
    need(all(x["trajectory_id"] != candidate["trajectory_id"] for x in oracles), "a run can't be held against itself; name another reference")
    own = [x for x in now if x["trajectory_id"] == candidate["trajectory_id"]]
    synthetic = any(x["origin"] == "synthetic" for x in oracles + own)
    need(not synthetic or options.human.allow_synthetic, "synthetic labels are no review; allow them explicitly")
    return oracles, own


def evaluate(spark: SparkSession, labels: list[dict], candidate: dict, options: Options, folder: str, models: tuple[Complete, Complete] | None = None) -> dict:
    """Hold a run against the references of a task and against what people said of it.

    Passes if the check passes and no human gate fails.  Labels, references,
    policy and candidate are pinned before any model is asked; going on in the
    same folder needs the same ones.  The result goes to ``result.json``,
    ``report.md`` and an archive.
    """
    verified(labels)
    R.verified(candidate)
    options.policy.checked()
    options.gates.checked()
    options.human.checked()
    oracles, own = select(labels, candidate, options)
    for x in oracles:
        options.policy.checked(len(x["trajectory"]["step_events"]))
    place = Folder(folder)
    with place.locked("human"):
        inputs = json.loads(dumps({"version": VERSION, "options": asdict(options), "candidate": candidate, "oracles": oracles, "labels": own, "judged": models is not None}))
        if not place.has("human-input.json"):
            need(not place.has("result.json") and not place.has("check"), "the folder holds results without the inputs they rest on")
        place.pin("human-input.json", inputs, "labels, references, candidate or policy have changed; use a new folder")
        for name in ("result.json", "report.md"):
            place.remove(name)
        human = assess(spark, own, candidate, options.human)
        wrapped = None
        if models:
            said = {"labels": [{k: x[k] for k in ("id", "step", "reward", "reviewer", "note", "origin")} for x in own], "assessment": human}
            wrapped = models[0], annotated(models[1], said, options.policy.max_input_bytes)
        stored = {"version": B.VERSION, "policy": json.loads(dumps(asdict(options.policy))), "variants": [{"id": x["trajectory_id"], "accepted_at": x["created_at"], "trajectory": x["trajectory"]} for x in oracles]}
        checked_ = B.check(spark, stored, candidate, options.gates, f"{folder}/check", wrapped)
        result = {
            "version": VERSION, "task": options.task, "candidate_trajectory_id": candidate["trajectory_id"], "oracle_label_ids": [x["id"] for x in oracles],
            "synthetic": any(x["origin"] == "synthetic" for x in oracles + own), "passed": checked_["passed"] and not human["failures"], "human": human, "regression": checked_,
        }
        report = report_text(result)
        _archive(spark, result, oracles + own, candidate, report, f"{folder}/archive")
        place.write("result.json", dumps(result).encode())
        place.write("report.md", report.encode())
    return result


def assess(spark: SparkSession, own: list[dict], candidate: dict, gates: HumanGates) -> dict:
    """What people said of one run: its task label, the mean over labelled steps alone, the share of steps labelled."""
    need(len({x["step"] for x in own}) == len(own), "a step has two labels")
    steps = spark.range(len(candidate["step_events"])).select(F.lit(candidate["trajectory_id"]).alias("trajectory"))
    found = human_assessment(table(spark, own), steps) if own else None
    if found is None:
        found = spark.createDataFrame([(None, None, 0.0)], "task_reward int, mean_reward double, coverage double")
    row = found.withColumn("failures", human_failures(gates)).first()
    return {
        "task_label_id": next((x["id"] for x in own if x["step"] is None), None), "task_reward": row["task_reward"], "step_label_ids": [x["id"] for x in own if x["step"] is not None],
        "mean_step_reward": row["mean_reward"], "step_coverage": row["coverage"], "total_steps": len(candidate["step_events"]), "failures": list(row["failures"]),
    }


def report_text(result: dict) -> str:
    own = next(v for v in result["regression"]["variants"] if v["variant"] == result["regression"]["selected_variant"])
    show = lambda x, otherwise: otherwise if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
    h = result["human"]
    failed = [f"- {f}" for f in [*h["failures"], *own["failures"]]] or ["none"]
    facts = [
        f"- task label: {show(h['task_reward'], 'none')}", f"- mean of labelled steps: {show(h['mean_step_reward'], 'none labelled')}", f"- share of steps labelled: {show(h['step_coverage'], '0')}",
        f"- judged step quality: {show(own['mean_quality'], 'not judged')}", f"- required work: {show(own['required_work_coverage'], 'none declared')}",
    ]
    origin = "Some labels are synthetic: this is a demonstration, not a review." if result["synthetic"] else "Labels are by the reviewers they name, which nobody has verified."
    return "\n".join([f"# {result['task']}: {'passed' if result['passed'] else 'failed'}", "", origin, "People's labels and a judge's rewards are kept apart; a label of the task says nothing about a step.", "", "## Failures", "", *failed, "", "## Facts", "", *facts, ""])


def _archive(spark: SparkSession, result: dict, labels: list[dict], candidate: dict, report: str, root: str) -> str:
    """Labels, result and report as a batch named after what they say."""
    name = stable_id(dumps(result), dumps(labels), report)
    head = (candidate["harness"], candidate["session_id"])
    rows = [("human_label", x["trajectory"]["harness"], x["trajectory"]["session_id"], x["note"], dumps(x)) for x in labels]
    rows += [("human_evaluation", *head, "passed" if result["passed"] else "failed", dumps(result)), ("human_report", *head, report, dumps({"task": result["task"], "report": report, "synthetic": result["synthetic"]}))]
    table_ = spark.createDataFrame([(name, h, s, "human-evaluation", k, kind, text, None, payload) for k, (kind, h, s, text, payload) in enumerate(rows)], "source_id string, harness string, session_id string, source_path string, position long, kind string, text string, model string, payload string")
    records, events = as_batch(table_, "human-1")
    return write_batch(records, events, root, "human-evaluation", name=name)

"""Whole runs: a session's events as ordered steps with what identifies, proves and finds each."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import payloads
from ..functions.columns import stable_id
from ..functions.workspace import ship
from ..schemas import EVENTS
from . import trajectory as T
from .query import SESSION

#: What of an event a run's identity covers.
IDENTITY = tuple(x.name for x in EVENTS)
_EVENT = "at int, id string, kind string, role string, text string, tool_call_id string, payload_json string"
_NAMES = tuple(x.split()[0] for x in _EVENT.split(", "))
_STRUCT = "struct<" + ",".join(f"{n}:{t}" for n, t in (x.split() for x in _EVENT.split(", "))) + ">"
STEPS = f"run string, idx long, kind string, key string, evidence string, search string, event_ids array<string>, events array<{_STRUCT}>"


@dataclass(frozen=True)
class Runs:
    """``runs``: a row for each; ``steps``: :data:`STEPS`; ``events``: all of them with ``run`` and ``at``."""

    runs: DataFrame
    steps: DataFrame
    events: DataFrame


def _mark(c: Column) -> Column:
    return F.coalesce(F.sha2(c.cast("string"), 256), F.lit("-"))


def event_mark(event: dict) -> str:
    """The digest of one event, as the engine makes it."""
    one = (event.get(name) for name in IDENTITY)
    return hashlib.sha256(",".join("-" if x is None else hashlib.sha256(str(x).encode()).hexdigest() for x in one).encode()).hexdigest()


def run_mark(harness: str, session: str, events: list[dict], final_output: str | None, source: str) -> str:
    """A run's ``trajectory_id`` from its events in order."""
    parts = [harness, session, *(event_mark(e) for e in events), "-" if final_output is None else hashlib.sha256(final_output.encode()).hexdigest(), source]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


#: Steps that a worker has as Python objects at once.
_AT_ONCE = 256


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(k, _AT_ONCE) for b in batches for k in range(0, b.num_rows, _AT_ONCE)):
        kinds, keys, evidence, search, ids = [], [], [], [], []
        for events in batch.column(2).to_pylist():
            head = events[0]
            key = payloads.action_key(head["kind"], head["role"], head["text"], head["payload_json"])
            kinds.append(head["kind"])
            keys.append(key)
            evidence.append(payloads.evidence_key(key, [(e["text"], e["payload_json"]) for e in events if e["kind"] == "tool_result"]))
            search.append(payloads.searchable([(e["kind"], e["text"], e["payload_json"]) for e in events]))
            ids.append([e["id"] for e in events])
        made = [pa.array(x, pa.string()) for x in (kinds, keys, evidence, search)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made, pa.array(ids, pa.list_(pa.string())), batch.column(2)], [x.split()[0] for x in STEPS.split(", ")[:7]] + ["events"])


def keyed_steps(grouped: DataFrame) -> DataFrame:
    """:data:`STEPS` from ``run, idx, events``."""
    ship(grouped.sparkSession)
    return grouped.select("run", "idx", "events").mapInArrow(_keyed, STEPS)


def first_of_each(events: DataFrame) -> DataFrame:
    """Each id once: its first row in batch order, or in the order of the transcript where batches aren't known."""
    order = ["batch_ord"] if "batch_ord" in events.columns else ["source_id", "position", "sub_index"]
    n = F.row_number().over(Window.partitionBy("id").orderBy(*order))
    return events.withColumn("_n", n).where("_n = 1").drop("_n")


def keeper(spark: SparkSession, folder: str) -> Callable[[DataFrame, str], DataFrame]:
    """What writes a table under its name below a folder that all executors share, and reads it back."""

    def keep(table: DataFrame, name: str) -> DataFrame:
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(table.schema).parquet(f"{folder}/{name}")

    return keep


def trajectories(events: DataFrame, leaves: DataFrame | None = None, given: DataFrame | None = None, keep: Callable[[DataFrame, str], DataFrame] = lambda table, _: table) -> Runs:
    """All sessions of ``events`` as runs.

    Each id counts once; a session whose entries form a tree is cut to one branch
    (``leaves``); ``given`` (``harness, session_id, final_output``) replaces the
    output found at the end.  A session without a step has a run with none.
    ``keep`` (:func:`keeper`) stores each table before the next is made of it.
    """
    one = T.on_branch(first_of_each(events), leaves)
    ordered = keep(T.chronology(one).withColumn("run", stable_id(*SESSION)), "events")
    marked = T.steps(ordered)
    struct = F.struct(*(F.col(n) for n in _NAMES))
    grouped = marked.groupBy("run", F.col("step").cast("long").alias("idx")).agg(F.array_sort(F.collect_list(struct)).alias("events"))
    steps = keep(keyed_steps(grouped), "steps")

    found = T.outputs(ordered)
    if given is not None:
        own = given.select(*SESSION, F.col("final_output").alias("given"))
        found = found.join(own, list(SESSION), "left").select(*SESSION, F.coalesce("given", "final_output").alias("final_output"), F.when(F.col("given").isNotNull(), "explicit_file").otherwise(F.col("final_output_source")).alias("final_output_source"))
    event = F.sha2(F.concat_ws(",", *(_mark(F.col(n)) for n in IDENTITY)), 256)
    marks = ordered.groupBy("run", *SESSION).agg(F.array_sort(F.collect_list(F.struct("at", event.alias("mark")))).alias("marks"))
    counted = steps.groupBy("run").agg(F.count(F.lit(1)).alias("steps"))
    runs = marks.join(found, list(SESSION)).join(counted, "run", "left")
    whole = F.concat_ws("\n", F.col("harness"), F.col("session_id"), F.transform("marks", lambda m: m["mark"]), _mark(F.col("final_output")), F.col("final_output_source"))
    runs = runs.select("run", *SESSION, F.coalesce("steps", F.lit(0)).alias("steps"), "final_output", "final_output_source", F.sha2(whole, 256).alias("trajectory_id"))
    return Runs(keep(runs, "runs"), steps, ordered)


def stored(runs: Runs, folder: str) -> Runs:
    """The same runs, written below a folder that all executors share and read back.

    A plan reads steps several times; without this each reading makes them anew.
    """
    keep = keeper(runs.runs.sparkSession, folder)
    return Runs(**{name: keep(getattr(runs, name), name) for name in ("runs", "steps", "events")})


def document(runs: Runs, harness: str | None, session: str) -> dict:
    """One run as a JSON document; exactly one session, with a step, or an error."""
    chosen = runs.runs.where(F.col("session_id") == F.lit(session))
    if harness is not None:
        chosen = chosen.where(F.col("harness") == F.lit(harness))
    rows = chosen.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("no such session" if not rows else "several harnesses have a session of that id; name one")
    run = rows[0]
    if not run["steps"]:
        raise ValueError("the session has no steps of an assistant or a tool")
    # one run: a bounded number of steps
    events = [r.asDict() for r in runs.events.where(F.col("run") == run["run"]).select("at", *IDENTITY).orderBy("at").collect()]
    steps = [list(r["event_ids"]) for r in runs.steps.where(F.col("run") == run["run"]).select("idx", "event_ids").orderBy("idx").collect()]
    return {**run.asDict(), "events": events, "step_events": steps}


def verified(doc: dict) -> dict:
    """The document, if its id is that of what it holds."""
    if run_mark(doc["harness"], doc["session_id"], doc["events"], doc["final_output"], doc["final_output_source"]) != doc["trajectory_id"]:
        raise ValueError("a stored run isn't what its checksum says")
    if not doc["step_events"]:
        raise ValueError("a stored run has no steps")
    return doc


def from_documents(spark, docs: list[dict]) -> Runs:
    """Stored runs as tables again, each under its ``trajectory_id`` as ``run``."""
    heads, events, steps = [], [], []
    for doc in docs:
        own = {e["id"]: e for e in doc["events"]}
        run = doc["trajectory_id"]
        heads.append((run, doc["harness"], doc["session_id"], len(doc["step_events"]), doc["final_output"], doc["final_output_source"], run))
        events += [(run, e["at"], *(e[n] for n in IDENTITY)) for e in doc["events"]]
        steps += [(run, k, [tuple(own[i][n] for n in _NAMES) for i in ids]) for k, ids in enumerate(doc["step_events"])]
    types = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in EVENTS)
    return Runs(
        spark.createDataFrame(heads, "run string, harness string, session_id string, steps long, final_output string, final_output_source string, trajectory_id string"),
        keyed_steps(spark.createDataFrame(steps, f"run string, idx long, events array<{_STRUCT}>")),
        spark.createDataFrame(events, f"run string, at int, {types}"),
    )

"""Transcripts of sessions as records and events, in batches and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workspace import ship
from ..schemas import EVENTS, RECORDS
from . import normalize
from .discover import matches_project

_EVENT = "id:string,sub_index:bigint,native_id:string,parent_id:string,timestamp:string,kind:string,role:string,text:string,model:string,tool_call_id:string,payload_json:string"
PARSED = (
    "id string, harness string, session_id string, source_id string, source_path string, parent_session_id string, position long, "
    f"captured_at string, status string, diagnostic string, adapter_version string, raw binary, events array<struct<{_EVENT}>>"
)
_KINDS = {"string": pa.string(), "bigint": pa.int64()}
_STRUCT = pa.struct([(n, _KINDS[t]) for n, t in (x.split(":") for x in _EVENT.split(","))])
_FIELDS = [
    ("id", pa.string()), ("harness", pa.string()), ("session_id", pa.string()), ("source_id", pa.string()), ("source_path", pa.string()), ("parent_session_id", pa.string()), ("position", pa.int64()),
    ("captured_at", pa.string()), ("status", pa.string()), ("diagnostic", pa.string()), ("adapter_version", pa.string()), ("raw", pa.binary()), ("events", pa.list_(_STRUCT)),
]
_ROWS = 2000


def packed(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in _FIELDS], [n for n, _ in _FIELDS])


def _parse(harness: str, project: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, captured, content, raw_input in zip(*(batch.column(k).to_pylist() for k in range(4))):
                source, rows = normalize.identify(harness, path, content), []
                if source and not matches_project(source, path, project):
                    continue
                for position, raw in normalize.lines(content) if source else ():
                    own = raw_input if raw_input is not None and source["format"] == "hooks" else raw
                    rows.append(normalize.parse(source, position, own) | {"source_path": path, "captured_at": captured})
                    if len(rows) == _ROWS:
                        yield packed(rows)
                        rows = []
                yield packed(rows)

    return run


def read(spark: SparkSession, harness: str, *roots: str, project: str | None = None) -> DataFrame:
    """Every complete line below ``roots`` (``.jsonl``, ``.ndjson``) as a parsed row.

    A file is read as a whole (below 2 GB, Spark's limit for binary files), by
    one task; a file without a header of the format gives no rows.  ``project``
    asks for text in the working directory or the path.  A spooled hook's record
    holds the bytes that came, which are in a ``.stdin`` file beside it.
    """

    def files(pattern: str) -> DataFrame:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(list(roots))

    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    lines = files("*.{jsonl,ndjson}").select("path", now.alias("captured_at"), "content")
    if harness == "cursor":
        inputs = files("*.stdin").select(F.regexp_replace("path", r"\.stdin$", "").alias("_stem"), F.col("content").alias("raw_input"))
        lines = lines.withColumn("_stem", F.regexp_replace("path", r"\.(jsonl|ndjson)$", "")).join(inputs, "_stem", "left").drop("_stem")
    else:
        lines = lines.withColumn("raw_input", F.lit(None).cast("binary"))
    ship(lines.sparkSession)
    return lines.mapInArrow(_parse(harness, project), PARSED)


def records_of(parsed: DataFrame) -> DataFrame:
    """One row for each line, in the stored schema; a line seen twice counts once."""
    return parsed.select(*(x.name for x in RECORDS)).dropDuplicates(["id"])


def events_of(parsed: DataFrame) -> DataFrame:
    e = parsed.select(F.col("id").alias("record_id"), "harness", "session_id", "source_id", "parent_session_id", "position", F.explode("events").alias("e"))
    outer = {"record_id", "harness", "session_id", "source_id", "parent_session_id", "position"}
    columns = [F.col(x.name) if x.name in outer else F.col("e." + x.name).alias(x.name) for x in EVENTS]
    return e.select(*columns).dropDuplicates(["id"])


def with_hook_flag(events: DataFrame) -> DataFrame:
    """``is_hook``: whether the payload itself, not something in it, has a hook's name as a string, whatever the harness."""
    payload = F.try_parse_json("payload_json")
    name = F.schema_of_variant(F.try_variant_get(payload, "$.hook_event_name", "variant"))
    return events.withColumn("is_hook", F.coalesce(name == "STRING", F.lit(False)))

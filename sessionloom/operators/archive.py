"""Immutable batches: Parquet tables, an inventory with checksums, and a manifest; whole or not there."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filesystem import delete, digests, exists, listed, move, read, write
from ..schemas import EVENTS, MANIFEST, RECORDS, SCHEMA_VERSION
from ..sources.normalize import stable_id
from .batchindex import write_index
from .catalog import MAX_INVENTORY, active_manifests, inventory_problems, validate_manifests
from .query import distinct_first

#: Below an archive's root: where batches are made before they get their name.
STAGING = ".staging"


def _files(spark: SparkSession, batch: str) -> list[str]:
    return [path for path, _, _ in listed(spark, batch) if path.endswith(".parquet") and path.startswith(("records/", "events/"))]


def session_summaries(records: DataFrame, events: DataFrame) -> DataFrame:
    keys = ["harness", "session_id"]
    r = records.groupBy(*keys).agg(F.count("*").alias("records"))
    e = events.groupBy(*keys).agg(F.count("*").alias("events"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"))
    return r.join(e, keys, "left").select(*keys, "records", F.coalesce("events", F.lit(0)).alias("events"), "first_timestamp", "last_timestamp")


def batch_id(records: DataFrame) -> str:
    """From the records' ids alone, so a retry finds what it wrote before.

    Only an order-free digest of the ids leaves the executors.
    """
    row = records.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring("id", 1, 15), 16, 10).cast("decimal(38,0)")).alias("a"), F.sum(F.conv(F.substring("id", 16, 15), 16, 10).cast("decimal(38,0)")).alias("b")).first()
    return stable_id(str(row["n"]), str(row["a"]), str(row["b"]))


def write_batch(records: DataFrame, events: DataFrame, root: str, collector: str, replaces: list[str] | None = None, name: str | None = None) -> str:
    """Write a batch below ``root`` and return its id; one that is there already is verified and left alone.

    It is made under :data:`STAGING` and gets its place by one rename, so readers
    and other writers see all of it or nothing (on file systems that rename at
    once; the manifest is the last file in any case).  What it says about itself
    (:mod:`.batchindex`) is made there too.  More than 10,000 sessions
    or files, and a manifest that isn't well formed, are errors before that.
    """
    spark = records.sparkSession
    own = name or batch_id(records)
    final = f"{root}/{own}"
    if exists(spark, f"{final}/manifest.json"):
        if not verify(spark, root, own).isEmpty():
            raise ValueError(f"batch {own} is there but isn't what its inventory says")
        return own
    path = f"{root}/{STAGING}/{uuid.uuid4().hex}"
    try:
        records.select(*(x.name for x in RECORDS)).repartitionByRange("harness", "session_id", "position").write.parquet(f"{path}/records")
        events.select(*(x.name for x in EVENTS)).repartitionByRange("harness", "session_id", "position").write.parquet(f"{path}/events")
        stored = (spark.read.schema(RECORDS).parquet(f"{path}/records"), spark.read.schema(EVENTS).parquet(f"{path}/events"))
        sessions = session_summaries(*stored).orderBy("harness", "session_id").limit(MAX_INVENTORY + 1).collect()
        paths = _files(spark, path)
        if len(sessions) > MAX_INVENTORY or len(paths) > MAX_INVENTORY:
            raise ValueError(f"a batch has at most {MAX_INVENTORY} sessions and files; write several")
        manifest = {
            "schema_version": SCHEMA_VERSION, "collector_id": collector, "batch_id": own, "created_at": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z",
            "sessions": [r.asDict() for r in sessions], "files": [r.asDict() for r in digests(spark, path, paths).orderBy("path").collect()], "replaces": sorted(set(replaces or [])),
        }
        wrong = validate_manifests(spark.createDataFrame([manifest], MANIFEST)).where("not valid").first()
        if wrong:
            raise ValueError(f"the batch's manifest isn't well formed: {wrong['problems']}")
        write_index(spark, path, sum(r["records"] for r in sessions))
        write(spark, f"{path}/manifest.json", json.dumps(manifest).encode())
        if not move(spark, path, final) and not exists(spark, f"{final}/manifest.json"):
            raise ValueError(f"batch {own} couldn't be put in its place")
    finally:
        delete(spark, path)
    return own


def manifest(spark: SparkSession, batch: str) -> dict:
    """One batch's manifest, if it is well formed."""
    value = json.loads(read(spark, f"{batch}/manifest.json"))
    wrong = validate_manifests(spark.createDataFrame([value], MANIFEST)).where("not valid").first()
    if wrong:
        raise ValueError(f"the manifest of {batch} isn't well formed: {wrong['problems']}")
    return value


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """All manifests below ``root``; one that isn't well formed is an error where it is read."""
    found = spark.read.schema(MANIFEST).option("multiLine", "true").json(f"{root}/*/manifest.json")
    from .catalog import manifest_problems

    problems = manifest_problems()
    checked = F.when(F.size(problems) == 0, F.col("batch_id")).otherwise(F.raise_error(F.concat(F.lit("a manifest isn't well formed: "), F.array_join(problems, "; "))).cast("string"))
    return found.withColumn("batch_id", checked)


def any_batch(spark: SparkSession, root: str) -> bool:
    from ..functions.filesystem import hadoop

    p, fs = hadoop(spark, f"{root}/*/manifest.json")
    return bool(fs.globStatus(p))


def stored(spark: SparkSession, root: str, names: list[str], kind: str) -> DataFrame:
    """The rows of one table (``records`` or ``events``) of batches as they are, with ``batch_id``."""
    schema = {"records": RECORDS, "events": EVENTS}[kind]
    if not names:
        return spark.createDataFrame([], schema).withColumn("batch_id", F.lit(None).cast("string"))
    rows = spark.read.schema(schema).parquet(*(f"{root}/{n}/{kind}" for n in names))
    return rows.withColumn("batch_id", F.regexp_extract(F.col("_metadata.file_path"), f"([^/]+)/{kind}/[^/]+$", 1))


def _tables(spark: SparkSession, root: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records and events of batches, each id from the first batch that has it."""
    order = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "batch_id string, batch_ord long")
    records, events = (distinct_first(stored(spark, root, names, kind).join(order, "batch_id").drop("batch_id")) for kind in ("records", "events"))
    return records, events


def open_archive(spark: SparkSession, root: str, harness: str | None = None, session: str | None = None, sessions: list[tuple[str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, events) of the active batches that can hold the sessions, each id once: from the first batch that has it.

    Batches are chosen by their manifests' sessions, so other ones aren't read;
    ``sessions`` names several as (harness, id).
    """
    if not any_batch(spark, root):
        return _tables(spark, root, [])
    active = active_manifests(manifests(spark, root))
    if harness or session:
        active = active.where(F.exists("sessions", lambda s: (F.lit(True) if harness is None else s["harness"] == harness) & (F.lit(True) if session is None else s["session_id"] == session)))
    if sessions is not None:
        wanted = spark.createDataFrame(sessions, "harness string, session_id string")
        own = active.select("batch_id", F.explode("sessions").alias("s")).select("batch_id", "s.harness", "s.session_id")
        active = active.join(own.join(wanted, ["harness", "session_id"], "left_semi").select("batch_id").distinct(), "batch_id", "left_semi")
    names = [r["batch_id"] for r in active.select("batch_id", "created_at").orderBy("created_at", "batch_id").collect()]  # a catalog, not data
    return _tables(spark, root, names)


def compact(spark: SparkSession, root: str, members: list[str], collector: str) -> str:
    """Merge batches into one that replaces them, and what they replaced; members are in their order."""
    old = manifests(spark, root).where(F.col("batch_id").isin(members))
    gone = sorted({*members, *(r["b"] for r in old.select(F.explode("replaces").alias("b")).distinct().collect())})
    records, events = _tables(spark, root, members)
    return write_batch(records, events, root, collector, gone, stable_id("compact", *members))


def verify(spark: SparkSession, root: str, batch: str) -> DataFrame:
    """What differs from the batch's inventory; no rows if nothing does."""
    inventory = spark.createDataFrame([(f["path"], f["size"], f["sha256"]) for f in manifest(spark, f"{root}/{batch}")["files"]], "path string, size long, sha256 string")
    return inventory_problems(digests(spark, f"{root}/{batch}", _files(spark, f"{root}/{batch}")), inventory)

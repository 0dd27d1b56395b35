"""The catalog of batches: which are active, which to upload, which to compact, which are well formed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_relative, valid_id, valid_timestamp
from ..functions.workspace import ship
from ..schemas import SCHEMA_VERSION

MAX_INVENTORY = 10000
MAX_PATH = 1024
MAX_SESSION_ID = 1024
MAX_NUMBER = (1 << 53) - 1
#: Remotes are a short list in a configuration.
MAX_REMOTES = 100


def active_manifests(manifests: DataFrame) -> DataFrame:
    """Batches that no batch of the same collector replaces."""
    gone = manifests.select("collector_id", F.explode("replaces").alias("batch_id")).distinct()
    return manifests.join(gone, ["collector_id", "batch_id"], "left_anti")


def _few(remotes: DataFrame) -> DataFrame:
    """A short list, checked to be one, that may meet every batch."""
    if remotes.limit(MAX_REMOTES + 1).count() > MAX_REMOTES:
        raise ValueError(f"there are more than {MAX_REMOTES} remotes")
    return F.broadcast(remotes.distinct())


def upload_backlog(batches: DataFrame, remotes: DataFrame, uploaded: DataFrame) -> DataFrame:
    """Per remote (a short list): batches and bytes that it doesn't have yet."""
    open_ = batches.select("batch_id", "bytes").crossJoin(_few(remotes)).join(uploaded, ["remote", "batch_id"], "left_anti")
    return open_.groupBy("remote").agg(F.count("*").alias("backlog"), F.sum("bytes").alias("bytes"))


def _grouped(max_bytes: int, max_ids: int):
    """Adds each batch's group to ``order, batch_id, bytes, n`` rows that come in order; holds what the open group has, and no rows."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = ids = held = group = 0
        for frame in frames:
            out = []
            for more, n in zip(frame.column(2).to_pylist(), frame.column(3).to_pylist()):
                if held and (size + more > max_bytes or ids + n > max_ids):
                    group, size, ids, held = group + 1, 0, 0, 0
                large = more > max_bytes
                if not large:
                    size, ids, held = size + more, ids + n, held + 1
                out.append(None if large else group)
            yield pa.RecordBatch.from_arrays([*frame.columns[:2], pa.array(out, pa.int64())], [*frame.schema.names[:2], "group"])

    return run


def compaction_groups(batches: DataFrame, max_bytes: int, max_ids: int = MAX_INVENTORY, order: str = "seq") -> DataFrame:
    """``group`` for each batch that is to be merged with neighbours.

    Goes through the catalog in order: a batch that doesn't fit the open group
    closes it, one above the size by itself belongs to none, and only groups of
    two or more count.  Where a group ends depends on where the one before did, so
    one task goes through the sorted catalog, which has a row for a batch and not
    for data; it holds one group's sums, and a million batches take seconds.
    """
    ship(batches.sparkSession)
    kind = dict(batches.dtypes)
    listed = batches.select(order, "batch_id", F.col("bytes").cast("long").alias("bytes"), (1 + F.coalesce(F.size("replaces"), F.lit(0))).cast("long").alias("n"))
    sorted_ = listed.orderBy(order, "batch_id").coalesce(1)
    flat = sorted_.mapInArrow(_grouped(max_bytes, max_ids), f"{order} {kind[order]}, batch_id {kind['batch_id']}, group long").where("group is not null")
    return flat.withColumn("_n", F.count("*").over(Window.partitionBy("group"))).where("_n > 1").drop("_n")


def manifest_problems() -> Column:
    """What is wrong with a manifest, in words; empty if it is well formed."""
    paths = F.transform("files", lambda f: f["path"])

    def file_ok(f: Column) -> Column:
        place = f["path"].startswith("records/") | f["path"].startswith("events/")
        return (F.octet_length(f["path"]) < MAX_PATH) & safe_relative(f["path"]) & place & f["size"].between(0, MAX_NUMBER) & F.coalesce(f["sha256"].rlike("^[0-9a-f]{64}$"), F.lit(False))

    def session_ok(s: Column) -> Column:
        return (F.octet_length(s["session_id"]) <= MAX_SESSION_ID) & s["records"].between(0, MAX_NUMBER) & s["events"].between(0, MAX_NUMBER)

    replaces = F.coalesce("replaces", F.array().cast("array<string>"))
    rules = {
        "another schema version": F.col("schema_version") == SCHEMA_VERSION,
        "ids that may not be paths": valid_id("collector_id") & valid_id("batch_id"),
        "no time of creation": valid_timestamp("created_at"),
        "an inventory out of order": F.size("files").between(1, MAX_INVENTORY) & F.forall("files", file_ok) & (F.size(F.array_distinct(paths)) == F.size(paths)),
        "a table without files": F.exists(paths, lambda p: p.startswith("records/")) & F.exists(paths, lambda p: p.startswith("events/")),
        "sessions out of bounds": (F.size("sessions") <= MAX_INVENTORY) & F.forall("sessions", session_ok),
        "a list of replaced batches out of order": (F.size(replaces) <= MAX_INVENTORY) & F.forall(replaces, lambda r: valid_id(r) & (r != F.col("batch_id"))) & (F.size(F.array_distinct(replaces)) == F.size(replaces)),
    }
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(what)) for what, ok in rules.items())))


def validate_manifests(manifests: DataFrame) -> DataFrame:
    problems = manifest_problems()
    return manifests.select("batch_id", F.array_join(problems, "; ").alias("problems"), (F.size(problems) == 0).alias("valid"))


def inventory_problems(have: DataFrame, inventory: DataFrame) -> DataFrame:
    """Files whose size or checksum isn't what the inventory says, missing ones and ones not listed; both sides are ``path, size, sha256``."""
    own = have.select("path", F.col("size").alias("have_size"), F.col("sha256").alias("have_sha"))
    both = inventory.join(own, "path", "full_outer")
    state = F.when(F.col("have_sha").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when((F.col("size") != F.col("have_size")) | (F.col("sha256") != F.col("have_sha")), "changed")
    return both.select("path", state.alias("problem")).where("problem is not null")


def verify_inventory(files: DataFrame, inventory: DataFrame) -> DataFrame:
    """:func:`inventory_problems` of Spark's ``binaryFile`` rows with a relative ``path``."""
    return inventory_problems(files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")), inventory)


def manifest_bytes(manifests: DataFrame) -> DataFrame:
    """``bytes`` of each batch: the sum of its files' sizes."""
    return manifests.withColumn("bytes", F.aggregate("files", F.lit(0).cast("long"), lambda total, f: total + f["size"]))


def due_for_deletion(batches: DataFrame, replaced: DataFrame, before: Column) -> DataFrame:
    """Batches (``batch_id`` and more) replaced at or before a time: ``replaced`` is ``batch_id, replaced_at``."""
    return batches.join(replaced.where(F.col("replaced_at") <= before).select("batch_id").distinct(), "batch_id")


def session_batches(manifests: DataFrame) -> DataFrame:
    """``harness, session_id, batches``: which batches hold each session, in order."""
    own = manifests.select("batch_id", F.explode("sessions").alias("s")).select("s.harness", "s.session_id", "batch_id")
    return own.groupBy("harness", "session_id").agg(F.array_sort(F.collect_set("batch_id")).alias("batches"))


def replaced_union(manifests: DataFrame, members: Column) -> DataFrame:
    """``replaces``: the members of a merge and all that they replaced, each once and in order."""
    own = manifests.where(members).select(F.explode(F.concat(F.array("batch_id"), "replaces")).alias("b"))
    return own.agg(F.array_sort(F.collect_set("b")).alias("replaces"))


def status(sources: DataFrame, seen: DataFrame, pending: DataFrame, batches: DataFrame, uploads: DataFrame, remotes: DataFrame, by: str = "collector_id") -> DataFrame:
    """A row for each collector: what it has seen, what waits, what is stored and what each remote lacks.

    ``sources`` has a row for a file, ``seen`` one for a record with its
    ``status``, ``pending`` one with ``bytes``, ``batches`` the active ones,
    ``uploads`` ``remote, batch_id, completed_at``.
    """
    counted = sources.groupBy(by).agg(F.count("*").alias("sources"))
    kinds = seen.groupBy(by).agg(F.count("*").alias("captured_records"), F.count_if(F.col("status") == "malformed").alias("parse_failures"), F.count_if(F.col("status") == "unknown").alias("unknown_records"))
    waiting = pending_size(pending, by)
    stored = batches.groupBy(by).agg(F.count("*").alias("batches"))
    lacking = _few(remotes).crossJoin(batches.select(by, "batch_id")).join(uploads.select("remote", "batch_id"), ["remote", "batch_id"], "left_anti").groupBy(by).agg(F.count("*").alias("pending_uploads"))
    newest = uploads.join(batches.select(by, "batch_id"), "batch_id").groupBy(by).agg(F.max("completed_at").alias("last_upload"))
    out = counted
    for t in (kinds, waiting, stored, lacking, newest):
        out = out.join(t, by, "left")
    numbers = ("captured_records", "parse_failures", "unknown_records", "pending_records", "pending_bytes", "batches", "pending_uploads")
    return out.select(by, "sources", *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers), "last_upload")


def pending_size(pending: DataFrame, *by: str) -> DataFrame:
    """``pending_records, pending_bytes``; zeros for an empty queue."""
    return pending.groupBy(*by).agg(F.count("*").alias("pending_records"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("pending_bytes"))

"""Upkeep of an archive: merges, what merges left behind, uploads, and its state in numbers."""

from __future__ import annotations

import os
import time
from collections.abc import Iterable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import instant
from ..functions.filesystem import delete, exists, folders
from . import archive as A
from . import catalog as C

#: Readers may still hold paths of a replaced batch for so long.
RETENTION_SECONDS = 300
STALE_SECONDS = 3600
COMPACT_BYTES = 128 << 20
UPLOADS = "remote string, batch_id string, completed_at string"


def replacements(manifests: DataFrame) -> DataFrame:
    """``batch_id, by_batch, replaced_at``: what each merge replaced, and when."""
    return manifests.select(F.explode("replaces").alias("batch_id"), F.col("batch_id").alias("by_batch"), F.col("created_at").alias("replaced_at"))


def purge_replaced(spark: SparkSession, root: str, age: float = RETENTION_SECONDS) -> list[str]:
    """Delete batches that were replaced at least ``age`` seconds ago; gives their ids."""
    if not A.any_batch(spark, root):
        return []
    known = A.manifests(spark, root)
    gone = replacements(known).withColumn("replaced_at", instant("replaced_at"))
    due = C.due_for_deletion(known.select("batch_id"), gone, F.timestamp_seconds(F.lit(time.time() - age)))
    out = sorted(r["batch_id"] for r in due.collect())  # a catalog, not data
    for name in out:
        delete(spark, f"{root}/{name}")
    return out


def remove_temporaries(spark: SparkSession, root: str, age: float = STALE_SECONDS) -> list[str]:
    """Delete what writers that died left half made, if it has not changed for ``age`` seconds."""
    before = (time.time() - age) * 1000
    old = [name for name, changed in folders(spark, f"{root}/{A.STAGING}") if changed <= before]
    for name in old:
        delete(spark, f"{root}/{A.STAGING}/{name}")
    return old


def active(spark: SparkSession, root: str) -> DataFrame:
    """Active batches with ``bytes``, and ``seq`` in the order of their creation."""
    found = C.manifest_bytes(C.active_manifests(A.manifests(spark, root)))
    return found.withColumn("seq", F.row_number().over(Window.orderBy("created_at", "batch_id")))  # a row for a batch


def compact_all(spark: SparkSession, root: str, collector: str, max_bytes: int = COMPACT_BYTES, age: float = RETENTION_SECONDS) -> list[str]:
    """Merge neighbouring small batches, then delete what is due; gives the ids of merged batches."""
    if not A.any_batch(spark, root):
        return []
    groups: dict[int, list[str]] = {}
    for r in C.compaction_groups(active(spark, root), max_bytes).orderBy("seq").collect():  # a catalog, not data
        groups.setdefault(r["group"], []).append(r["batch_id"])
    out = [A.compact(spark, root, members, collector) for members in groups.values()]
    purge_replaced(spark, root, age)
    return out


def uploads(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root}/.uploads"
    return spark.read.schema(UPLOADS).parquet(path) if exists(spark, path) else spark.createDataFrame([], UPLOADS)


def mark_uploaded(spark: SparkSession, root: str, remote: str, batches: Iterable[str]) -> None:
    now = datetime.now(timezone.utc).isoformat()
    rows = [(remote, b, now) for b in batches]
    if rows:
        spark.createDataFrame(rows, UPLOADS).coalesce(1).write.mode("append").parquet(f"{root}/.uploads")


def status(spark: SparkSession, root: str, remotes: list[str]) -> dict:
    """What an archive holds and each remote lacks."""
    if not A.any_batch(spark, root):
        return {"sources": 0, "records": 0, "malformed": 0, "unknown": 0, "batches": 0, "remotes": {r: {"pending": 0, "last_success": None} for r in remotes}}
    records, _ = A.open_archive(spark, root)
    seen = records.agg(F.countDistinct("source_id").alias("sources"), F.count("*").alias("records"), F.count_if(F.col("status") == "malformed").alias("malformed"), F.count_if(F.col("status") == "unknown").alias("unknown")).first().asDict()
    now, done = active(spark, root), uploads(spark, root)
    lacking = {r["remote"]: r["backlog"] for r in C.upload_backlog(now, spark.createDataFrame([(r,) for r in remotes], "remote string"), done).collect()} if remotes else {}
    last = {r["remote"]: r["at"] for r in done.groupBy("remote").agg(F.max("completed_at").alias("at")).collect()}
    return {**seen, "batches": now.count(), "remotes": {r: {"pending": lacking.get(r, 0), "last_success": last.get(r)} for r in remotes}}


def purge_hook_spool(spool: str, consumed: dict[str, int]) -> list[str]:
    """Delete spooled hook files that are stored in full: ``consumed`` has how many bytes of each path are in a batch.

    The raw input beside a file, and a folder that becomes empty, go with it; a
    file that grew, or that isn't in the spool, stays.
    """
    out, root = [], Path(spool.removeprefix("file://")).resolve()
    for name, upto in sorted(consumed.items()):
        path = Path(name)
        if path.suffix != ".jsonl" or not path.resolve().is_relative_to(root) or not path.exists() or not 0 < path.stat().st_size == upto:
            continue
        path.unlink()
        path.with_suffix(".stdin").unlink(missing_ok=True)
        try:
            os.rmdir(path.parent)
        except OSError:
            pass  # others are still in it
        out.append(name)
    return out

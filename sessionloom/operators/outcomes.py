"""Declared outcomes of a run, checked against what it recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variants


def tool_name(payload_json: Column | str) -> Column:
    """Name of the tool that a call's payload names, in any known shape; null if that isn't a string."""
    name = variants.tool_name(variants.strict(payload_json))
    return F.when(variants.is_string(name), name.try_cast("string"))


def result_text(payload_json: Column | str) -> Column:
    """What a result's payload holds, as JSON with sorted fields; null if nothing."""
    return variants.result_content(variants.strict(payload_json))


KEY = ("harness", "session_id")


def file_digest(path: str) -> tuple[int, str] | None:
    """Size and hex SHA-256 of a file, read in pieces; None if it isn't there."""
    import hashlib

    digest, size = hashlib.sha256(), 0
    try:
        with open(path, "rb") as f:
            for block in iter(lambda: f.read(1 << 20), b""):
                digest.update(block)
                size += len(block)
    except FileNotFoundError:
        return None
    return size, digest.hexdigest()


def all_of(*results: DataFrame) -> DataFrame:
    """``passed`` of each session: all of the checks (each ``harness, session_id, passed``); no session without one."""
    both = results[0].select(*KEY, "passed")
    for r in results[1:]:
        both = both.unionByName(r.select(*KEY, "passed"))
    return both.groupBy(*KEY).agg(F.bool_and("passed").alias("passed"))


def final_equals(finals: DataFrame, expected: str) -> DataFrame:
    """``finals`` has a ``final_output`` for each session, null if it has none."""
    return finals.select(*KEY, F.coalesce(F.col("final_output") == F.lit(expected), F.lit(False)).alias("passed"))


def final_contains(finals: DataFrame, text: str) -> DataFrame:
    return finals.select(*KEY, F.coalesce(F.contains("final_output", F.lit(text)), F.lit(False)).alias("passed"))


def tool_result_contains(steps: DataFrame, tool: str, text: str) -> DataFrame:
    """Whether a result attached to a call of ``tool`` holds ``text``; steps as from ``trajectory.steps``."""
    calls = steps.where("is_head and kind = 'tool_call'").where(tool_name("payload_json") == F.lit(tool)).select(*KEY, "step")
    held = F.coalesce(F.contains("text", F.lit(text)), F.lit(False)) | F.coalesce(F.contains(result_text("payload_json"), F.lit(text)), F.lit(False))
    hits = steps.where("kind = 'tool_result'").join(calls, [*KEY, "step"], "left_semi").where(held).groupBy(*KEY).agg(F.array_sort(F.collect_set("id")).alias("event_ids"))
    return steps.select(*KEY).distinct().join(hits, list(KEY), "left").select(*KEY, F.col("event_ids").isNotNull().alias("passed"), "event_ids")


def artifact_sha256(files: DataFrame, path: str, sha256: str) -> DataFrame:
    """One row: whether the file (of Spark's ``binaryFile`` source) is there with that digest."""
    same = (F.col("path") == F.lit(path)) & (F.sha2("content", 256) == F.lit(sha256.lower()))
    return files.agg(F.coalesce(F.bool_or(same), F.lit(False)).alias("passed"))

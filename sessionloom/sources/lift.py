"""The driver's tables as events, records and messages of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import canonical_time
from ..schemas import EVENTS

KINDS = {"view": "tool_call", "click": "tool_result", "purchase": "message", "signup": "metadata", "error": "unknown"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    harness = F.element_at(F.array(F.lit("codex"), F.lit("pi"), F.lit("cursor")), (F.col("user_id") % 3 + 1).cast("int"))
    session, hook = F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("event_id") % 4 == 0
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.col("event_type"))
    tool = F.col("event_type").isin("view", "click")
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_id").cast("string").alias("record_id"),
        harness.alias("harness"),
        session.alias("session_id"),
        F.concat(session, F.when(hook, ":hooks").otherwise(":rollout")).alias("source_id"),
        F.col("event_id").alias("position"),
        F.lit(0).cast("long").alias("sub_index"),
        canonical_time(F.col("ts")).alias("timestamp"),
        kind.alias("kind"),
        F.when(F.col("event_type") == "purchase", F.when(F.col("value") < 10, "assistant").otherwise("user")).alias("role"),
        F.concat_ws(" ", "event_type", "props").alias("text"),
        F.when(tool, (F.get_json_object("props", "$.k").cast("long") % 10).cast("string")).alias("tool_call_id"),
        F.col("props").alias("payload_json"),
        hook.alias("is_hook"),
        F.col("event_id").alias("batch_ord"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sessions of messages, at their turns."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    session = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    return c.select(
        F.concat(session, F.lit(":"), F.col("turn").cast("string")).alias("id"), F.lit("pi").alias("harness"), session.alias("session_id"), session.alias("source_id"),
        F.col("turn").alias("position"), F.lit(0).cast("long").alias("sub_index"), F.lit("message").alias("kind"), "role", "text", "conv_id", "turn",
    )


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sessions, with every column that stored events have."""
    m = messages(spark, sf_dir).withColumn("harness", F.lit("codex"))
    own = {"record_id": F.col("id"), "payload_json": F.lit("{}")}
    out = m.withColumns(own)
    return out.select(*((F.col(x.name) if x.name in out.columns else F.lit(None).cast(x.dataType)).alias(x.name) for x in EVENTS))


def run_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(reference, candidate) steps: each conversation of an even number with the one after it.

    A step's key is coarse (role, and length in hundreds of characters), since texts never repeat.
    """
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    key = F.concat_ws("/", "role", F.floor(F.char_length("text") / 100).cast("string"))
    step = c.select((F.col("conv_id") - F.col("conv_id") % 2).alias("pair"), (F.col("conv_id") % 2).alias("side"), F.col("turn").alias("idx"), key.alias("key"), "text")
    return step.where("side = 0").drop("side"), step.where("side = 1").drop("side")


def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as tool calls and clicks as results, a session for each user, with every column that stored events have.

    Calls take turns in two shapes of payload; a result belongs to the latest call of its id.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type").isin("view", "click"))
    k, call = F.get_json_object("props", "$.k").cast("long"), F.col("event_type") == "view"
    given = F.concat(F.lit('{"q": "shelf '), (k % 4).cast("string"), F.lit('", "k": '), (k % 2).cast("string"), F.lit("}"))
    named, tagged = F.concat(F.lit('{"name": "view", "arguments": '), given, F.lit("}")), F.concat(F.lit('{"tool_call": {"view": {"args": '), given, F.lit("}}}"))
    session = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    own = {
        "id": F.col("event_id").cast("string"), "record_id": F.col("event_id").cast("string"), "harness": F.lit("codex"), "session_id": session, "source_id": session, "position": F.col("event_id"), "sub_index": F.lit(0),
        "kind": F.when(call, "tool_call").otherwise("tool_result"), "text": F.when(~call, F.concat(F.lit("found "), (k % 5).cast("string"))), "tool_call_id": (k % 3).cast("string"),
        "payload_json": F.when(~call, F.concat(F.lit('{"output": '), (k % 5).cast("string"), F.lit(', "call_id": "'), F.col("event_id").cast("string"), F.lit('"}'))).when(F.col("event_id") % 2 == 0, named).otherwise(tagged),
    }
    return e.select(*((own[x.name] if x.name in own else F.lit(None)).cast(x.dataType).alias(x.name) for x in EVENTS))

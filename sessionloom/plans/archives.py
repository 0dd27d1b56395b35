"""Registered queries that store a table as batches of an archive and ask these, with their SQL twins."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.workspace import fresh_dir, ship
from ..operators import archive as A
from ..operators import lookup as L
from ..operators.query import Query
from ..schemas import EVENTS, RECORDS
from ..sources import lift
from .catalogue import COLLAPSED, EV, _SUMMARY
from .registration import register

#: Sessions of a batch, of which an inventory has at most 10,000: room for uneven shares.
SESSIONS = 6000
#: Tasks that a batch is dealt by, and batches that are written side by side.
SPREAD, AT_ONCE = 4, 6


def stored_events(spark: SparkSession, d: str) -> str:
    """The events as an archive; gives its root.

    Sessions are dealt out by their number; users whose number ends with 5 are in
    the batches of the odd ones too, as if two collectors had read them.
    """
    root = fresh_dir(spark, "archive")
    e = lift.events(spark, d).withColumn("payload_json", F.when(F.col("is_hook"), '{"hook_event_name":"stop"}').otherwise(F.coalesce("payload_json", F.lit("{}"))))
    user = F.substring("session_id", 2, 20).cast("long")
    shares = -(-spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct().count() // SESSIONS) or 1
    parts = F.array_compact(F.array(F.when((user % 2 == 0) | (user % 10 == 5), "even"), F.when(user % 2 == 1, "odd")))
    dealt = e.withColumn("share", F.pmod(F.xxhash64("session_id"), F.lit(shares))).withColumn("part", F.explode(parts)).withColumn("part", F.concat_ws("-", "part", "share"))
    # the table is read once: each batch has a folder of its own
    folder = fresh_dir(spark, "dealt")
    dealt.drop("share").repartition("part", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).write.partitionBy("part").parquet(folder)
    every = spark.read.parquet(folder)

    def put(name: str) -> None:
        own = spark.read.schema(StructType([x for x in every.schema if x.name != "part"])).parquet(f"{folder}/part={name}")
        events = own.select(*((F.col(x.name) if x.name in own.columns else F.lit(None).cast(x.dataType)).alias(x.name) for x in EVENTS))
        made = {"id": F.col("record_id"), "source_path": F.col("source_id"), "captured_at": F.col("timestamp"), "status": F.lit("parsed"), "adapter_version": F.lit("1"), "raw": F.encode("text", "UTF-8"), "diagnostic": F.lit(None).cast("string")}
        records = own.withColumns(made).select(*(x.name for x in RECORDS))
        A.write_batch(records, events, root, "me", name=name)

    names = sorted(r["part"] for r in every.select("part").distinct().collect())  # a catalog, not data
    ship(spark)
    # batches don't need each other
    with ThreadPoolExecutor(AT_ONCE) as pool:
        for job in [pool.submit(put, n) for n in names]:
            job.result()
    return root


@register("archive_contains", EV + " select id, harness, session_id, position, text from ev where contains(text, ': 42') and \"timestamp\" >= '2024-01-02T00:00:00.000Z'")
def archive_contains(spark: SparkSession, d: str) -> DataFrame:
    found = L.find(spark, stored_events(spark, d), Query(text=": 42", since="2024-01-02T00:00:00Z"))
    return found.select("id", "harness", "session_id", "position", "text")


@register("archive_summaries", EV + COLLAPSED.format(source="ev") + _SUMMARY.format(n="coalesce(e.events, 0)", join="left join"))
def archive_summaries(spark: SparkSession, d: str) -> DataFrame:
    return L.archive_summaries(spark, stored_events(spark, d))


@register("archive_known_records", EV + " select id from ev where position % 7 = 0")
def archive_known_records(spark: SparkSession, d: str) -> DataFrame:
    """Of a seventh of the events, and as many of the same sessions that nobody stored, those that the archive has."""
    own = lift.events(spark, d).where("position % 7 = 0").select("id", "harness", "session_id")
    return L.known_records(spark, stored_events(spark, d), own.unionByName(own.withColumn("id", F.concat(F.lit("new-"), "id"))))

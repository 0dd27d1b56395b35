"""What a batch knows about itself beside its tables: which ids, which pieces of text, and sums that add up.

Three small tables go under ``index/`` of a batch, before it gets its place:

* ``ids``: a Bloom filter of its records' ids;
* ``files`` and ``grams``: for each file of events its least and greatest session and
  time, and a Bloom filter of the strings of :data:`GRAM` bytes in its texts;
* ``sums``: for each session and source the records, and where they begin and end,
  and what its events add to a summary.

They aren't part of the inventory: a batch without them (an older one, or one that
came from a remote) is read where another would be left out, and
:func:`write_index` makes them for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import membership as M
from ..functions.workspace import ship
from ..schemas import EVENTS, RECORDS
from ..sources.transcripts import with_hook_flag
from .query import SESSION, collapse_hooks

GRAM = 4
#: Bytes of text for a block of a file's filter, and the most blocks of one (2 MB).
#: They set how often a file is opened for nothing, never what is found.
BLOCK_BYTES, MOST_BLOCKS = 64, 1 << 15

FILES = "file string, blocks long, least_harness string, greatest_harness string, least_session string, greatest_session string, first_timestamp string, last_timestamp string"
_BITS = ", ".join(f"w{i} long" for i in range(M.WORDS))
IDS, GRAMS = f"block long, {_BITS}", f"file string, blocks long, block long, {_BITS}"
SUMS = "harness string, session_id string, source_id string, records long, distinct_records long, first_position long, last_position long, correlated long, events long, first_timestamp string, last_timestamp string"


def grams(data: bytes) -> np.ndarray:
    """The different strings of four bytes in ``data``, as numbers."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    if len(b) < GRAM:
        return np.empty(0, np.int64)
    return np.unique(b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own: dict[tuple[str, int], list[np.ndarray]] = {}
        for file, blocks, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            own.setdefault((file, blocks), []).append(grams(text))
        for (file, blocks), parts in own.items():
            found = np.unique(np.concatenate(parts))
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(found), pa.string()), pa.array([blocks] * len(found), pa.int64()), pa.array(found)], ["file", "blocks", "gram"])


def _partials(records: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of :data:`SUMS`.  Events are counted after copies of tool events are put together within the batch.

    A session's events stand with the least of its sources, since copies of one
    event may come from several.
    """
    r = records.groupBy(*SESSION, "source_id").agg(F.count("*").alias("records"), F.countDistinct("id").alias("distinct_records"), F.min("position").alias("first_position"), F.max("position").alias("last_position"))
    correlated = F.col("kind").isin("tool_call", "tool_result") & F.col("tool_call_id").isNotNull()
    e = collapse_hooks(with_hook_flag(events.dropDuplicates(["id"]))).groupBy(*SESSION).agg(F.count_if(correlated).alias("correlated"), F.count("*").alias("events"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"))
    least = r.groupBy(*SESSION).agg(F.min("source_id").alias("source_id"))
    placed = r.join(least.join(e, list(SESSION)), [*SESSION, "source_id"], "left")
    return placed.select(*SESSION, "source_id", "records", "distinct_records", "first_position", "last_position", F.coalesce("correlated", F.lit(0)).alias("correlated"), F.coalesce("events", F.lit(0)).alias("events"), "first_timestamp", "last_timestamp")


def write_index(spark: SparkSession, batch: str, records: int) -> None:
    """Make the tables under ``index/`` of a stored batch with so many records."""
    ship(spark)
    recs, evs = spark.read.schema(RECORDS).parquet(f"{batch}/records"), spark.read.schema(EVENTS).parquet(f"{batch}/events")

    def put(rows: DataFrame, kind: str) -> None:
        rows.write.mode("overwrite").parquet(f"{batch}/index/{kind}")

    def texts() -> None:
        named = evs.withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))
        size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))
        blocks = F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCKS), F.ceil(size / BLOCK_BYTES))).cast("long")
        ends = [f(of).alias(name) for of, least, greatest in (("harness", "least_harness", "greatest_harness"), ("session_id", "least_session", "greatest_session"), ("timestamp", "first_timestamp", "last_timestamp")) for f, name in ((F.min, least), (F.max, greatest))]
        put(named.groupBy("file").agg(blocks.alias("blocks"), *ends), "files")
        files = spark.read.schema(FILES).parquet(f"{batch}/index/files").select("file", "blocks")  # an inventory has at most 10,000 files
        said = named.where("text is not null").select("file", F.encode("text", "UTF-8").alias("text")).join(F.broadcast(files), "file").select("file", "blocks", "text")
        put(M.built(said.mapInArrow(_grams, "file string, blocks long, gram long"), F.col("gram"), F.col("blocks"), "file", "blocks"), "grams")

    # three jobs that don't need each other
    with ThreadPoolExecutor(3) as pool:
        jobs = [pool.submit(put, M.built(recs, F.col("id"), M.blocks_for(F.lit(records))), "ids"), pool.submit(texts), pool.submit(put, _partials(recs, evs), "sums")]
        for j in jobs:
            j.result()


def table(spark: SparkSession, root: str, names: list[str], kind: str, schema: str) -> DataFrame:
    """One of the index tables of several batches, with ``batch_id``."""
    if not names:
        return spark.createDataFrame([], f"{schema}, batch_id string")
    rows = spark.read.schema(schema).parquet(*(f"{root}/{n}/index/{kind}" for n in names))
    return rows.withColumn("batch_id", F.regexp_extract(F.col("_metadata.file_path"), f"([^/]+)/index/{kind}/[^/]+$", 1))


def wanted_grams(text: str, most: int = 32) -> list[int]:
    """Strings of four bytes that a text with ``text`` in it must have: all, or ``most`` of them spread evenly."""
    found = grams(text.encode("utf-8", "surrogatepass")).tolist()
    return found[:: -(-len(found) // most)] if found else []


def may_contain(rows: DataFrame, wanted: list[int]) -> DataFrame:
    """``batch_id, file`` of files whose filters have all the wanted strings."""
    words = [F.col(f"w{i}") for i in range(M.WORDS)]

    def hit(gram: int) -> Column:
        key = F.lit(gram).cast("long")
        return F.when((M.block_of(key, F.col("blocks")) == F.col("block")) & M.holds(words, M.bits_of(key)), 1).otherwise(0)

    hits = sum((hit(g) for g in wanted[1:]), hit(wanted[0]))
    return rows.groupBy("batch_id", "file").agg(F.sum(hits).alias("n")).where(F.col("n") == len(wanted)).select("batch_id", "file")

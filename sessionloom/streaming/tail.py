"""Growing transcripts as a stream: complete new lines, each once, into batches of an archive."""

from __future__ import annotations

import json
import os
import threading
import time
from collections.abc import Callable
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.files import Folder
from ..functions.workspace import ship
from ..operators.archive import write_batch
from ..operators.lookup import known_records
from ..operators.maintenance import COMPACT_BYTES, compact_all, purge_hook_spool
from ..sources import normalize
from ..sources.discover import Identities, candidates, head
from ..sources.hooks import raw_input
from ..sources.transcripts import PARSED, events_of, packed, records_of

LINE = "harness string, path string, position long, raw binary"
_HEAD = 4096


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _mark(path: str, upto: int) -> str:
    """A digest of what a file begins with, and of what stands before a place."""
    import hashlib

    with open(path, "rb") as f:
        digest = hashlib.sha256(f.read(min(upto, _HEAD)))
        f.seek(max(0, upto - _HEAD))
        digest.update(f.read(min(upto, _HEAD)))
    return digest.hexdigest()


def _upto(path: str, start: int, most_bytes: int, most_lines: int) -> tuple[int, int]:
    """(where the lines of one trigger end, how many they are): whole lines, at least one if there is one."""
    at, n = start, 0
    with open(path, "rb") as f:
        f.seek(start)
        while n < most_lines and at - start < most_bytes:
            line = f.readline()
            if not line.endswith(b"\n"):
                break
            at, n = at + len(line), n + 1
    return at, n


class TailReader(DataSourceStreamReader):
    """Offsets are a byte position and a mark for each file.

    A file that shrank, or whose beginning or last read bytes changed, is read
    again from its start; what was stored before is then dropped by its id.  A
    file without a header of the format isn't begun until it has one.  A trigger
    takes at most so many bytes and lines (``maxBytesPerTrigger``,
    ``maxRecordsPerTrigger``; the last line may pass the bytes).
    """

    def __init__(self, options):
        self.roots = options["path"].split(",")
        self.harness = options["harness"]
        self.most = int(options.get("maxbytespertrigger", 8 << 20))
        self.most_lines = int(options.get("maxrecordspertrigger", 1000))
        self.at: dict[str, list] = {}
        self.sources = Identities()

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        budget, lines, now = self.most, self.most_lines, dict(self.at)
        for path in candidates(self.roots):
            start, mark = now.get(path, [0, ""])
            size = os.path.getsize(path)
            if start and (size < start or _mark(path, start) != mark):
                start = 0
            if size > start and budget > 0 and lines > 0 and self.sources.identify(self.harness, path):
                end, n = _upto(path, start, budget, lines)
                if n:
                    budget, lines = budget - (end - start), lines - n
                    now[path] = [end, _mark(path, end)]
        self.at = now
        return {"files": json.dumps(now, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        self.at = new
        out = []
        for path, (upto, _) in sorted(new.items()):
            begin, mark = old.get(path, [0, ""])
            if begin > upto or (begin and begin < upto and _mark(path, begin) != mark):
                begin = 0
            if upto > begin:
                out.append(_Range(path, begin, upto))
        return out

    def read(self, partition: _Range):
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            content = f.read(partition.end - partition.start)
        for position, raw in normalize.lines(content):
            yield self.harness, partition.path, partition.start + position, raw


class TailSource(DataSource):
    """``spark.readStream.format("session_tail").option("harness", ..).load(root)``, on a file system that all hosts mount."""

    @classmethod
    def name(cls) -> str:
        return "session_tail"

    def schema(self) -> str:
        return LINE

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def _parse_lines(batches):
    heads: dict[str, dict | None] = {}
    for batch in batches:
        rows = []
        for harness, path, position, raw in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if path not in heads:
                heads[path] = normalize.identify(harness, path, head(path))
            if heads[path] is None:
                raise ValueError(f"{path} has lost the header it began with")
            if heads[path]["format"] == "hooks":
                raw = raw_input(path) or raw
            rows.append(normalize.parse(heads[path], position, raw) | {"source_path": path, "captured_at": ""})
        yield packed(rows)


def store(lines: DataFrame, archive: str, collector: str = "local") -> str | None:
    """Store lines that no active batch of their sessions has; gives the batch's id.

    Only batches whose manifests name a session of these lines, and whose filters
    may hold an id of theirs, are looked at.
    The batch's id comes from its records, so the same lines again give the same
    batch.  On a file system of this machine one writer stores at a time.
    """
    spark = lines.sparkSession
    ship(spark)
    parsed = lines.mapInArrow(_parse_lines, PARSED).withColumn("captured_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    parsed = parsed.persist()
    local = archive.startswith(("/", "file:"))
    try:
        with Folder(archive).locked("writer", wait=True) if local else nullcontext():
            records, events = records_of(parsed), events_of(parsed)
            records = records.join(known_records(spark, archive, records), "id", "left_anti")
            events = events.join(records.select(F.col("id").alias("record_id")), "record_id", "left_semi")
            return None if records.isEmpty() else write_batch(records, events, archive, collector)
    finally:
        parsed.unpersist()


def watch(spark: SparkSession, harness: str, root: str, archive: str, checkpoint: str, collector: str = "local", max_bytes: int = 8 << 20, max_records: int = 1000):
    """A stream writer that stores new lines in ``archive``; give it a trigger and start it.

    A batch's id comes from its records, so a batch that is tried again isn't
    stored twice; records that an active batch already has are left out.
    """
    ship(spark)
    spark.dataSource.register(TailSource)
    source = spark.readStream.format("session_tail").option("harness", harness).option("maxBytesPerTrigger", max_bytes).option("maxRecordsPerTrigger", max_records).load(root)
    return source.writeStream.foreachBatch(lambda lines, _: store(lines, archive, collector) and None).option("checkpointLocation", checkpoint)


def capture(spark: SparkSession, places: list[tuple[str, list[str]]], archive: str, state: str, collector: str = "local") -> None:
    """Store all that is there now, trigger by trigger, and tidy the hook spool."""
    for harness, roots in places:
        there = [r for r in roots if os.path.exists(r.removeprefix("file://"))]
        while there:
            before = progress(f"{state}/checkpoint-{harness}")
            query = watch(spark, harness, ",".join(there), archive, f"{state}/checkpoint-{harness}", collector).trigger(availableNow=True).start()
            query.awaitTermination()
            if progress(f"{state}/checkpoint-{harness}") == before:
                break
    spool = f"{state}/hooks"
    purge_hook_spool(spool, {path: at for path, (at, _) in progress(f"{state}/checkpoint-cursor").items()})


def progress(checkpoint: str) -> dict[str, list]:
    """What a stream has stored for good: position and mark of each file."""
    base = checkpoint.removeprefix("file://")
    done = [int(n) for n in os.listdir(f"{base}/commits") if n.isdigit()] if os.path.isdir(f"{base}/commits") else []
    if not done:
        return {}
    with open(f"{base}/offsets/{max(done)}") as f:
        return json.loads(json.loads(f.read().splitlines()[-1])["files"])


def watch_all(spark: SparkSession, places: list[tuple[str, list[str]]], archive: str, state: str, collector: str = "local", flush_seconds: int = 5, compact_seconds: int = 600, compact_bytes: int = COMPACT_BYTES, upload: Callable[[], None] | None = None, stop: Callable[[], bool] = lambda: False) -> None:
    """Keep storing until ``stop``: a stream for each harness, merges in between, and uploads beside them.

    Uploading runs on a thread of its own and never holds up what is stored.
    """
    queries = [watch(spark, h, ",".join(r), archive, f"{state}/checkpoint-{h}", collector).trigger(processingTime=f"{flush_seconds} seconds").start() for h, r in places]
    next_merge, busy = time.monotonic() + compact_seconds, None
    try:
        while not stop():
            for q in queries:
                if q.exception():
                    raise q.exception()
            if time.monotonic() >= next_merge:
                compact_all(spark, archive, collector, compact_bytes)
                next_merge = time.monotonic() + compact_seconds
            if upload and (busy is None or not busy.is_alive()):
                busy = threading.Thread(target=upload, daemon=True)
                busy.start()
            time.sleep(min(flush_seconds, 1.0))
    finally:
        for q in queries:
            q.stop()

"""Filters, collapsing, summaries, search, lookup and paging over events and records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.columns import parse_bound
from ..schemas import CHRONOLOGY

SESSION = ("harness", "session_id")


@dataclass(frozen=True)
class Query:
    """A conjunction; fields left out don't restrict.  Bounds are inclusive."""

    id: str | None = None
    harness: str | None = None
    session: str | None = None
    kind: str | None = None
    since: str | None = None
    until: str | None = None
    text: str | None = None

    def checked(self) -> Query:
        since, until = (parse_bound(x) if x else None for x in (self.since, self.until))
        if since and until and since > until:
            raise ValueError("since is after until")
        return Query(self.id, self.harness, self.session, self.kind, since, until, self.text)

    def restricts_events(self) -> bool:
        return any(x is not None for x in (self.id, self.kind, self.since, self.until, self.text))

    def on_events(self) -> Column:
        """Plain comparisons with literals, which reach the scan; nulls never match."""
        parts = [F.lit(True)]
        for column, value in (("id", self.id), ("harness", self.harness), ("session_id", self.session), ("kind", self.kind)):
            if value is not None:
                parts.append(F.col(column) == F.lit(value))
        if self.since is not None:
            parts.append(F.col("timestamp") >= F.lit(self.since))
        if self.until is not None:
            parts.append(F.col("timestamp") <= F.lit(self.until))
        if self.text is not None:
            parts.append(F.contains("text", F.lit(self.text)))
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out

    def on_records(self) -> Column:
        out = F.lit(True)
        for column, value in (("harness", self.harness), ("session_id", self.session)):
            if value is not None:
                out = out & (F.col(column) == F.lit(value))
        return out


def distinct_first(rows: DataFrame, order: str = "batch_ord") -> DataFrame:
    """The first row of each id in batch order."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank", order)


def collapse_hooks(events: DataFrame) -> DataFrame:
    """One event for each correlated tool event of a session, the transcript's before a hook's.

    Needs ``is_hook``.  Apply it above filters: a filter that leaves only a
    hook's copy shows that copy.
    """
    correlated = F.col("kind").isin("tool_call", "tool_result") & F.col("tool_call_id").isNotNull()
    first = Window.partitionBy(*SESSION, "kind", "tool_call_id", F.when(~correlated, F.col("id"))).orderBy("is_hook", *CHRONOLOGY)
    ranked = events.withColumn("_n", F.when(correlated, F.row_number().over(first)).otherwise(1))
    return ranked.where("_n = 1").drop("_n")


def select_events(events: DataFrame, q: Query) -> DataFrame:
    """Filtered, then collapsed."""
    return collapse_hooks(events.where(q.checked().on_events()))


ORDER = (*SESSION, *CHRONOLOGY)


def ordered_page(events: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page in the fixed order, with each row's place in the whole.

    Only offset + limit rows are ordered on the driver side of the plan: Spark
    takes the first of each partition and merges.
    """
    if not 1 <= limit <= 100:
        raise ValueError("a page has 1 to 100 rows")
    top = events.orderBy(*ORDER).limit(offset + limit)
    # at most offset + limit rows are numbered
    return top.withColumn("place", F.row_number().over(Window.orderBy(*ORDER))).where(F.col("place") > offset)


def keyset_page(sessions: DataFrame, after: str, limit: int = 100) -> DataFrame:
    """The keys after ``after``, one more than a page to tell whether there is a next one."""
    return sessions.where(F.col("key") > F.lit(after)).orderBy("key").limit(limit + 1)


def summaries(records: DataFrame, events: DataFrame, q: Query) -> DataFrame:
    """Per session: records (never filtered by what restricts events), events after collapse, first and last time."""
    q = q.checked()
    recs = records.where(q.on_records()).groupBy(*SESSION).agg(F.countDistinct("id").alias("records"))
    evs = select_events(events, q).groupBy(*SESSION).agg(F.count("*").alias("events"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"))
    how = "inner" if q.restricts_events() else "left"
    return recs.join(evs, list(SESSION), how).select(*SESSION, "records", F.coalesce("events", F.lit(0)).alias("events"), "first_timestamp", "last_timestamp")


def read_records(records: DataFrame, q: Query) -> DataFrame:
    """Records of the chosen sessions, whole."""
    return records.where(q.on_records())


def record_keys(records: DataFrame, q: Query) -> DataFrame:
    """Which records there are, without what they hold: only three columns are read."""
    return records.where(q.on_records()).select("id", *SESSION)


def each(rows: DataFrame, emit: Callable[[Row], None]) -> int:
    """Hand the rows over one by one in their order; at most one partition of them is on the driver."""
    n = 0
    for row in rows.toLocalIterator():
        emit(row)
        n += 1
    return n


def search_sessions(events: DataFrame, needle: str = "") -> DataFrame:
    """Sessions with any match of text, harness or id, whatever the case; all of their events are counted."""
    low = F.lit(needle.lower())
    hit = F.coalesce(F.contains(F.lower("text"), low), F.lit(False)) | F.contains(F.lower("harness"), low) | F.contains(F.lower("session_id"), low)
    said = (F.col("kind") == "message") & (F.col("text") != "")
    preview = F.min_by(F.when(said, F.substring("text", 1, 100)), F.when(said, F.struct(*CHRONOLOGY)))
    found = events.groupBy(*SESSION).agg(F.count("*").alias("events"), preview.alias("preview"), F.bool_or(hit).alias("hit"))
    return found.where("hit" if needle else "true").drop("hit")


def ambiguous_sessions(events: DataFrame) -> DataFrame:
    """Session ids that more than one harness has."""
    return events.groupBy("session_id").agg(F.countDistinct("harness").alias("harnesses")).where("harnesses > 1")


def find_event(events: DataFrame, event_id: str, order: str = "batch_ord") -> DataFrame:
    """The first event of that id in batch order, without dedupe or collapse."""
    return events.where(F.col("id") == F.lit(event_id)).orderBy(order).limit(1)


def export(records: DataFrame, events: DataFrame, q: Query) -> tuple[DataFrame, DataFrame]:
    """Selected events and their records; if nothing restricts events, all records of the sessions."""
    q = q.checked()
    chosen, recs = select_events(events, q), records.where(q.on_records())
    if q.restricts_events():
        recs = recs.join(chosen.select(F.col("record_id").alias("id")), "id", "left_semi")
    return recs, chosen


def byte_budget(rows: DataFrame, size: Column, budget: int, *order: str, partition: tuple[str, ...] = (), crossing: bool = True) -> DataFrame:
    """The rows up to a sum of bytes in order; the row that crosses it is kept or not."""
    own = Window.partitionBy(*partition).orderBy(*order)
    before = F.coalesce(F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("bytes_before", before).withColumn("_upto", upto).where(F.col("bytes_before") < budget if crossing else F.col("_upto") <= budget).drop("_upto")


def bounded_item(rows: DataFrame, limit: int = 262144, preview: int = 4096, keep: tuple[str, ...] = ()) -> DataFrame:
    """``item``: each row as JSON, or a stub with a preview where that is too large, beside the columns to ``keep``."""
    whole = F.to_json(F.struct(*rows.columns))
    stub = F.to_json(F.struct(F.lit(True).alias("truncated"), F.octet_length(whole).alias("bytes"), F.substring(whole, 1, preview).alias("preview")))
    return rows.select(*keep, F.when(F.octet_length(whole) > limit, stub).otherwise(whole).alias("item"))

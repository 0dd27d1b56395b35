"""Reading an archive by what its batches say about themselves: only those that may hold an id, a text or a sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import membership as M
from ..functions.filesystem import hadoop
from ..schemas import EVENTS
from ..sources.transcripts import with_hook_flag
from . import archive as A
from . import batchindex as I
from .catalog import active_manifests
from .query import SESSION, Query, distinct_first, select_events, summaries

_OWN = list(SESSION)


def indexed(spark: SparkSession, root: str) -> set[str]:
    """Batches that have all tables of an index, by one listing each."""

    def having(kind: str) -> set[str]:
        p, fs = hadoop(spark, f"{root}/*/index/{kind}/_SUCCESS")
        return {s.getPath().getParent().getParent().getParent().getName() for s in fs.globStatus(p) or []}

    return set.intersection(*(having(k) for k in ("ids", "files", "grams", "sums")))


def _active(spark: SparkSession, root: str) -> DataFrame:
    """Active batches with ``ord``, their place in order of creation, and ``n``, their records."""
    from pyspark.sql import Window

    n = F.aggregate("sessions", F.lit(0).cast("long"), lambda total, s: total + s["records"])
    place = F.row_number().over(Window.orderBy("created_at", "batch_id"))  # a row for a batch
    return active_manifests(A.manifests(spark, root)).withColumn("n", n).withColumn("ord", place)


def _holders(spark: SparkSession, root: str, ids: DataFrame, batches: DataFrame, have: set[str]) -> DataFrame:
    """``ids`` (``id`` of a record, its session and more) with each batch that names its session and may hold it: ``batch_id, ord``."""
    own = batches.select("batch_id", "ord", "n", F.explode("sessions").alias("s")).select("batch_id", "ord", "n", "s.harness", "s.session_id")
    own = own.withColumn("has_index", F.col("batch_id").isin(sorted(have)) if have else F.lit(False))
    pairs = ids.join(own, _OWN).withColumn("block", M.block_of(F.col("id"), M.blocks_for(F.col("n"))))
    names = sorted(r["batch_id"] for r in pairs.where("has_index").select("batch_id").distinct().collect()) if have else []  # a catalog, not data
    met = pairs.join(I.table(spark, root, names, "ids", I.IDS), ["batch_id", "block"], "left")
    hit = M.holds([F.col(f"w{i}") for i in range(M.WORDS)], M.bits_of(F.col("id")))
    return met.where(~F.col("has_index") | F.coalesce(hit, F.lit(False))).select(*ids.columns, "batch_id", "ord")


def known_records(spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
    """Which of some records (``id, harness, session_id``) an active batch has: ``id``.

    Batches that don't name the session are left out by their manifests, others
    by their filters of ids; only those that may hold one are opened.
    """
    if not A.any_batch(spark, root):
        return ids.select("id").limit(0)
    holders = _holders(spark, root, ids.select("id", *SESSION), _active(spark, root), indexed(spark, root))
    names = sorted(r["batch_id"] for r in holders.select("batch_id").distinct().collect())  # a catalog, not data
    return A.stored(spark, root, names, "records").select("id").join(ids.select("id"), "id", "left_semi").distinct()


def files_for(spark: SparkSession, root: str, q: Query) -> list[tuple[str, str]]:
    """(batch, file) of the active batches' files of events that may hold what ``q`` asks for, by manifests and indexes."""
    q = q.checked()
    batches = _active(spark, root)
    named = F.exists("sessions", lambda s: (F.lit(True) if q.harness is None else s["harness"] == q.harness) & (F.lit(True) if q.session is None else s["session_id"] == q.session))
    chosen = batches.where(named)
    all_files = chosen.select("batch_id", F.explode("files.path").alias("path")).where("path like 'events/%'").select("batch_id", F.substring("path", len("events/") + 1, 1 << 20).alias("file"))
    have = indexed(spark, root)
    names = sorted(r["batch_id"] for r in chosen.select("batch_id").collect() if r["batch_id"] in have)
    inside = F.lit(True)
    for value, least, greatest in ((q.harness, "least_harness", "greatest_harness"), (q.session, "least_session", "greatest_session")):
        if value is not None:
            inside = inside & F.lit(value).between(F.col(least), F.col(greatest))
    if q.since is not None:
        inside = inside & (F.col("last_timestamp") >= q.since)
    if q.until is not None:
        inside = inside & (F.col("first_timestamp") <= q.until)
    kept = I.table(spark, root, names, "files", I.FILES).where(inside).select("batch_id", "file")
    wanted = I.wanted_grams(q.text) if q.text else []
    if wanted:
        kept = kept.join(I.may_contain(I.table(spark, root, names, "grams", I.GRAMS), wanted), ["batch_id", "file"], "left_semi")
    unknown = all_files.where(~F.col("batch_id").isin(names)) if names else all_files
    found = all_files.join(kept, ["batch_id", "file"], "left_semi").unionByName(unknown)
    return sorted((r["batch_id"], r["file"]) for r in found.collect())  # an inventory, not data


def find(spark: SparkSession, root: str, q: Query) -> DataFrame:
    """The events that ``q`` selects, as from a scan of the whole archive, from the files that may hold them.

    An id that several batches have is the first batch's, whatever the later ones
    say.  So a match is held against earlier batches whose filter may have its
    record; these, if there are any, are read for those ids alone.
    """
    q = q.checked()
    if not A.any_batch(spark, root) or not (files := files_for(spark, root, q)):
        return spark.createDataFrame([], EVENTS)
    batches = _active(spark, root)
    order = batches.select("batch_id", "ord")
    rows = spark.read.schema(EVENTS).parquet(*(f"{root}/{b}/events/{f}" for b, f in files))
    met = rows.where(q.on_events()).withColumn("batch_id", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/events/[^/]+$", 1)).join(F.broadcast(order), "batch_id")
    if len({b for b, _ in files}) == 1 and batches.limit(2).count() == 1:
        return distinct_first(met.withColumnRenamed("ord", "batch_ord").drop("batch_id")).where(q.on_events())
    asked = met.select(F.col("record_id").alias("id"), *SESSION, F.col("ord").alias("own")).distinct()
    earlier = _holders(spark, root, asked, batches, indexed(spark, root)).where("ord < own")
    names = sorted(r["batch_id"] for r in earlier.select("batch_id").distinct().collect())  # a catalog, not data
    first = met.withColumn("batch_ord", F.col("ord")).drop("batch_id", "ord")
    if names:
        others = A.stored(spark, root, names, "events").join(met.select("id").distinct(), "id", "left_semi").join(F.broadcast(order), "batch_id").withColumnRenamed("ord", "batch_ord").drop("batch_id")
        first = first.unionByName(others)
    return distinct_first(first).where(q.on_events())


def archive_summaries(spark: SparkSession, root: str, q: Query = Query()) -> DataFrame:
    """:func:`~sessionloom.operators.query.summaries` of an archive, from its batches' sums where these add up.

    They do for a session that one active batch has, and for one of several if its
    sources' ranges of positions are apart (an id is a digest of source, place and
    content, so no record is there twice) and no two of them hold tool events,
    whose copies would be put together.  Other sessions are scanned, in the batches
    that name them; so is everything if ``q`` restricts events.
    """
    from pyspark.sql import Window

    q = q.checked()
    if not A.any_batch(spark, root) or q.restricts_events():
        records, events = A.open_archive(spark, root, q.harness, q.session)
        return summaries(records, with_hook_flag(events), q)
    have = indexed(spark, root)
    batches = active_manifests(A.manifests(spark, root))
    named = batches.select("batch_id", F.explode("sessions").alias("s")).select("batch_id", "s.harness", "s.session_id").where(q.on_records())
    names = sorted(r["batch_id"] for r in batches.select("batch_id").collect() if r["batch_id"] in have)  # a catalog, not data
    sums = I.table(spark, root, names, "sums", I.SUMS).where(q.on_records())
    bare = named.where(~F.col("batch_id").isin(names) if names else F.lit(True)).select(*SESSION).distinct().withColumn("bare", F.lit(True))
    place = Window.partitionBy(*SESSION, "source_id").orderBy("first_position", "batch_id")
    apart = F.coalesce(F.max("last_position").over(place.rowsBetween(Window.unboundedPreceding, -1)) < F.col("first_position"), F.lit(True))
    total = sums.withColumn("apart", apart & (F.col("records") == F.col("distinct_records"))).groupBy(*SESSION).agg(
        F.sum("records").alias("records"), F.sum("events").alias("events"), F.min("first_timestamp").alias("first_timestamp"), F.max("last_timestamp").alias("last_timestamp"),
        F.bool_and("apart").alias("apart"), F.count_if(F.col("correlated") > 0).alias("tools"),
    )
    judged = total.join(bare, _OWN, "full_outer").withColumn("adds_up", F.col("bare").isNull() & F.col("apart") & (F.col("tools") <= 1))
    plain = judged.where("adds_up").select(*SESSION, "records", "events", "first_timestamp", "last_timestamp")
    rest = judged.where("not coalesce(adds_up, false)").select(*SESSION)
    needed = sorted(r["batch_id"] for r in named.join(rest, _OWN, "left_semi").select("batch_id").distinct().collect())  # a catalog, not data
    if not needed:
        return plain
    order = {r["batch_id"]: k for k, r in enumerate(batches.select("batch_id", "created_at").orderBy("created_at", "batch_id").collect())}
    records, events = A._tables(spark, root, sorted(needed, key=order.get))
    scanned = summaries(records.join(rest, _OWN, "left_semi"), with_hook_flag(events.join(rest, _OWN, "left_semi")), q)
    return plain.unionByName(scanned)

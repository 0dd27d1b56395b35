"""A stored index for BM25: postings in blocks, each with the most it can add to a score.

The index of a corpus is written once and read by any number of queries.  A block
has a term's postings in one group of documents; beside the blocks lies a small
table of what each holds at most, so a reader bounds scores, and leaves blocks
out, without opening them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.workspace import staged
from .matching import B, K1, TERM, bm25_corpus, tokens

#: Documents in a group, on average; so many postings a block has at most, or nearly.
GROUP = 512
#: A term is rare if no more than one document in so many has it.
RARE = 20


@dataclass(frozen=True)
class TextIndex:
    """``blocks``: ``term, grp, entries`` (doc, tf, size); ``bounds``: ``term, grp, n, most``; the number of documents and their mean size."""

    blocks: DataFrame
    bounds: DataFrame
    docs: int
    avg: float


@dataclass(frozen=True)
class Found:
    """``top``: ``query, doc, score, rank``; ``wanted``: blocks (``query, term, grp``) of the queries' terms; ``opened``: those that bring in documents or add to them."""

    top: DataFrame
    wanted: DataFrame
    opened: DataFrame


def _saturation(tf: Column, size: Column, avg: float) -> Column:
    """What a posting adds to a score, but for its term's idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.lit(avg)))


def build(corpus: DataFrame, folder: str, group: int = GROUP) -> TextIndex:
    """Write the index of ``doc, text`` below ``folder``; the texts are read once, and shuffled once as words.

    Groups go by a hash of the document, so that a term in every document is
    spread over all groups.  A document without a term, or with a null text,
    counts among the documents; a document is one row.
    """
    spark = corpus.sparkSession
    docs = corpus.count()
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0))
    grp = F.pmod(F.xxhash64("doc"), F.lit(max(1, -(-docs // group)))).cast("int").alias("grp")
    own = corpus.select("doc", words.alias("w")).select("doc", grp, F.size("w").alias("size"), F.explode("w").alias("term"))
    # one shuffle serves both aggregates
    counted = own.repartition("term", "grp").groupBy("term", "grp", "doc", "size").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    blocks = counted.groupBy("term", "grp").agg(F.collect_list(F.struct("doc", "tf", "size")).alias("entries"))
    blocks.sortWithinPartitions("term", "grp").write.option("compression", "zstd").parquet(f"{folder}/blocks")
    written = spark.read.parquet(f"{folder}/blocks")
    total = written.agg(F.sum(F.aggregate("entries", F.lit(0).cast("long"), lambda n, e: n + e["tf"]))).first()[0]
    avg = (total or 0) / docs if total else 1.0
    most = F.array_max(F.transform("entries", lambda e: _saturation(e["tf"], e["size"], avg)))
    written.select("term", "grp", F.size("entries").cast("long").alias("n"), most.alias("most")).write.parquet(f"{folder}/bounds")
    spark.createDataFrame([(docs, avg)], "docs long, avg double").write.parquet(f"{folder}/stats")
    return load(spark, folder)


def load(spark: SparkSession, folder: str) -> TextIndex:
    """An index as :func:`build` wrote it."""
    docs, avg = spark.read.parquet(f"{folder}/stats").first()
    return TextIndex(spark.read.parquet(f"{folder}/blocks"), spark.read.parquet(f"{folder}/bounds"), docs, avg)


def _parts(index: TextIndex, wanted: DataFrame) -> DataFrame:
    """``query, grp, doc, part`` of all postings of the wanted blocks (``query, term, grp, idf``)."""
    met = wanted.join(index.blocks, ["term", "grp"]).select("query", "grp", "idf", F.explode("entries").alias("e"))
    return met.select("query", "grp", F.col("e.doc").alias("doc"), (F.col("idf") * _saturation(F.col("e.tf"), F.col("e.size"), index.avg)).alias("part"))


def _parts_of(index: TextIndex, wanted: DataFrame) -> DataFrame:
    """``query, doc, part`` of the wanted postings (``query, doc, term, grp, idf``): a block gives those of its documents alone."""
    own = F.filter("entries", lambda e: e["doc"] == F.col("doc"))
    met = wanted.join(index.blocks, ["term", "grp"]).select("query", "doc", "idf", F.get(own, 0).alias("e")).where("e is not null")
    return met.select("query", "doc", (F.col("idf") * _saturation(F.col("e.tf"), F.col("e.size"), index.avg)).alias("part"))


def search(index: TextIndex, queries: DataFrame, k: int, digits: int = 6) -> Found:
    """The ``k`` best documents of each query (``query, text``), exactly.

    Scores count rounded, ties go to the smaller document; a query's term counts
    once.  The ``k`` documents for which its rare terms add up to most are scored
    in full, and the least of these scores is a bound (none where there are fewer).
    A query's commonest terms that together can't reach the bound bring in no
    document: what they add is looked up for documents that others bring in.  A
    group is left out whose blocks together can't reach the bound, and a document
    whose score and its group's blocks of the common terms can't; of a common
    term only the blocks are opened in whose group a document is left.
    """
    q = tokens(queries, "query").select("query", "term")
    bounds = staged(index.bounds.join(q.select("term").distinct(), "term", "left_semi"), "bounds")
    terms = bounds.groupBy("term").agg(F.sum("n").alias("df"), F.max("most").alias("most"))
    idf = F.log1p((F.lit(float(index.docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    own = q.join(terms.withColumn("idf", idf), "term").select("query", "term", "df", "idf", (F.col("idf") * F.col("most")).alias("most"))
    own = staged(own.withColumn("rare", F.col("df") * RARE <= index.docs), "terms")
    held = bounds.select("term", "grp", F.col("most").alias("held"))
    wanted = own.join(held, "term").select("query", "term", "grp", "idf", "rare", (F.col("idf") * F.col("held")).alias("held"))
    known = _parts(index, wanted.where("rare").select("query", "term", "grp", "idf")).groupBy("query", "grp", "doc").agg(F.sum("part").alias("part"))
    known = staged(known, "rare")
    best = Window.partitionBy("query").orderBy(F.desc("part"), "doc")
    first = known.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).select("query", "grp", "doc")
    whole = _parts_of(index, first.join(own.select("query", "term", "idf"), "query")).groupBy("query", "doc").agg(F.sum("part").alias("score"))
    bound = whole.groupBy("query").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
    bound = bound.select("query", (F.col("low") - 2 * 10.0**-digits).alias("bound"))
    upto = Window.partitionBy("query").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
    marked = own.join(bound, "query", "left").withColumn("common", F.coalesce(F.sum("most").over(upto) < F.col("bound"), F.lit(False)))
    marked = staged(marked.select("query", "term", "common", "bound"), "terms")
    every = wanted.join(marked, ["query", "term"])
    late = F.col("common") & ~F.col("rare")
    # what the blocks of a group allow: all together, and those of common terms alone
    reach = every.groupBy("query", "grp").agg(F.first("bound").alias("bound"), F.sum("held").alias("upto"), F.sum(F.when(late, F.col("held")).otherwise(0.0)).alias("left"))
    reach = staged(reach.where("bound is null or upto >= bound").select("query", "grp", "bound", "left"), "groups")
    between = every.where("not common and not rare").select("query", "term", "grp", "idf").join(reach.select("query", "grp"), ["query", "grp"], "left_semi")
    met = known.union(_parts(index, between)).groupBy("query", "grp", "doc").agg(F.sum("part").alias("score"))
    candidates = met.join(reach, ["query", "grp"]).where("bound is null or score + left >= bound").select("query", "grp", "doc", "score")
    candidates = staged(candidates, "candidates")
    later = every.where(late).select("query", "term", "grp", "idf").join(candidates.select("query", "grp").distinct(), ["query", "grp"], "left_semi")
    more = _parts(index, later).groupBy("query", "doc").agg(F.sum("part").alias("more"))
    scored = candidates.join(more, ["query", "doc"], "left").select("query", "doc", F.round(F.col("score") + F.coalesce("more", F.lit(0.0)), digits).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
    key = ["query", "term", "grp"]
    opened = wanted.where("rare").select(*key).union(between.select(*key)).union(later.select(*key))
    return Found(scored.withColumn("rank", rank).where(F.col("rank") <= k), wanted.select(*key), opened)


def bm25_top(corpus: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """``query, doc, score, rank`` as :func:`search` gives them, of a corpus that is asked this once: without an index, which costs more than one answer."""
    scored = bm25_corpus(corpus, queries).withColumn("score", F.round("score", digits))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
    # a task keeps its best k for each query before anything is shuffled
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "doc", "score", "rank")

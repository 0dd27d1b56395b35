"""What five filters do together and in every order: a subset-zeta transform of failure masks.

A document fails some of the filters, which is a mask of five bits.  Counts of
masks for each part (a language) are all that is needed: the transform sums them
over the subsets of every set, so it gives the survivors of every set of filters
at once, and what a filter removes at its step of an order is the difference of
two neighbouring sets.  Good and toxic documents go the same way.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, prepare, staged

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
SPACE = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> Column:
    """The mask of what a text fails by itself (A to D, a bit each from the lowest).

    A: under 200 words; B: under half of the words are different; C: over 3 % of
    the code points are capitals A-Z; D: a character of a stated set occurs.
    """
    words = F.array_remove(F.split(text, SPACE), "")
    conditions = (
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.char_length(text),
        text.rlike(r"[#$%&*|]"),
    )
    mask = F.lit(0)
    for bit, failed in enumerate(conditions):
        mask = mask + F.when(failed, 1 << bit).otherwise(0)
    return mask


def zeta(sums: DataFrame, *arrays: str) -> DataFrame:
    """Turn arrays of counts by mask into sums over the masks within each set: a pass for each bit."""
    for bit in range(len(FILTERS)):
        here = 1 << bit

        def pass_over(name: str) -> Column:
            def add(n: Column, i: Column) -> Column:
                return n + F.when(i.bitwiseAND(F.lit(here)) != 0, F.get(F.col(name), i - here)).otherwise(F.lit(0))

            return F.transform(name, add)

        sums = sums.withColumns({x: pass_over(x) for x in arrays})
    return sums


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, mask, n, good, toxic``: how many documents of a part have a mask of failures, at most 32 rows a part.

    Bit E: another row with a smaller id has the same text (a null text is an
    empty one); a row with a null id is neither.  Texts are told apart by their
    SHA-256, of which the least id is taken before anything is shuffled, and the
    first rows are found again by digest and id together, so that many copies of
    a text don't meet in one task.  A document is good or toxic if a label row
    of its id says so.
    """
    text = F.coalesce("text", F.lit(""))
    rows = pick(docs, doc_id=id_col, text=text_col, part=part_col)
    own = rows.select("doc_id", F.coalesce("part", F.lit("")).cast("string").alias("part"), failures(text).alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    own = staged(own, "masks")
    first = own.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = pick(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id is not null").groupBy("doc_id")
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    joined = own.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    masked = joined.select("part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"), "good", "toxic")
    return masked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def _filled(name: str):
    return lambda i: F.coalesce(F.try_element_at("m", i)[name], F.lit(0).cast("long"))


def survivors(counts: DataFrame) -> DataFrame:
    """For each part, arrays by set of filters (its mask): how many documents none of them removes, and of these the good and toxic; and ``n``, the counts by mask."""
    entries = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))  # 32 at most
    by_part = counts.groupBy("part").agg(entries.alias("m"))
    masks = F.sequence(F.lit(0), F.lit(SETS - 1))
    arrays = {x: F.transform(masks, _filled(x)) for x in ("n", "good", "toxic")}
    within = zeta(by_part.select("part", *(c.alias(x) for x, c in arrays.items()), arrays["n"].alias("exact")), "n", "good", "toxic")
    # who fails nothing of a set fails only what is in its complement
    return within.select("part", F.col("exact").alias("n"), *(F.reverse(x).alias(f"left_{x}") for x in ("n", "good", "toxic")))


def _orders(spark) -> DataFrame:
    """Every step of every order: the filter's bit and the set of those before it (600 rows)."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            rows.append(("".join(order), step, bit, before))
            before |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, bit int, before int")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step.

    ``part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley``: documents kept after the step, removed at
    it, failing its filter but gone before, failing its filter alone; good and
    toxic ones among the removed; and what the filter removes, summed over all
    orders.

    Null texts are empty, a null part is the empty string; rows with a null id
    count, but are nobody's copies; repeated rows count each, and rows with the
    same id aren't copies of one another; no documents give no rows; labels of
    other documents, null ids among them, don't count.
    """
    spark = docs.sparkSession
    prepare(spark)
    steps = survivors(mask_counts(docs, labels, id_col, text_col, part_col)).crossJoin(F.broadcast(_orders(spark)))

    def at(array: str, place: Column) -> Column:
        return F.element_at(array, place.cast("int") + 1)

    after = F.col("before") + F.col("bit")

    def lost(array: str) -> Column:
        return at(array, F.col("before")) - at(array, after)

    failing = at("left_n", F.lit(0)) - at("left_n", F.col("bit"))
    out = steps.select(
        "part", "filter_order", "step", "bit", at("left_n", after).alias("kept"), lost("left_n").alias("removed"), (failing - lost("left_n")).alias("redundant"),
        at("n", F.col("bit")).alias("unique_fails"), lost("left_good").alias("good_lost"), lost("left_toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    return audit(docs, labels)


SQL = r"""
with t as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), marks as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id
), f as (
  select t.doc_id, part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    map {
      'A': len(w) < 200,
      'B': 100 * len(list_distinct(w)) < 50 * len(w),
      'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
      'D': regexp_matches(text, '[#$%&*|]'),
      'E': coalesce(t.doc_id > min(t.doc_id) over (partition by text), false)
    } as fails
  from t left join marks on marks.doc_id = t.doc_id
), letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x
), orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), masks as (
  select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all
), steps as (select filter_order, step, filter_order[step:step] as x, string_split(filter_order[1:step - 1], '') as before from orders, (select unnest(range(1, 6)) as step)
), hit as (
  select part, filter_order, step, x, n, good, toxic, fails[x] as failing,
    len(list_filter(before, lambda y: y <> '' and fails[y])) > 0 as gone,
    len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: fails[y])) as many
  from masks, steps
), sums as (
  select part, filter_order, step, x,
    sum(case when not gone and not failing then n else 0 end) as kept,
    sum(case when not gone and failing then n else 0 end) as removed,
    sum(case when gone and failing then n else 0 end) as redundant,
    sum(case when failing and many = 1 then n else 0 end) as unique_fails,
    sum(case when not gone and failing then good else 0 end) as good_lost,
    sum(case when not gone and failing then toxic else 0 end) as toxic_lost
  from hit group by all
)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, x))::bigint as shapley
from sums
"""

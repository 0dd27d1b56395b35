"""What must hold when a corpus, a run or a session is large."""

import os
import random
import shutil
import subprocess
import sys
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionloom.functions import payloads, variants
from sessionloom.functions.workspace import fresh_dir
from sessionloom.operators import catalog, matching, outcomes, textindex, trajectory

# --- alignment ---------------------------------------------------------------


def plain_align(scores, threshold):
    """The recurrence over a full table, and its ties."""
    n, m = len(scores), len(scores[0])
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            match = best[i][j] + scores[i][j] if scores[i][j] > threshold else 0.0
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], match)
    out, i, j = [-1] * n, n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out[i] = j
    return out


def rows_of(scores):
    """Scores above 0 alone, as the aligner takes them."""
    return [(np.nonzero(np.array(r))[0], np.array([x for x in r if x])) for r in scores]


def test_alignment_breaks_ties_as_the_full_table_does():
    rnd = random.Random(5)
    for _ in range(300):
        n, m = rnd.randint(1, 20), rnd.randint(1, 20)
        scores = [[rnd.choice([0.0, 0.0, 0.25, 0.5, 1.0, 1.0]) for _ in range(m)] for _ in range(n)]
        assert matching.align(rows_of(scores), m, 0.1).tolist() == plain_align(scores, 0.1)


def test_alignment_of_the_longest_runs_is_quick_and_small():
    rnd = np.random.default_rng(3)
    own = [(np.arange(2000), rnd.random(2000)) for _ in range(2000)]
    held = sum(a.nbytes + b.nbytes for a, b in own)
    tracemalloc.start()
    began = time.time()
    found = matching.align(own, 2000, 0.5)
    assert time.time() - began < 2
    assert tracemalloc.get_traced_memory()[1] < 10 << 20 < held
    tracemalloc.stop()
    hit = found[found >= 0]
    assert len(hit) > 1000 and (np.diff(hit) > 0).all()


# --- text index ----------------------------------------------------------------


def corpus_of(seed, n=400):
    """Texts on several subjects, each with words of its own, and words that all share."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"s{i % 8}w{rnd.randint(0, 25)}" for _ in range(rnd.randint(0, 12))] + [rnd.choice(["the", "and", "of"]) for _ in range(rnd.randint(0, 30))]
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
    rows += [(9000, None), (9001, ""), (9002, "...")]
    asks = [(k, " ".join([f"s{k % 8}w{rnd.randint(0, 25)}" for _ in range(3)] + ["the", "of"])) for k in range(20)] + [(100, "nowhere"), (101, ""), (102, None), (103, "the and of the"), (104, "THE s1w1")]
    return rows, asks


@pytest.mark.parametrize("group", [4, 64])
def test_an_index_gives_the_best_documents_and_leaves_blocks_closed(spark, group):
    rows, asks = corpus_of(1)
    corpus, queries = spark.createDataFrame(rows, "doc long, text string"), spark.createDataFrame(asks, "query long, text string")
    whole = {}
    for r in matching.bm25(corpus.withColumn("text", F.coalesce("text", F.lit(""))), queries).collect():
        whole.setdefault(r.query, []).append((-round(r.score, 6), r.doc))
    index = textindex.build(corpus, fresh_dir(spark, "index"), group)
    found = textindex.search(index, queries, 5)
    got = {}
    for r in found.top.orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((-r.score, r.doc))
    assert got == {k: sorted(v)[:5] for k, v in whole.items()}
    wanted, opened = found.wanted.distinct().count(), found.opened.distinct().count()
    assert found.opened.exceptAll(found.wanted).isEmpty()
    if group == 4:
        assert opened < 0.7 * wanted


def test_an_index_outlives_its_texts(spark, tmp_path):
    rows, asks = corpus_of(2, 60)
    path = str(tmp_path / "texts")
    spark.createDataFrame(rows, "doc long, text string").write.parquet(path)
    folder = fresh_dir(spark, "index")
    textindex.build(spark.read.parquet(path), folder)
    shutil.rmtree(path)
    index = textindex.load(spark, folder)
    first = textindex.search(index, spark.createDataFrame(asks, "query long, text string"), 3).top.collect()
    assert first and sorted(first) == sorted(textindex.search(textindex.load(spark, folder), spark.createDataFrame(asks, "query long, text string"), 3).top.collect())
    nothing = textindex.build(spark.createDataFrame([], "doc long, text string"), fresh_dir(spark, "index"))
    assert textindex.search(nothing, spark.createDataFrame(asks, "query long, text string"), 3).top.count() == 0


# --- sessions larger than a task ------------------------------------------------

EVENT = "harness string, session_id string, source_id string, timestamp string, position long, sub_index long, id string, kind string, role string, tool_call_id string"


def session_events(seed, n, huge=True):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        session = "huge" if huge and i % 20 else f"s{i % 7}"
        source = "b" if session == "s3" and i % 2 else "a"
        kind = rnd.choice(["tool_call", "tool_result", "tool_result", "message", "metadata"])
        call = rnd.choice(["c1", "c2", f"k{i // 3}", None]) if kind.startswith("tool") else None
        rows.append(("pi", session, source, f"2024-01-01T00:{rnd.randint(0, 59):02}:00Z", rnd.randint(0, n), i % 3, f"e{i:06}", kind, rnd.choice(["assistant", "user"]), call))
    return rows


@pytest.mark.parametrize("n,huge", [(60, False), (4000, True)])
def test_steps_of_a_session_that_holds_nearly_everything(spark, n, huge):
    events = spark.createDataFrame(session_events(n, n, huge), EVENT)
    ordered = trajectory.spread_chronology(events)
    if huge:
        sizes = sorted(r["count"] for r in ordered.groupBy("_chunk").count().collect())
        assert len(sizes) > 1 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        assert ordered.where("session_id = 'huge'").select("_chunk").distinct().count() > 1
    plain = trajectory.chronology(events)
    assert {(r.id, r["at"]) for r in ordered.collect()} == {(r.id, r["at"]) for r in plain.collect()}
    own = lambda df: sorted((r.id, r.step, r.is_head, r.call_at or 0) for r in df.collect())
    assert own(trajectory.spread_steps(ordered)) == own(trajectory.steps(plain))


# --- ways to the root --------------------------------------------------------------


def forest(seed, n=400):
    rnd = random.Random(seed)
    rows = [("s", f"n{i}", None if i == 0 else f"n{rnd.randint(max(0, i - 3), i - 1)}") for i in range(n)]
    return rows + [("t", f"n{i}", f"n{i - 1}" if i else None) for i in range(70)] + [("u", "x", None)]


def ways(df):
    return sorted((r.session_id, r.leaf, r.id, r.hops) for r in df.collect())


def test_doubling_gives_the_ways_that_walking_gives(spark):
    entries = spark.createDataFrame(forest(1), "session_id string, id string, parent_id string")
    leaves = trajectory.leaves_of(entries)
    walked = ways(trajectory.ancestry(entries, leaves))
    assert max(r[3] for r in walked) > 64
    assert ways(trajectory.ancestry(entries, leaves, bound=100)) == walked == ways(trajectory.ancestry(entries, leaves, bound=0))


@pytest.mark.parametrize("rows,leaf,words", [([("s", "a", "b"), ("s", "b", "c"), ("s", "c", "a")], "a", "loop"), ([("s", "a", "a")], "a", "loop"), ([("s", "a", "b"), ("s", "b", "z")], "a", "'z'"), ([("s", "a", None)], "q", "'q'")])
def test_doubling_reports_loops_and_gaps(spark, rows, leaf, words):
    entries = spark.createDataFrame(rows, "session_id string, id string, parent_id string")
    with pytest.raises(ValueError, match=words):
        trajectory.ancestry(entries, spark.createDataFrame([("s", leaf)], "session_id string, leaf string"), bound=0)


def test_a_very_long_way_takes_few_rounds(spark):
    n = 100_000
    entries = spark.range(n).select(F.lit("s").alias("session_id"), "id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    got = trajectory.ancestry(entries, spark.createDataFrame([("s", n - 1)], "session_id string, leaf long"), bound=1000)
    assert got.where(F.col("id") + F.col("hops") == n - 1).select("id").distinct().count() == n == got.count()


# --- payloads in the JVM -----------------------------------------------------------


def payload_shapes():
    rnd = random.Random(11)
    inner = ['{"b": 2, "a": [1, {"z": null, "y": "é\\u0001"}]}', '"plain"', '"{\\"k\\": [1, 2]}"', '"1 x"', '"1, 2"', '"] , ["', '""', "null", "[]", "5", "true", '"NaN"']
    rows = [None, "", "null", "5", "[1]", '"name"', '{"name": "a"} x', '{"a": NaN}', "{", '{"name": "cut']
    for name in ("name", "tool_name", "other"):
        for given in ("arguments", "input", "tool_input", "args"):
            for x in inner:
                rows.append(f'{{"{name}": {rnd.choice(inner + ["5"])}, "{given}": {x}, "arguments ": 1}}')
    for call in ('{"read": {"args": {"q": 1}}}', '{"read": {}}', '{"read": 5}', '{"r": 1, "s": 2}', "{}", "5", "null", '{"a.b": {"args": "x", "result": null}}', '{"r": {"result": [1]}, "s": {"result": null}, "t": 3}'):
        rows += [f'{{"tool_call": {call}}}', f'{{"tool_call": {call}, "content": {rnd.choice(inner)}}}']
    for one in ("output", "content", "result", "tool_output", "error_message"):
        for two in ("content", "error_message"):
            rows += [f'{{"{one}": {rnd.choice(inner)}, "{two}x": 1}}', f'{{"{two}": 3, "{one} ": null}}']
    return rows


def test_payloads_read_in_the_jvm_equal_those_read_in_python(spark):
    rows = [(i, k, r, t, raw) for i, raw in enumerate(payload_shapes()) for k, r, t in (("tool_call", None, "said"), ("tool_call", None, None), ("message", "user", 'a "b"'), ("unknown", None, None))]
    df = spark.createDataFrame(rows, "i int, kind string, role string, text string, raw string")
    got = df.select("kind", "role", "text", "raw", variants.action_key("kind", "role", "text", "raw").alias("key"), outcomes.tool_name("raw").alias("name"), outcomes.result_text("raw").alias("result"))
    assert "Python" not in got._jdf.queryExecution().toString()
    for r in got.collect():
        try:
            payload = payloads.loads(r.raw)
        except (TypeError, ValueError):
            payload = None
        parts, content = payloads.tool_parts(payload), payloads.result_content(payload)
        assert r.key == payloads.action_key(r.kind, r.role, r.text, r.raw), r
        assert r.name == (parts[0] if parts and isinstance(parts[0], str) else None), r
        assert r.result == (None if content is None else payloads.dumps(content)), r


# --- catalogs ---------------------------------------------------------------------


def test_a_million_batches_are_grouped_in_order(spark):
    n, most, ids = 1_000_000, 1000, 40
    size = F.pmod(F.xxhash64("id"), F.lit(1100))
    b = spark.range(n).select(F.col("id").alias("seq"), F.concat(F.lit("b"), F.col("id").cast("string")).alias("batch_id"), F.when(F.col("id") % 50 < 30, size % 20).otherwise(size).alias("bytes"), F.when(F.col("id") % 3 > 0, F.array(F.lit("x"))).alias("replaces"))
    sizes = [r.bytes for r in b.select("bytes").orderBy("seq").collect()]
    want, own, total, names = {}, [], 0, 0
    for k, x in enumerate(sizes):
        m = 2 if k % 3 else 1
        if own and (total + x > most or names + m > ids):
            want.update(dict.fromkeys(own, own[0]) if len(own) > 1 else {})
            own, total, names = [], 0, 0
        if x <= most:
            own, total, names = [*own, k], total + x, names + m
    want.update(dict.fromkeys(own, own[0]) if len(own) > 1 else {})
    began = time.time()
    got = catalog.compaction_groups(b.repartition(7), most, ids).select("seq", F.min("seq").over(Window.partitionBy("group")).alias("first")).toPandas()
    assert time.time() - began < 60
    assert dict(zip(got.seq.tolist(), got["first"].tolist())) == want


# --- workers -------------------------------------------------------------------

ELSEWHERE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__
queries = __spark_entry__.queries()
for name in ("plan_strict_alignment", "align_monotone", "block_explode", "record_status", "branch_ancestry"):
    print(name, queries[name](spark, {sf!r}).count())
"""


def test_workers_find_the_package_from_another_folder(tmp_path, sf_dir):
    """The repository is on the driver's path alone, and workers start elsewhere."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", ELSEWHERE.format(repo=repo, sf=sf_dir)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-2000:]
    assert all(int(x.split()[1]) > 0 for x in run.stdout.splitlines() if x.strip())

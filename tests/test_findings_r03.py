"""What a review of round 3 found."""

import pyarrow as pa
from pyspark.sql import functions as F

from sessionloom.operators import matching, runs


def aligned(spark, rows):
    found = matching.monotone(spark.createDataFrame(rows, "pair string, candidate_step long, oracle_step long, score double"))
    return sorted((r.pair, r.candidate_step, r.oracle_step, r.similarity) for r in found.collect())


def test_sums_that_differ_by_their_order_alone_are_ties(spark):
    """Both candidates say the same, added up in another order; the later one is left out."""
    one, other = 0.1 + 0.2 + 0.3, 0.3 + 0.2 + 0.1
    assert one != other
    for a, b in ((one, other), (other, one)):
        assert aligned(spark, [("p", 0, 0, a), ("p", 1, 0, b)]) == [("p", 0, 0, a)]


def test_pairs_of_one_task_are_apart(spark):
    rows = [(f"p{k}", c, o, 1.0 + (c == o)) for k in range(300) for c in range(k % 4 + 1) for o in range(3)]
    rows += [("p1", 0, 0, 0.5), ("none", 0, 0, 0.05)]  # of repeated rows the greatest counts
    want = sorted((f"p{k}", c, c, 2.0) for k in range(300) for c in range(min(k % 4 + 1, 3)))
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (batch, "2"):  # a pair over several batches
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            assert aligned(spark, rows) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_weights_are_whole_numbers_that_add_up(spark):
    texts = spark.createDataFrame([("p", k, "a b c d e f"[: 2 * k + 1]) for k in range(6)], "pair string, idx long, text string")
    found = matching.bm25(texts.select("pair", F.col("idx").alias("doc"), "text"), texts.select("pair", F.col("idx").alias("query"), "text"), ("pair",))
    for r in found.collect():
        assert isinstance(r.weight, int) and abs(r.weight / matching.UNIT - r.score) < 1e-10


def test_a_worker_has_few_steps_as_objects_at_once():
    event = {"at": 1, "id": "e", "kind": "message", "role": "assistant", "text": "hello", "tool_call_id": None, "payload_json": "{}"}
    kinds = pa.struct([(n, pa.int32() if n == "at" else pa.string()) for n in event])
    batch = pa.RecordBatch.from_arrays([pa.array(["r"] * 1000), pa.array(range(1000)), pa.array([[event]] * 1000, pa.list_(kinds))], ["run", "idx", "events"])
    made = list(runs._keyed(iter([batch])))
    assert max(b.num_rows for b in made) <= 256
    assert [x for b in made for x in b.column(1).to_pylist()] == list(range(1000))


def test_each_table_of_runs_is_stored_before_the_next_is_made_of_it(spark, tmp_path):
    from sessionloom.sources import lift

    names = []
    keep = runs.keeper(spark, str(tmp_path))
    own = runs.trajectories(lift.conversation_events(spark, "/root/testdata/sf0.001"), keep=lambda t, n: names.append(n) or keep(t, n))
    assert names == ["events", "steps", "runs"]
    assert len(own.runs.inputFiles()) and all("/runs/" in f for f in own.runs.inputFiles())
    plain = runs.trajectories(lift.conversation_events(spark, "/root/testdata/sf0.001"))
    assert own.runs.exceptAll(plain.runs).isEmpty() and plain.runs.exceptAll(own.runs).isEmpty()

"""What components cost, and chunks of links."""

import numpy as np
import pyarrow as pa

from sessionloom.llm import components as c


def test_a_round_costs_few_tasks_where_shuffles_have_many(spark):
    """Two long chains that meet at their far ends, and a star: one shuffle a round with a task for each partition."""
    links = [(i, i + 2) for i in range(1000, 1120)] + [(1120, 1121)] + [(5, k) for k in range(10, 40)]
    stored = c.staged(spark.createDataFrame(links, "a long, b long").repartition(8), "test-links")
    sc, held = spark.sparkContext, {"spark.sql.shuffle.partitions": "96", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    sc.setJobGroup("components", "")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.id: r.component for r in c.components(stored).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == {i: 1000 for i in range(1000, 1122)} | {i: 5 for i in (5, *range(10, 40))}
    tracker = sc.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(job).stageIds}
    assert sum(x.numCompletedTasks for s in stages if (x := tracker.getStageInfo(s))) < 8 * 96


def test_chunks_of_links_keep_those_of_an_id_together(monkeypatch):
    monkeypatch.setattr(c, "CHUNK", 8)
    u, v = np.array([9] * 20 + [10, 10, 11]), np.array([*range(8, 0, -1)] * 2 + [8, 7, 6, 5] + [3, 0, 10])
    batches = [pa.RecordBatch.from_arrays([pa.array(u[k : k + 3]), pa.array(v[k : k + 3])], ["u", "v"]) for k in range(0, len(u), 3)]
    out = [r for b in c._forest(iter(batches)) for r in b.to_pylist()]
    own = [r for r in out if not r["new"]]
    assert sorted(r["u"] for r in own) == [9, 10, 11]  # one link each
    assert {(r["u"], r["v"]) for r in out} >= {(9, 1), (8, 1), (2, 1), (10, 0), (3, 0)}

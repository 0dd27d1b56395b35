"""What a review of round 3 found: BM25 over a whole corpus, and archives of many batches."""

from pyspark.sql import functions as F

from sessionloom.operators import matching


def texts(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{k * j % 17}" for j in range(k % 9))) for k in range(200)] + [(200, None)], "doc long, text string")
    return docs, spark.createDataFrame([(k, f"w{k} w{k} w{3 * k % 17} Other") for k in range(12)], "query long, text string")


def test_scores_of_a_corpus_are_made_where_its_documents_lie(spark):
    """Only texts and the terms' document counts are shuffled, never rows of document and query."""
    docs, queries = texts(spark)
    want = {(r.doc, r.query): r.score for r in matching.bm25(docs.fillna("", "text"), queries).collect()}
    for most in (matching.QUERY_TERMS, 3):
        kept, matching.QUERY_TERMS = matching.QUERY_TERMS, most
        try:
            found = matching.bm25_corpus(docs, queries)
            got = {(r.doc, r.query): r.score for r in found.collect()}
        finally:
            matching.QUERY_TERMS = kept
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    plan = matching.bm25_corpus(docs, queries)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(doc" in x]
    assert dealt and not any("query" in x.split("hashpartitioning(")[1].split(")")[0] for x in dealt)


def test_batches_are_written_from_folders_of_their_own(spark, monkeypatch):
    """The table of events is read once, however many batches there are."""
    from sessionloom.plans import archives

    seen = []
    monkeypatch.setattr(archives, "SESSIONS", 5)
    monkeypatch.setattr(archives.A, "write_batch", lambda records, events, root, who, name: seen.append((name, records.inputFiles(), records.count())))
    archives.stored_events(spark, "/root/testdata/sf0.001")
    assert len(seen) > 2 and all("/events.parquet" not in f and f"part={name}/" in f for name, files, _ in seen for f in files)
    user = F.col("user_id")
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert sum(n for _, _, n in seen) == e.count() + e.where((user % 2 == 1) & (user % 10 == 5)).count()

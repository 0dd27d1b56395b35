"""Recall, outcomes, judging and registries."""

import json

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import outcomes, recall
from sessionloom.sources import lift


def test_recall_pages_and_bounds(spark, sf_dir):
    events = lift.events(spark, sf_dir)
    found = recall.search_sessions(events, "U1", limit=2)
    assert len(found["items"]) == 2 and found["next_offset"] == 2 and found["total"] >= 3
    session = found["items"][0]["session_id"]
    whole = recall.read_session(events, session, limit=100)
    assert whole["total"] >= len(whole["items"]) > 0 and {x["session_id"] for x in whole["items"]} == {session}
    assert recall.get_event(events, "4")["items"][0]["id"] == "4"
    with pytest.raises(ValueError):
        recall.search_sessions(events, limit=101)


def test_large_items_become_stubs_and_answers_stay_bounded(spark):
    rows = [(f"e{i}", "pi", "s", "x", i, 0, "message", None, "t" * size, False, i) for i, size in enumerate([300_000, *[250_000] * 5])]
    events = spark.createDataFrame(rows, "id string, harness string, session_id string, source_id string, position long, sub_index long, kind string, tool_call_id string, text string, is_hook boolean, batch_ord long")
    answer = recall.read_session(events, "s")
    assert answer["items"][0]["truncated"] and len(answer["items"][0]["text_preview"]) == 4096
    assert answer["total"] == 6 and answer["next_offset"] == len(answer["items"]) == 5
    twice = events.union(events.withColumn("harness", F.lit("codex")))
    with pytest.raises(ValueError, match="ambiguous"):
        recall.read_session(twice, "s")


def test_outcomes(spark):
    steps = spark.createDataFrame(
        [
            ("codex", "s", 0, True, "tool_call", "a", None, json.dumps({"name": "run"})), ("codex", "s", 0, False, "tool_result", "b", "all passed", "{}"),
            ("codex", "s", 1, True, "tool_call", "c", None, json.dumps({"tool_call": {"read": {"args": 1}}})), ("codex", "s", 1, False, "tool_result", "d", None, json.dumps({"output": {"x": "found"}})),
        ],
        "harness string, session_id string, step long, is_head boolean, kind string, id string, text string, payload_json string",
    )
    assert outcomes.tool_result_contains(steps, "run", "passed").first().event_ids == ["b"]
    assert outcomes.tool_result_contains(steps, "read", "found").first().passed
    assert not outcomes.tool_result_contains(steps, "read", "passed").first().passed
    finals = spark.createDataFrame([("codex", "s", "it is done"), ("codex", "t", None)], "harness string, session_id string, final_output string")
    assert [r.passed for r in outcomes.final_contains(finals, "done").orderBy("session_id").collect()] == [True, False]
    assert [r.passed for r in outcomes.final_equals(finals, "done").collect()] == [False, False]

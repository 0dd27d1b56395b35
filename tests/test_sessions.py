"""Transcripts, archives and trajectories on small inputs written here."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.functions import columns as X
from sessionloom.functions import payloads as P
from sessionloom.operators import archive, assessment, catalog, matching, textindex, trajectory
from sessionloom.operators import query as Q
from sessionloom.plans import catalogue, registration  # noqa: F401
from sessionloom.sources import normalize, transcripts



def at(second):
    return f"2025-03-08T06:30:{second:02d}+01:00"


def said(role, text):
    return {"type": "message", "role": role, "content": [{"type": "input_text" if role == "user" else "output_text", "text": text}]}


#: A made-up session: someone has the greenhouse watered.
CODEX = [
    {"type": kind, "timestamp": at(k), "payload": payload}
    for k, (kind, payload) in enumerate(
        [
            ("session_meta", {"id": "green-7", "parent_thread_id": "plot", "cwd": "/garden/north"}),
            ("response_item", said("user", "Water the tomatoes, please.")),
            ("event_msg", {"type": "user_message", "message": "Water the tomatoes, please."}),
            ("response_item", {"type": "function_call", "name": "open_valve", "call_id": "v-3", "arguments": json.dumps({"minutes": 4, "bed": "tomatoes"})}),
            ("response_item", {"type": "function_call_output", "call_id": "v-3", "output": "valve closed after 4 minutes"}),
            ("response_item", said("assistant", "The tomatoes have had four minutes of water.")),
            ("weather_report", {"rain": False}),
        ]
    )
]


def write(path, rows, tail=""):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows) + tail)


@pytest.fixture()
def parsed(spark, tmp_path):
    write(tmp_path / "a.jsonl", CODEX, '{"type": "res')
    return transcripts.read(spark, "codex", str(tmp_path))


def test_codex_lines_become_records_and_events(parsed):
    records, events = transcripts.records_of(parsed).collect(), transcripts.events_of(parsed).orderBy("position").collect()
    assert len(records) == 7 and sorted(r.status for r in records) == ["parsed"] * 6 + ["unknown"]
    assert [e.kind for e in events] == ["metadata", "message", "auxiliary", "tool_call", "tool_result", "message", "unknown"]
    assert {e.parent_session_id for e in events} == {"plot"}
    assert events[3].tool_call_id == events[4].tool_call_id == "v-3" and events[4].text.startswith("valve")
    assert events[1].timestamp == "2025-03-08T05:30:01.000Z"
    first = next(r for r in records if r.position == 0)
    assert first.id == normalize.stable_id(first.source_id, "0", __import__("hashlib").sha256(bytes(first.raw)).hexdigest())


def test_pi_and_cursor_formats():
    pi = normalize.Pi.events
    assert pi({"type": "message", "id": "b", "parentId": "a", "message": {"role": "toolResult", "toolCallId": "t", "content": [{"text": "x"}, {"text": "y"}]}})[0]["text"] == "x\ny"
    blocks = pi({"type": "message", "message": {"role": "assistant", "model": "m", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "toolCall", "id": "t"}]}})
    assert [(b["kind"], b["model"], b["tool_call_id"]) for b in blocks] == [("reasoning", "m", None), ("tool_call", "m", "t")]
    assert pi({"type": "message", "message": {"role": "assistant", "content": []}}) == []
    cursor = normalize.Cursor.events
    assert cursor({"type": "assistant", "timestamp_ms": 1, "message": {"content": "x"}})[0]["kind"] == "delta"
    assert cursor({"type": "assistant", "timestamp_ms": 1, "model_call_id": "m", "message": {"content": "x"}})[0]["timestamp"] == "1970-01-01T00:00:00.001Z"
    assert cursor({"hook_event_name": "postToolUse", "tool_use_id": "t", "tool_output": "o"})[0]["kind"] == "tool_result"
    assert normalize.identify("cursor", "/x/parent/subagents/child.jsonl", b'{"role":"user"}\n')["parent"] == "parent"


@pytest.mark.parametrize("raw", [b"[1]\n", b"{\n", b'{"a": NaN}\n', b'{"a":1} x\n', b"\xff\n"])
def test_malformed_lines_are_kept_without_events(raw):
    row = normalize.parse({"harness": "pi", "session": "s", "source_id": "x"}, 0, raw)
    assert row["status"] == "malformed" and row["events"] == [] and row["raw"] == raw


def test_archive_round_trip_compaction_and_verification(spark, parsed, tmp_path):
    root = str(tmp_path / "archive")
    records, events = transcripts.records_of(parsed), transcripts.events_of(parsed)
    one = archive.write_batch(records.where("position < 300"), events.where("position < 300"), root, "me")
    two = archive.write_batch(records.where("position >= 300"), events.where("position >= 300"), root, "me")
    assert archive.write_batch(records.where("position < 300"), events.where("position < 300"), root, "me") == one
    assert archive.verify(spark, root, one).count() == 0
    assert catalog.validate_manifests(archive.manifests(spark, root)).where("not valid").count() == 0
    merged = archive.compact(spark, root, [one, two], "me")
    active = catalog.active_manifests(archive.manifests(spark, root)).collect()
    assert [m.batch_id for m in active] == [merged] and sorted(active[0].replaces) == sorted([one, two])
    back = archive.open_archive(spark, root, session="green-7")
    assert back[0].count() == 7 and back[1].count() == 7
    assert archive.open_archive(spark, root, session="none")[0].count() == 0
    assert archive.open_archive(spark, root, sessions=[("codex", "green-7")])[0].count() == 7 and archive.open_archive(spark, root, sessions=[("pi", "green-7")])[0].count() == 0
    assert not list((tmp_path / "archive" / archive.STAGING).iterdir())
    part = next((tmp_path / "archive" / one / "events").glob("*.parquet"))
    part.write_bytes(part.read_bytes()[:-1] + b"?")
    assert [r.problem for r in archive.verify(spark, root, one).collect()] == ["changed"]
    with pytest.raises(ValueError, match="inventory"):
        archive.write_batch(records.where("position < 300"), events.where("position < 300"), root, "me")
    (tmp_path / "archive" / one / ".manifest.json.crc").unlink(missing_ok=True)
    (tmp_path / "archive" / one / "manifest.json").write_text(json.dumps({"schema_version": 9}))
    with pytest.raises(Exception, match="well formed"):
        archive.manifests(spark, root).collect()


def test_trajectory_attaches_results_and_finds_the_output(parsed):
    e = trajectory.chronology(transcripts.events_of(parsed))
    steps = trajectory.steps(e).orderBy("at").collect()
    assert [(s.kind, s.step, s.is_head) for s in steps] == [("tool_call", 0, True), ("tool_result", 0, False), ("message", 1, True)]
    assert trajectory.final_output(e).first().final_output == "The tomatoes have had four minutes of water."


def test_chronology_needs_times_across_sources(spark):
    rows = [("codex", "s", "x", 1, 0, "a", None), ("codex", "s", "y", 2, 0, "b", "2026-10-01T10:00:00.000Z")]
    e = spark.createDataFrame(rows, "harness string, session_id string, source_id string, position long, sub_index long, id string, timestamp string")
    with pytest.raises(Exception, match="need timestamps"):
        trajectory.chronology(e).collect()


def test_ancestry_of_long_ways_loops_and_gaps(spark):
    schema = "session_id string, id long, parent_id long"
    chain = spark.createDataFrame([("s", k, k - 1 if k else None) for k in range(5000)], schema)
    assert trajectory.ancestry(chain, trajectory.leaves_of(chain)).agg(F.count("*"), F.max("hops")).first()[:] == (5000, 4999)
    for rows, what in (([("s", 1, 2), ("s", 2, 1), ("s", 3, 2)], "loop"), ([("s", 1, None), ("s", 3, 7)], "isn't among")):
        entries = spark.createDataFrame(rows, schema)
        with pytest.raises(Exception, match=what):
            trajectory.ancestry(entries, spark.createDataFrame([("s", 3)], "session_id string, leaf long")).collect()


def test_ancestry_of_branches(spark):
    tree = [("s", "a", None), ("s", "b", "a"), ("s", "c", "b"), ("s", "d", "b")]
    entries = spark.createDataFrame(tree, "session_id string, id string, parent_id string")
    leaves = trajectory.leaves_of(entries)
    assert sorted(r.leaf for r in leaves.collect()) == ["c", "d"]
    assert sorted(r.id for r in trajectory.ancestry(entries, leaves.where("leaf = 'd'")).collect()) == ["a", "b", "d"]


def test_whole_ancestry_walks_every_user(spark, tmp_path):
    of_user = {u: list(range(10 * u, 10 * u + 1 + u)) for u in range(6)}
    spark.createDataFrame([(e, u) for u, own in of_user.items() for e in own], "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = [tuple(r) for r in registration.QUERIES["branch_ancestry"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((f"u{u}", own[-1], e, own[-1] - e) for u, own in of_user.items() for e in own)


def runs(spark, *texts):
    return spark.createDataFrame([("p", i, t, t) for i, t in enumerate(texts)], "pair string, idx long, key string, text string")


def pairs(df):
    return sorted((r.candidate_step, r.oracle_step) for r in df.collect())


def monotone_choices(n, m):
    """Every way to match n rows with m columns, one to one and in order."""
    for k in range(min(n, m) + 1):
        for rows in itertools.combinations(range(n), k):
            for columns in itertools.combinations(range(m), k):
                yield list(zip(rows, columns))


def test_align_is_best_among_all_monotone_matchings():
    rnd = random.Random(41)
    for _ in range(60):
        n, m, threshold = rnd.randint(0, 4), rnd.randint(1, 4), rnd.choice([0.0, 0.3])
        scores = [[rnd.choice([0.0, 0.2, 0.3, 0.7, 1.1, 1.5]) for _ in range(m)] for _ in range(n)]
        got = [(i, int(j)) for i, j in enumerate(matching.align([(np.arange(m), np.array(row)) for row in scores], m, threshold)) if j >= 0]
        best = max((sum(scores[i][j] for i, j in c) for c in monotone_choices(n, m) if all(scores[i][j] > threshold for i, j in c)), default=0.0)
        assert got in list(monotone_choices(n, m)) and all(scores[i][j] > threshold for i, j in got)
        assert abs(sum(scores[i][j] for i, j in got) - best) < 1e-9


def test_matching_by_keys_equals_plain_matchers(spark):
    rnd = random.Random(17)
    for _ in range(3):
        o, c = ([rnd.choice("pqr") for _ in range(n)] for n in (6, 8))
        do, dc = runs(spark, *o), runs(spark, *c)
        assert pairs(matching.strict(do, dc)) == [(i, i) for i in range(min(len(o), len(c))) if o[i] == c[i]]
        free, want = {k: [i for i, x in enumerate(o) if x == k] for k in "pqr"}, []
        for i, x in enumerate(c):
            if free[x]:
                want.append((i, free[x].pop(0)))
        assert pairs(matching.unordered(do, dc)) == want
        assert sorted(r.step for r in matching.repeated(dc).collect()) == [i + 1 for i, x in enumerate(c) if x in c[:i]]
        needed = [0, 2, 5]
        most = max(len(x) for x in monotone_choices(len(c), len(o)) if all(j in needed and c[i] == o[j] for i, j in x))
        got = pairs(matching.required(do, dc, spark.createDataFrame([("p", k) for k in needed], "pair string, idx long")))
        assert len(got) == most and all(j in needed and c[i] == o[j] for i, j in got) and got == sorted(got, key=lambda x: x[1])


def test_steps_are_matched_by_what_they_say(spark):
    reference = ["weigh the flour", "knead dough until smooth", "bake for forty minutes", "let the loaf cool"]
    candidate = ["weigh flour and salt", "feed the neighbour's cat", "bake forty minutes at most", "cool the loaf"]
    o, c = runs(spark, *reference), runs(spark, *candidate)
    scored = matching.bm25(o.select("pair", F.col("idx").alias("doc"), "text"), c.select("pair", F.col("idx").alias("query"), "text"), ("pair",))
    found = matching.monotone(scored.select("pair", F.col("query").alias("candidate_step"), F.col("doc").alias("oracle_step"), "score"), 0.6)
    assert pairs(found) == [(0, 0), (2, 2), (3, 3)]


def test_the_best_documents_without_all_scores(spark):
    rnd = random.Random(23)
    common, rare = [f"c{k}" for k in range(5)], [f"r{k}" for k in range(60)]
    docs = [(i, " ".join([rnd.choice(common) for _ in range(rnd.randint(0, 9))] + rnd.sample(rare, rnd.randint(0, 3)))) for i in range(300)]
    asks = [(i, " ".join(rnd.sample(common, 3) + rnd.sample(rare, rnd.choice([0, 1, 4])))) for i in range(25)] + [(90, "nowhere"), (91, "")]
    corpus, queries = spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(asks, "query long, text string")
    whole = {}
    for r in matching.bm25(corpus, queries).collect():
        whole.setdefault(r.query, []).append((-round(r.score, 6), r.doc))
    got = {}
    for r in textindex.bm25_top(corpus, queries, 7).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((-r.score, r.doc))
    assert got == {k: sorted(v)[:7] for k, v in whole.items()}


def test_collapse_prefers_transcripts_and_filters_come_first(spark):
    row = "id string, harness string, session_id string, source_id string, position long, sub_index long, kind string, tool_call_id string, text string, timestamp string, is_hook boolean"
    rows = [("h", "cursor", "s", "a", 1, 0, "tool_result", "t", "hook copy", None, True), ("m", "cursor", "s", "b", 9, 0, "tool_result", "t", "main", None, False), ("n", "cursor", "s", "b", 8, 0, "tool_result", None, "free", None, False)]
    e = spark.createDataFrame(rows, row)
    assert sorted(r.id for r in Q.select_events(e, Q.Query()).collect()) == ["m", "n"]
    assert [r.id for r in Q.select_events(e, Q.Query(text="hook")).collect()] == ["h"]


def test_filters_reach_the_scan(spark, tmp_path, parsed):
    path = str(tmp_path / "e")
    transcripts.events_of(parsed).write.parquet(path)
    df = spark.read.parquet(path).where(Q.Query(kind="message", text="ato").checked().on_events()).select("id")
    plan = df._jdf.queryExecution().toString()
    assert "EqualTo(kind,message)" in plan and "StringContains(text,ato)" in plan


def test_keys_read_three_columns_and_rows_come_one_by_one(spark, tmp_path, parsed):
    path = str(tmp_path / "r")
    transcripts.records_of(parsed).write.parquet(path)
    stored = spark.read.parquet(path)
    keys = Q.record_keys(stored, Q.Query(session="green-7"))
    assert keys.columns == ["id", "harness", "session_id"] and "raw:" not in keys._jdf.queryExecution().executedPlan().toString()
    seen = []
    assert Q.each(Q.read_records(stored, Q.Query(harness="codex")).orderBy("position"), lambda r: seen.append(r.position)) == 7 and seen == sorted(seen)


def test_bounds():
    assert X.parse_bound("2026-10-01T12:00:00.1239+02:00") == "2026-10-01T10:00:00.123Z"
    with pytest.raises(ValueError):
        Q.Query(since="2026-10-02T00:00:00Z", until="2026-10-01T00:00:00Z").checked()
    with pytest.raises(ValueError):
        X.parse_bound("2026-10-01")


GOOD = {"reward": 1, "rationale": "the bed is wet"}


@pytest.mark.parametrize("patch", [{"reward": -1}, {"reward": "1"}, {"reward": 1.0}, {"reward": False}, {"reward": None}, {"rationale": "\t "}, {"rationale": ["wet"]}, {"confidence": 0.9}])
def test_judgments_that_are_refused(patch):
    assert P.judgment(json.dumps(GOOD)) == (1, "the bed is wet")
    with pytest.raises(ValueError):
        P.judgment(json.dumps(GOOD | patch))
    for broken in ("[]", json.dumps(GOOD) + ".", json.dumps({"reward": 0})):
        with pytest.raises(ValueError):
            P.judgment(broken)


def test_keys_go_by_what_a_step_does():
    call = {"minutes": 4, "bed": "tomatoes"}
    shapes = [{"name": "water", "arguments": json.dumps(call)}, {"arguments": dict(reversed(call.items())), "name": "water"}, {"tool_name": "water", "tool_input": call}, {"tool_call": {"water": {"args": call}}}]
    assert len({P.action_key("tool_call", None, None, json.dumps(x)) for x in shapes}) == 1
    assert P.action_key("tool_call", None, None, json.dumps({"name": "water", "input": {"minutes": 5}})) != P.action_key("tool_call", None, None, json.dumps(shapes[0]))
    odd = [P.action_key("tool_call", None, None, json.dumps({"do": k})) for k in range(2)]
    assert odd[0] != odd[1]
    assert P.action_key("message", "assistant", "hello", '{"a":1}') == P.action_key("message", "assistant", "hello", "{}") != P.action_key("message", "assistant", None, "{}")
    own = P.action_key("tool_call", None, None, json.dumps(shapes[0]))
    moist = [("done", json.dumps({"output": "wet", **extra})) for extra in ({"id": "1"}, {"timestamp_ms": 9, "parentId": "x"}, {"deep": {"id": "1"}})]
    assert P.evidence_key(own, moist[:1]) == P.evidence_key(own, moist[1:2]) != P.evidence_key(own, moist[2:])


def test_search_text_leaves_out_names_and_places():
    call = json.dumps({"name": "water", "call_id": "v-3", "arguments": {"bed": "tomatoes", "role": "gardener", "steps": ["open", 4, {"type": "x", "then": "close"}]}})
    assert P.searchable([("tool_call", None, call), ("tool_result", "closed", json.dumps({"output": "never searched"}))]).split("\n") == ["water", "tomatoes", "open", "close", "closed"]


def test_calibration(spark):
    rows = spark.createDataFrame([("j", 1, 1), ("j", 1, 0)], "judge string, predicted int, human int")
    over = {r.judge: r for r in assessment.calibrate(rows).collect()}
    assert over[None].agreement == 0.5 and over[None].fp == 1 and over["j"].recall == 1.0


def test_compaction_closes_groups(spark):
    b = spark.createDataFrame([(k, f"b{k}", s, []) for k, s in enumerate([10, 10, 200, 10, 95, 5])], "seq int, batch_id string, bytes long, replaces array<string>")
    groups = {r.batch_id: r.group for r in catalog.compaction_groups(b, 100).collect()}
    assert set(groups) == {"b0", "b1", "b4", "b5"} and groups["b0"] == groups["b1"] != groups["b4"] == groups["b5"]


def test_terminal_text(spark):
    df = spark.createDataFrame([("a\x1b[0m\n\tb",)], "t string")
    assert df.select(X.terminal_safe("t").alias("t")).first().t == "a\\u{1b}[0m\n\tb"


def test_tail_stores_each_line_once(spark, tmp_path):
    from sessionloom.streaming import tail

    root, store, check = tmp_path / "in", str(tmp_path / "archive"), str(tmp_path / "check")
    root.mkdir()
    write(root / "a.jsonl", CODEX[:3], '{"part')
    for rows in (CODEX[:3], CODEX, CODEX):
        write(root / "a.jsonl", rows)
        q = tail.watch(spark, "codex", str(root), store, check).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        assert not q.exception()
    records, events = archive.open_archive(spark, store)
    assert records.count() == 7 and events.count() == 7

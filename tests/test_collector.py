"""Discovery, hooks, configuration, upkeep, remotes, the service, recall over JSON-RPC and the command line."""

import io
import json
import os
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from sessionloom import cli, config, rpc, service
from sessionloom.functions import columns as X
from sessionloom.functions.files import Folder
from sessionloom.operators import archive, maintenance, models, recall, remote
from sessionloom.operators import query as Q
from sessionloom.operators.policy import Model
from sessionloom.sources import discover, hooks, transcripts
from sessionloom.streaming import tail

TOKEN = "let-me-in"


def lines(name, *texts, cwd="/garden"):
    rows = [{"type": "session_meta", "timestamp": "2025-06-01T07:00:00Z", "payload": {"id": name, "cwd": cwd}}]
    rows += [{"type": "response_item", "timestamp": f"2025-06-01T07:00:{k + 1:02d}Z", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": t}]}} for k, t in enumerate(texts)]
    return "".join(json.dumps(r) + "\n" for r in rows)


def two_batches(spark, tmp_path):
    root = str(tmp_path / "archive")
    out = []
    for name in ("spring", "autumn"):
        at = tmp_path / name
        at.mkdir()
        (at / "x.jsonl").write_text(lines(name, f"{name} work", "done"))
        parsed = transcripts.read(spark, "codex", str(at))
        out.append(archive.write_batch(transcripts.records_of(parsed), transcripts.events_of(parsed), root, "me"))
    return root, out


def test_discovery(tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    for name, text in (("b.jsonl", lines("b")), ("deep/er/a.ndjson", lines("a", cwd="/kitchen")), ("deep/c.jsonl", "not json\n" + lines("c")), ("none.jsonl", "{}\n"), ("skip.txt", lines("t"))):
        (tmp_path / name).write_text(text)
    os.symlink(tmp_path / "b.jsonl", tmp_path / "link.jsonl")
    (tmp_path / "late.jsonl").write_text("x" * (2 << 20) + "\n" + lines("late"))
    found = discover.discover([("codex", [str(tmp_path), str(tmp_path / "deep")])])
    assert [s["session"] for s in found] == ["b", "c", "a", "late"]
    assert [s["session"] for s in discover.discover([("codex", [str(tmp_path)])], "kitchen")] == ["a"]
    assert len(discover.discover([("codex", [str(tmp_path)])], str(tmp_path / "deep"))) == 2
    assert discover.default_roots("codex", "/h", {"CODEX_HOME": "/c"}) == ["/c/sessions", "/c/archived_sessions"] and discover.default_roots("cursor", "/h", {}) == ["/h/.cursor/projects"]
    assert discover.roots(["cursor"], [("cursor", "/own")], (), "/spool") == [("cursor", ["/own", "/spool"])]
    with pytest.raises(ValueError):
        discover.roots(["pi", "codex"], (), ["/x"])


def test_identities_are_kept_while_files_settle(tmp_path, monkeypatch):
    path = tmp_path / "x.jsonl"
    path.write_text(lines("one"))
    old = time.time() - 60
    os.utime(path, (old, old))
    known = discover.Identities(str(tmp_path / "known.json"))
    assert known.identify("codex", str(path))["session"] == "one"
    known.save()
    again = discover.Identities(str(tmp_path / "known.json"))
    monkeypatch.setattr(discover, "identify", lambda *a: pytest.fail("read again"))
    assert again.identify("codex", str(path))["session"] == "one"
    monkeypatch.setattr(discover, "identify", lambda *a: {"session": "new", "harness": "codex"})
    path.write_text(lines("two"))
    assert again.identify("codex", str(path))["session"] == "new"
    assert discover.settled(10.0, 12.5) and not discover.settled(10.0, 12.0)


HOOK = b'{\n  "hook_event_name": "postToolUse",\n  "conversation_id": "talk",\n  "tool_use_id": "t",\n  "tool_output": "wet"\n}'


def test_hooks_keep_the_bytes_that_came(spark, tmp_path):
    spool = str(tmp_path / "hooks")
    path = hooks.receive(spool, HOOK)
    assert open(path).read().count("\n") == 1 and hooks.raw_input(path) == HOOK
    for wrong in (b"[]", b'{"hook_event_name": "x"}', b'{"conversation_id": "x", "hook_event_name": 1}', HOOK + b"x"):
        with pytest.raises(ValueError):
            hooks.receive(spool, wrong)
    row = transcripts.read(spark, "cursor", spool).collect()
    assert len(row) == 1 and bytes(row[0].raw) == HOOK and row[0].session_id == "talk" and row[0].events[0].text == "wet"
    store, state = f"file://{tmp_path}/archive", str(tmp_path / "state")
    tail.capture(spark, [("cursor", [spool])], store, state)
    assert bytes(archive.open_archive(spark, store)[0].first().raw) == HOOK
    size = os.path.getsize(path)
    assert maintenance.purge_hook_spool(spool, {path: size - 1, str(tmp_path / "other.jsonl"): 5}) == []
    assert maintenance.purge_hook_spool(spool, {path: size}) == [path] and not os.path.exists(os.path.dirname(path))


def test_hook_configuration(tmp_path):
    program = tmp_path / "it's a program"
    program.write_text("")
    at = tmp_path / "hooks.json"
    at.write_text(json.dumps({"version": 1, "hooks": {"sessionStart": [{"command": "mine"}]}}))
    one = hooks.install(str(at), str(program), "/spool")
    assert hooks.install(str(at), str(program), "/spool") == one and len(one["hooks"]["sessionStart"]) == 2 and set(one["hooks"]) == set(hooks.MOMENTS)
    hooks.uninstall(str(at))
    assert json.loads(at.read_text())["hooks"]["sessionStart"] == [{"command": "mine"}]
    import shlex

    assert shlex.split(hooks.shell_quote("it's $x")) == ["it's $x"]


def test_a_tailed_file_that_was_replaced_is_read_again(spark, tmp_path):
    root, store, check = tmp_path / "in", str(tmp_path / "archive"), str(tmp_path / "check")
    root.mkdir()

    def run(text, records=1000):
        (root / "a.jsonl").write_text(text)
        q = tail.watch(spark, "codex", str(root), store, check, max_records=records).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and not q.exception()
        return archive.open_archive(spark, store)[0].count()

    assert run(lines("a", "one", "two", "three"), records=2) == 2
    assert run(lines("a", "one", "two", "three")) == 4
    assert run(lines("a", "one", "two")) == 4  # shorter: read again, and all of it is known
    assert run(lines("a", "one", "other", "three")) == 6  # replaced within
    assert tail.progress(check)[str(root / "a.jsonl")][0] == len(lines("a", "one", "other", "three"))


def test_configuration(tmp_path):
    at = tmp_path / "c.toml"
    good = 'state_dir = "/s"\nmax_records = 5\n[[sources]]\nharness = "pi"\npath = "/p"\n[[remotes]]\nkind = "store"\nname = "far"\nuri = "s3a://b/x"\n[policy]\nmatching = "strict"\n[policy.criteria]\nrequired_steps = [1]\n'
    at.write_text(good)
    c = config.load(str(at))
    assert c.max_records == 5 and c.flush_seconds == 5 and c.remote("far").uri == "s3a://b/x" and c.policy.criteria.required_steps == (1,) and c.archive == "/s/batches"
    assert config.load(str(at), "/other").state_dir == "/other" and config.load(home=str(tmp_path)).state_dir == str(tmp_path / ".sessionloom")
    wrong = ("flush_seconds = 0\n", "more = 1\n", '[[sources]]\nharness = "x"\npath = "y"\n', '[[remotes]]\nkind = "store"\nname = "far"\nuri = "b"\n', '[[remotes]]\nkind = "fax"\nname = "f"\n', '[policy]\nmatching = "luck"\n', "x = \n")
    for text in (*wrong, good + '[[remotes]]\nkind = "service"\nname = "far"\nurl = "https://h"\narchive = "a"\ntoken_env = "T"\n', '[[remotes]]\nkind = "service"\nname = "f"\nurl = "http://h"\narchive = "a"\ntoken_env = "T"\n'):
        at.write_text(text)
        with pytest.raises(ValueError):
            config.load(str(at))
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "missing.toml"))


def test_locks(tmp_path):
    place = Folder(str(tmp_path))
    with place.locked("a"):
        with pytest.raises(ValueError, match="another process"):
            with Folder(str(tmp_path)).locked("a"):
                pass
        with place.locked("b"):
            pass
    with place.locked("a"):
        pass


def test_upkeep(spark, tmp_path):
    root, names = two_batches(spark, tmp_path)
    os.makedirs(f"{root}/{archive.STAGING}/half")
    assert maintenance.remove_temporaries(spark, root, 3600) == [] and maintenance.remove_temporaries(spark, root, -5) == ["half"]
    merged = maintenance.compact_all(spark, root, "me", age=3600)
    assert len(merged) == 1 and all(os.path.exists(f"{root}/{n}") for n in names)
    assert maintenance.purge_replaced(spark, root, age=-5) == sorted(names) and not any(os.path.exists(f"{root}/{n}") for n in names)
    assert archive.open_archive(spark, root)[0].count() == 6 and maintenance.compact_all(spark, root, "me") == []
    maintenance.mark_uploaded(spark, root, "east", merged)
    s = maintenance.status(spark, root, ["east", "west"])
    assert (s["records"], s["sources"], s["batches"], s["remotes"]["east"]["pending"], s["remotes"]["west"]["pending"]) == (6, 2, 1, 0, 1) and s["remotes"]["east"]["last_success"]


def test_first_row_of_an_id_wins(spark, tmp_path):
    root, names = two_batches(spark, tmp_path)
    records, events = archive.open_archive(spark, root)
    archive.write_batch(records, events.selectExpr("* except (text)", "concat('later ', text) as text"), root, "me", name="zz-again")
    assert archive.open_archive(spark, root)[1].where("text like 'later%'").isEmpty()


def test_folder_remote(spark, tmp_path):
    root, names = two_batches(spark, tmp_path)
    far = remote.connect(spark, config.Store("far", f"file://{tmp_path}/far"))
    assert sorted(remote.sync(spark, root, "far", far)) == sorted(names) and remote.sync(spark, root, "far", far) == []
    manifest = archive.manifest(spark, f"{root}/{names[0]}")
    far.upload(f"{root}/{names[0]}", manifest)  # the same again is left alone
    with pytest.raises(ValueError, match="another batch"):
        far.upload(f"{root}/{names[0]}", manifest | {"created_at": "2020-01-01T00:00:00Z"})
    cache = remote.cached(spark, far, f"file://{tmp_path}/cache", session="spring")
    assert archive.open_archive(spark, cache)[0].count() == 3 and len([n for n in os.listdir(tmp_path / "cache") if not n.startswith(".")]) == 1


@pytest.fixture()
def served(tmp_path, monkeypatch):
    monkeypatch.setenv("GARDEN_TOKEN", TOKEN)
    server = service.server(str(tmp_path / "served"), TOKEN)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield config.Service("web", f"http://127.0.0.1:{server.server_port}", "plot-1", "GARDEN_TOKEN")
    server.shutdown()


def test_a_batch_id_is_claimed_once_and_manifests_are_read_once(spark, tmp_path, monkeypatch):
    from sessionloom.functions import filesystem as FS

    place = f"file://{tmp_path}/claims/x/.claim"
    assert FS.create(spark, place, b"one") and not FS.create(spark, place, b"two") and FS.read(spark, place) == b"one"
    root, names = two_batches(spark, tmp_path)
    far = remote.connect(spark, config.Store("far", f"file://{tmp_path}/far"))
    first = archive.manifest(spark, f"{root}/{names[0]}")
    FS.create(spark, f"file://{tmp_path}/far/{names[0]}/.claim", b"somebody else's")
    with pytest.raises(ValueError, match="another batch"):
        far.upload(f"{root}/{names[0]}", first)
    FS.delete(spark, f"file://{tmp_path}/far/{names[0]}")
    # two that upload the same batch agree, whoever claims it
    for _ in range(2):
        far.upload(f"{root}/{names[0]}", first)
    assert [m["batch_id"] for m in far.manifests()] == [names[0]]
    read, real = [], FS.read
    monkeypatch.setattr(FS, "read", lambda s, p: read.append(p) or real(s, p))
    remote.sync(spark, root, "far", far)
    read.clear()
    assert sorted(m["batch_id"] for m in far.manifests()) == sorted(names) and len(read) == len(names) - 1
    far.manifests()
    assert len(read) == len(names) - 1


def test_service_remote(spark, tmp_path, served, monkeypatch):
    root, names = two_batches(spark, tmp_path)
    web = remote.connect(spark, served)
    manifest = archive.manifest(spark, f"{root}/{names[0]}")
    web.request("PUT", remote._route(manifest), json.dumps(manifest).encode()).close()
    with pytest.raises(ValueError, match="409"):
        web.request("POST", f"{remote._route(manifest)}/commit", b"")
    with pytest.raises(ValueError, match="409"):
        web.request("PUT", remote._route(manifest), json.dumps(manifest | {"created_at": "2020-01-01T00:00:00Z"}).encode())
    first = manifest["files"][0]
    for data in (b"x", b"\0" * first["size"]):
        with pytest.raises(ValueError, match="400"):
            web.request("PUT", f"{remote._route(manifest)}/files/{first['path']}", data)
    assert web.manifests() == []
    assert sorted(remote.sync(spark, root, "web", web)) == sorted(names)
    assert sorted(m["batch_id"] for m in web.manifests()) == sorted(names)
    with web.request("GET", "sessions") as r:
        assert sorted(s["session_id"] for s in json.loads(r.read())["sessions"]) == ["autumn", "spring"]
    cache = remote.cached(spark, web, f"file://{tmp_path}/cache", harness="codex", session="autumn")
    assert archive.open_archive(spark, cache)[1].count() == 3
    monkeypatch.setattr(service, "PAGE", 1)
    assert [len(p) for p in web.pages()] == [1, 1]
    web.token = "wrong"
    with pytest.raises(ValueError, match="401"):
        web.manifests()


@pytest.mark.parametrize("patch", [{"schema_version": 2}, {"batch_id": "a/b"}, {"created_at": "2025-01-01t00:00:00z"}, {"files": []}, {"sessions": [{"harness": 1}]}, {"replaces": ["b1"]}, {"replaces": ["x", "x"]}])
def test_the_service_refuses(patch):
    file = {"path": "records/p", "size": 1, "sha256": "0" * 64}
    good = {"schema_version": 1, "collector_id": "c", "batch_id": "b1", "created_at": "2025-01-01T00:00:00Z", "sessions": [], "files": [file, file | {"path": "events/p"}]}
    assert service.validate(good)["replaces"] == []
    for wrong in (patch, {"files": [file, file]}, {"files": [file | {"path": "records/../p"}, file | {"path": "events/p"}]}):
        with pytest.raises(service.Refused):
            service.validate(good | wrong)


def test_models_are_asked_again_but_not_for_ever():
    plan = [(503, {}, b""), (429, {"retry-after": "99"}, b""), (200, {}, json.dumps({"choices": [{"finish_reason": "stop", "message": {"content": "fine"}}]}).encode())]
    seen, waits = [], []

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["content-length"]))))
            status, headers, body = plan.pop(0) if plan else (400, {}, b"your secret input")
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k, v)
            self.send_header("content-length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1"
    ask = models.HttpModel(Model("chat_completions", url, "m"), waits.append)
    assert ask("system", '{"a":1}') == "fine" and waits == [0.25, 30] and seen[-1]["messages"][1]["content"] == '{"a":1}'
    with pytest.raises(ValueError, match="400") as e:
        ask("system", "{}")
    assert "secret" not in str(e.value)
    choice = {"answers": {"reward": {"type": "choice", "choice": "1", "probabilities": {"0": 0.2, "1": 0.8}, "confidence": 0.8}}}
    plan.extend([(200, {}, json.dumps(choice).encode()), (200, {}, json.dumps({"stop_reason": "end_turn", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}).encode()), (200, {}, b"x" * (models.MAX_REPLY + 1)), (200, {}, json.dumps(choice | {"answers": {}}).encode())])
    one = models.HttpModel(Model("choice", url, "m"))
    assert json.loads(one("Is it wet? Return ONLY yes.", "{}"))["reward"] == 1 and seen[-1]["questions"]["reward"]["instructions"] == "Is it wet?"
    assert models.HttpModel(Model("messages", url, "m"))("s", "{}") == "a\nb"
    with pytest.raises(ValueError, match="too large"):
        ask("s", "{}")
    with pytest.raises(ValueError, match="no choice"):
        one("Is it wet? Return ONLY yes.", "{}")
    server.shutdown()
    for wrong in (Model("fax", url, "m"), Model("choice", "http://far.example/v1", "m"), Model("choice", "https://u:p@far.example/v1", "m"), Model("choice", url, " "), Model("choice", url, "m", max_tokens=0)):
        with pytest.raises(ValueError):
            wrong.checked()
    with pytest.raises(ValueError):
        models.choice_instructions("no form")
    told = models.annotated(lambda s, t: s + t, {"note": "dry"}, 60)
    assert '"human_review":{"note":"dry"}' in told("s", "{}") and models.HUMAN_NOTE in told("s", "{}")
    with pytest.raises(ValueError, match="too large"):
        told("s", json.dumps({"x": "y" * 60}))


def test_json_rpc(spark, tmp_path):
    root, _ = two_batches(spark, tmp_path)
    server = rpc.Server(lambda: transcripts.with_hook_flag(archive.open_archive(spark, root)[1]))
    asks = [
        b"nonsense\n", {"jsonrpc": "1.0", "id": 1, "method": "ping"}, {"jsonrpc": "2.0", "id": 1, "method": "tools/list"}, {"jsonrpc": "2.0", "id": 2, "method": "initialize", "params": {}},
        {"jsonrpc": "2.0", "id": 3, "method": "initialize", "params": {"protocolVersion": "2025-06-18", "capabilities": {}, "clientInfo": {}}}, {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/list"}, {"jsonrpc": "2.0", "id": 5, "method": "tools/call", "params": {"name": "search_sessions", "arguments": {"text": "SPRING"}}},
        {"jsonrpc": "2.0", "id": 6, "method": "tools/call", "params": {"name": "read_session", "arguments": {}}}, {"jsonrpc": "2.0", "id": 7, "method": "tools/call", "params": {"name": "rm"}}, {"jsonrpc": "2.0", "id": 8, "method": "dance"},
        {"jsonrpc": "2.0", "id": 9, "method": "tools/call", "params": {"name": "read_session", "arguments": {"session": "spring", "limit": 2}}},
    ]
    out = io.BytesIO()
    rpc.serve(server, io.BytesIO(b"".join(x if isinstance(x, bytes) else json.dumps(x).encode() + b"\n" for x in asks)), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x.get("error", {}).get("code") for x in got] == [-32700, -32600, -32002, -32602, None, None, None, None, -32602, -32601, None]
    assert len(got[5]["result"]["tools"]) == 3 and got[6]["result"]["structuredContent"]["items"][0]["session_id"] == "spring"
    assert got[7]["result"]["isError"] and got[10]["result"]["structuredContent"]["next_offset"] == 2
    with pytest.raises(ValueError, match="1 MiB"):
        rpc.serve(server, io.BytesIO(b" " * (rpc.MAX_REQUEST + 2)), out)
    with pytest.raises(ValueError):
        recall.tool_call(server.events(), "search_sessions", {"limit": "3"})


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(lines("spring", "cut the roses", "all cut"))
    (tmp_path / "in" / "b.jsonl").write_text(lines("autumn", "cut the roses", "all cut", "and swept"))
    state = ["--state-dir", str(tmp_path / "state")]

    def run(*args, typed=""):
        out = io.StringIO()
        status = cli.run([*state, *args], out, io.StringIO(typed))
        return status, out.getvalue()

    assert run("import", "--harness", "codex", "--path", str(tmp_path / "in"))[0] == 0
    assert json.loads(run("status")[1])["records"] == 7
    assert len(run("discover", "--harness", "codex", "--path", str(tmp_path / "in"))[1].splitlines()) == 2
    assert [json.loads(x)["session_id"] for x in run("sessions", "--format", "jsonl")[1].splitlines()] == ["autumn", "spring"]
    assert "cut the roses" in run("query", "--session", "spring", "--text", "cut the")[1]
    assert run("export", "--session", "spring", "--output", str(tmp_path / "out"))[0] == 0
    assert len(run("query", "--archive", str(tmp_path / "out"), "--format", "jsonl")[1].splitlines()) == 3
    dry = json.loads(run("compare", "--oracle-session", "spring", "--candidate-session", "autumn", "--output", str(tmp_path / "cmp"), "--dry-run")[1])
    assert len(dry["alignment"]) == 3 and not (tmp_path / "cmp").exists()
    assert run("snapshot", "--session", "spring", "--output", str(tmp_path / "base"))[0] == 0
    assert run("check", "--session", "autumn", "--baseline", str(tmp_path / "base"), "--output", str(tmp_path / "chk"))[0] == 2
    assert run("label", "--session", "spring", "--task", "t", "--reward", "1", "--reviewer", "kim", "--note", "n", "--oracle")[0] == 0
    assert json.loads(run("labels")[1])["current"]
    assert run("evaluate", "--session", "autumn", "--task", "t", "--output", str(tmp_path / "ev"), "--max-extra-steps", "2", "--max-missing-steps", "2", "--max-changed-steps", "2")[0] == 0
    said = run("browse", "--pair-output", str(tmp_path / "pair.json"), typed="list CUT\noracle 1\ncandidate 2\nshow 9\nsave\nsave\nquit\n")[1]
    assert "2 sessions; oracle autumn, candidate spring" in said and said.count("error:") == 2
    assert json.loads((tmp_path / "pair.json").read_text())["oracle_session"] == "autumn"
    assert run("compact")[0] == 0
    with pytest.raises(ValueError, match="no such session"):
        run("snapshot", "--session", "winter", "--output", str(tmp_path / "b2"))


def test_strict_times(spark):
    rows = ["2025-01-01T00:00:00Z", "2025-01-01T00:00:00.5+01:00", "2025-01-01t00:00:00z", "2025-02-30T00:00:00Z", "2025-01-01T24:00:00Z", "2025-01-01", None]
    df = spark.createDataFrame([(x,) for x in rows], "t string")
    assert [r.ok for r in df.select(X.valid_timestamp("t").alias("ok")).collect()] == [True, True, False, False, False, False, False]


def test_hook_flag_needs_a_string_at_the_top(spark):
    rows = ['{"hook_event_name":"x"}', '{"hook_event_name":7}', '{"a":{"hook_event_name":"x"}}', "[]", "broken", None]
    df = spark.createDataFrame([("codex", x) for x in rows], "harness string, payload_json string")
    assert [r.is_hook for r in transcripts.with_hook_flag(df).collect()] == [True, False, False, False, False, False]


def test_search_preview_is_of_the_first_message(spark):
    rows = [("pi", "s", "a", k, 0, kind, text) for k, (kind, text) in enumerate([("metadata", "m"), ("message", ""), ("message", "x" * 150), ("message", "later")])]
    events = spark.createDataFrame(rows, "harness string, session_id string, source_id string, position long, sub_index long, kind string, text string")
    assert Q.search_sessions(events, "LATER").first().preview == "x" * 100

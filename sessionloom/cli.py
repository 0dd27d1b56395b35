"""The command line: capture, read, compare, label, check and keep archives of sessions."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as C
from .functions.columns import terminal_safe
from .functions.files import save
from .functions.payloads import loads
from .operators import archive as A
from .operators import baseline as B
from .operators import human as H
from .operators import maintenance as K
from .operators import query as Q
from .operators import remote as N
from .operators import runs as R
from .operators.assessment import calibrate, calibration_pairs
from .operators.evaluation import SCORES, Evidence, evaluate
from .operators.models import HttpModel
from .operators.plan import plan
from .operators.policy import MATCHING, Criteria, Gates, HumanGates, need, only
from .sources import discover as D
from .sources import hooks
from .sources.normalize import ADAPTERS
from .sources.transcripts import with_hook_flag

PAIR = ("oracle_session", "oracle_harness", "oracle_archive", "oracle_remote", "candidate_session", "candidate_harness", "candidate_archive", "candidate_remote", "archive", "remote")
#: Commands that change the collector's archive; one process at a time runs them.
WRITERS = ("import", "watch", "sync", "compact")


def session(name: str = "sessionloom") -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def read_json(path: str):
    with open(path, "rb") as f:
        return loads(f.read())


def _read_args(p: argparse.ArgumentParser, filters: bool = True) -> None:
    where = p.add_mutually_exclusive_group()
    where.add_argument("--archive")
    where.add_argument("--remote")
    for name in ("harness", "session", *(("since", "until", "kind", "text") if filters else ())):
        p.add_argument(f"--{name}")


def _run_args(p: argparse.ArgumentParser) -> None:
    _read_args(p, filters=False)
    p.add_argument("--leaf")
    p.add_argument("--final-output")


def _policy_args(p: argparse.ArgumentParser, matching: str | None = None) -> None:
    p.add_argument("--matching", choices=MATCHING, default=matching)
    p.add_argument("--criteria")


def _gate_args(p: argparse.ArgumentParser) -> None:
    for name, default in (("max-missing-steps", 0), ("max-extra-steps", 0), ("max-changed-steps", 0)):
        p.add_argument(f"--{name}", type=int, default=default)
    for name in ("min-quality", "min-required-coverage", "min-tool-correctness", "min-progress", "max-repetition-ratio"):
        p.add_argument(f"--{name}", type=float)
    p.add_argument("--require-outcome", action="store_true")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sessionloom")
    top.add_argument("--config")
    top.add_argument("--state-dir")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, what: str) -> argparse.ArgumentParser:
        return commands.add_parser(name, help=what, description=what)

    for name, what in (("discover", "list transcripts"), ("import", "store what is there now"), ("watch", "keep storing")):
        p = add(name, what)
        p.add_argument("--harness", choices=sorted(ADAPTERS))
        p.add_argument("--path", action="append", default=[])
        p.add_argument("--project")
    add("sync", "upload what remotes lack").add_argument("--remote")
    add("status", "the archive in numbers")
    add("compact", "merge small batches")
    for name in ("sessions", "query"):
        p = add(name, f"read {name} of an archive")
        _read_args(p)
        p.add_argument("--format", choices=("text", "jsonl"), default="text")
    p = add("export", "write what is selected as an archive of its own")
    _read_args(p)
    p.add_argument("--output", required=True)
    p = add("compare", "align a candidate with a reference and have it judged")
    for name in PAIR[:-2]:
        p.add_argument(f"--{name.replace('_', '-')}")
    for name in ("pair", "oracle-leaf", "candidate-leaf", "oracle-output", "candidate-output"):
        p.add_argument(f"--{name}")
    p.add_argument("--output", required=True)
    p.add_argument("--dry-run", action="store_true")
    _policy_args(p)
    p = add("snapshot", "accept a run as a reference")
    _run_args(p)
    _policy_args(p, "strict")
    p.add_argument("--output", required=True)
    p.add_argument("--append", action="store_true")
    p = add("check", "check a run against accepted ones; ends with 2 if it fails")
    _run_args(p)
    _gate_args(p)
    p.add_argument("--baseline", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--judge", action="store_true")
    p = add("label", "record what a person says of a run or a step")
    _run_args(p)
    for name in ("task", "reviewer", "note"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--reward", type=int, choices=(0, 1), required=True)
    p.add_argument("--step", type=int)
    for name in ("oracle", "replace", "synthetic"):
        p.add_argument(f"--{name}", action="store_true")
    p = add("labels", "list labels")
    p.add_argument("--task")
    p.add_argument("--history", action="store_true")
    p = add("evaluate", "hold a run against accepted ones and people's labels; ends with 2 if it fails")
    _run_args(p)
    _gate_args(p)
    _policy_args(p)
    p.add_argument("--task", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--oracle-label", action="append", default=[])
    for name in ("judge", "require-human-label", "allow-synthetic"):
        p.add_argument(f"--{name}", action="store_true")
    for name in ("min-human-quality", "min-human-coverage"):
        p.add_argument(f"--{name}", type=float)
    p = add("calibrate", "compare judged steps with people's labels")
    p.add_argument("--labels", required=True)
    p.add_argument("--output")
    p = add("browse", "look at sessions and choose a pair")
    _read_args(p)
    p.add_argument("--pair-output", default="pair.json")
    add("mcp", "serve the recall tools on standard input and output").add_argument("--archive")
    p = add("hooks", "hooks of an editor")
    p.add_argument("action", choices=("install", "uninstall", "receive"))
    p.add_argument("--hooks-file", default=os.path.expanduser("~/.cursor/hooks.json"))
    p.add_argument("--program", default=sys.argv[0])
    p.add_argument("--spool")
    return top


def _uri(path: str) -> str:
    return path if "://" in path else f"file://{os.path.abspath(path)}"


def events_of(spark: SparkSession, config: C.Config, archive: str | None, remote: str | None, harness: str | None = None, session_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, events with ``is_hook``) from an archive, a remote, or the collector's own.

    An archive may be a root of batches or one exported batch.
    """
    if remote:
        root = N.cached(spark, N.connect(spark, config.remote(remote)), _uri(f"{config.state_dir}/cache/{remote}"), harness, session_id)
    else:
        root = _uri(archive or config.archive)
        parent, _, name = root.rstrip("/").rpartition("/")
        if archive and A.exists(spark, f"{root}/manifest.json"):
            A.manifest(spark, root)
            records, events = A._tables(spark, parent, [name])
            return records, with_hook_flag(events)
    records, events = A.open_archive(spark, root, harness, session_id)
    return records, with_hook_flag(events)


def one_run(spark: SparkSession, config: C.Config, archive, remote, harness, session_id, leaf, output) -> dict:
    """One session as a run."""
    need(bool(session_id), "name a session")
    q = Q.Query(harness=harness, session=session_id)
    events = Q.select_events(events_of(spark, config, archive, remote, harness, session_id)[1], q)
    found = [(r["harness"], r["session_id"]) for r in events.select(*Q.SESSION).distinct().limit(2).collect()]
    need(len(found) == 1, "no such session" if not found else "several harnesses have a session of that id; name one")
    leaves = spark.createDataFrame([(*found[0], leaf)], "harness string, session_id string, leaf string") if leaf else None
    need(not leaf or found[0][0] == "pi", "only sessions whose entries form a tree have leaves")
    given = None
    if output:
        with open(output, encoding="utf-8") as f:
            given = spark.createDataFrame([(*found[0], f.read())], "harness string, session_id string, final_output string")
    return R.document(R.trajectories(events, leaves, given), *found[0])


def _run(spark, config, a) -> dict:
    return one_run(spark, config, a.archive, a.remote, a.harness, a.session, a.leaf, a.final_output)


def _policy(config: C.Config, a):
    own = config.policy
    if a.matching:
        own = replace(own, matching=a.matching)
    if a.criteria:
        own = replace(own, criteria=Criteria.read(read_json(a.criteria)))
    return own


def _gates(a) -> Gates:
    return Gates(**{n: getattr(a, n) for n in Gates.__dataclass_fields__}).checked()


def _models(config: C.Config, policy):
    need(policy.judge is not None and policy.reporter is not None, "the configuration names no judge and reporter")
    return HttpModel(policy.judge), HttpModel(policy.reporter)


def text_lines(events: DataFrame) -> Iterator[str]:
    """Events for a reader, one after the other; at most a partition is on the driver."""
    shown = terminal_safe(F.coalesce("text", "payload_json"))
    head = F.concat_ws(" ", F.coalesce("timestamp", F.lit("-")), "harness", "session_id", "id", "kind", "role")
    return (r["line"] for r in events.select(F.concat_ws("\n", terminal_safe(head), shown).alias("line")).toLocalIterator())


def json_lines(rows: DataFrame) -> Iterator[str]:
    return (r["line"] for r in rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line")).toLocalIterator())


def _query(a) -> Q.Query:
    return Q.Query(harness=a.harness, session=a.session, kind=a.kind, since=a.since, until=a.until, text=a.text).checked()


def compare(spark: SparkSession, config: C.Config, a, out) -> int:
    own = {n: getattr(a, n, None) for n in PAIR}
    if a.pair:
        need(not a.oracle_session and not a.candidate_session, "give a pair's file or two sessions")
        own |= only(read_json(a.pair), PAIR, "a pair")
    side = lambda s: one_run(spark, config, own.get(f"{s}_archive") or own.get("archive"), own.get(f"{s}_remote") or own.get("remote"), own.get(f"{s}_harness"), own.get(f"{s}_session"), getattr(a, f"{s}_leaf"), getattr(a, f"{s}_output"))
    docs = [side("oracle"), side("candidate")]
    runs = R.from_documents(spark, list({d["trajectory_id"]: d for d in docs}.values()))
    pairs = spark.createDataFrame([("p", *(d["trajectory_id"] for d in docs))], "pair string, oracle string, candidate string")
    p = plan(pairs, runs, _policy(config, a))
    if a.dry_run:
        rows = p.alignment.orderBy("candidate_step").collect()  # the steps of one run
        out.write(json.dumps({"alignment": [{k: r[k] for k in ("candidate_step", "oracle_step", "similarity")} for r in rows], "diagnostics": p.diagnostics.drop("pair").first().asDict(recursive=True)}) + "\n")
        return 0
    judge, reporter = _models(config, p.policy)
    row = evaluate(Evidence(p, runs.events), _uri(a.output), judge, reporter, p.policy.judge.model).first()
    save(f"{a.output}/report.md", row["report"].encode())
    out.write(json.dumps({k: v for k, v in row.asDict(recursive=True).items() if k != "report"}) + "\n")
    return 0


def calibration(spark: SparkSession, a, out) -> int:
    rows = [only(x, ("evaluation", "candidate_step", "human_reward"), "a label") for x in read_json(a.labels)]
    labels = spark.createDataFrame([(x["evaluation"], x["candidate_step"], x["human_reward"]) for x in rows], "evaluation string, candidate_step long, human_reward int")
    scores = None
    for folder in sorted({x["evaluation"] for x in rows}):
        own = spark.read.schema(SCORES).parquet(f"{_uri(folder)}/scores").withColumn("evaluation", F.lit(folder))
        scores = own if scores is None else scores.unionByName(own)
    need(scores is not None, "there are no labels")
    found = [r.asDict() for r in calibrate(calibration_pairs(labels, scores)).collect()]
    value = {"overall": next(r for r in found if r["judge"] is None), "by_judge": {r["judge"]: r for r in found if r["judge"] is not None}, "note": "agreement with these labels alone; use examples that are held out and typical"}
    if a.output:
        save(a.output, json.dumps(value).encode())
    out.write(json.dumps(value) + "\n")
    return 0


def run(argv: list[str], out=None, lines=None) -> int:
    """The command's exit status: 0, or 2 where a check fails."""
    a, out, lines = parser().parse_args(argv), out or sys.stdout, lines or sys.stdin
    config = C.load(a.config, a.state_dir)
    if a.command == "hooks":
        spool = a.spool or f"{config.state_dir}/hooks"
        if a.action == "receive":
            hooks.receive(spool, sys.stdin.buffer.read() if lines is sys.stdin else lines.read().encode())
        elif a.action == "install":
            hooks.install(a.hooks_file, a.program, spool)
        else:
            hooks.uninstall(a.hooks_file)
        return 0
    if a.command in ("discover", "import", "watch"):
        chosen = [a.harness] if a.harness else sorted(ADAPTERS)
        places = D.roots(chosen, [(s.harness, s.path) for s in config.sources], a.path, f"{config.state_dir}/hooks")
        if a.command == "discover":
            for source in D.discover(places, a.project, D.Identities(f"{config.state_dir}/identities.json")):
                out.write(json.dumps(source, sort_keys=True) + "\n")
            return 0
    if a.command == "labels":
        registry = H.load(f"{config.state_dir}/human")
        now = {x["id"] for x in H.current(registry)}
        for x in registry:
            if (a.history or x["id"] in now) and (a.task is None or x["task"] == a.task):
                out.write(json.dumps({k: v for k, v in x.items() if k != "trajectory"} | {"current": x["id"] in now}) + "\n")
        return 0
    spark = session()
    if a.command in WRITERS:
        from .functions.files import Folder

        with Folder(config.state_dir).locked("collector"):
            return _write(spark, config, a, out, places if a.command in ("import", "watch") else [])
    return _read(spark, config, a, out, lines)


def _write(spark: SparkSession, config: C.Config, a, out, places) -> int:
    from .streaming import tail

    root = _uri(config.archive)
    if a.command == "compact":
        out.write(json.dumps({"merged": K.compact_all(spark, root, "local", config.compact_max_bytes)}) + "\n")
        return 0
    if a.command == "sync":
        for r in config.remotes if a.remote is None else [config.remote(a.remote)]:
            out.write(json.dumps({"remote": r.name, "uploaded": N.sync(spark, root, r.name, N.connect(spark, r))}) + "\n")
        return 0
    if a.project:
        own = [(h, [s["path"] for s in D.discover([(h, p)], a.project)]) for h, p in places]
        places = [(h, p) for h, p in own if p]
    K.remove_temporaries(spark, root)
    if a.command == "import":
        tail.capture(spark, places, root, config.state_dir)
    else:
        there = [(h, own) for h, p in places if (own := [x for x in p if os.path.exists(x)])]
        uploads = (lambda: [N.sync(spark, root, r.name, N.connect(spark, r)) for r in config.remotes]) if config.remotes else None
        tail.watch_all(spark, there, root, config.state_dir, flush_seconds=config.flush_seconds, compact_seconds=config.compact_seconds, compact_bytes=config.compact_max_bytes, upload=uploads)
    out.write(json.dumps(K.status(spark, root, [r.name for r in config.remotes])) + "\n")
    return 0


def _read(spark: SparkSession, config: C.Config, a, out, lines) -> int:
    if a.command == "status":
        out.write(json.dumps(K.status(spark, _uri(config.archive), [r.name for r in config.remotes])) + "\n")
        return 0
    if a.command in ("sessions", "query", "export", "browse"):
        q = _query(a)
        records, events = events_of(spark, config, a.archive, a.remote, a.harness, a.session)
        if a.command == "export":
            chosen = Q.export(records, events, q)
            parent, _, name = _uri(a.output).rpartition("/")
            need(not A.exists(spark, _uri(a.output)), "the output is there already")
            A.write_batch(*chosen, parent, "export", name=name)
            return 0
        if a.command == "browse":
            from .browse import Browser

            Browser(Q.select_events(events, q), a.pair_output, {k: v for k, v in (("archive", a.archive), ("remote", a.remote)) if v}).run(lines, out)
            return 0
        rows = Q.summaries(records, events, q).orderBy(*Q.SESSION) if a.command == "sessions" else Q.select_events(events, q).orderBy(*Q.ORDER).drop("is_hook")
        if a.format == "text" and a.command == "sessions":
            shown = rows.select(terminal_safe(F.concat_ws(" ", "harness", "session_id", F.concat("records", F.lit(" records")), F.concat("events", F.lit(" events")), "first_timestamp", "last_timestamp")).alias("line"))
            made = (r["line"] for r in shown.toLocalIterator())
        else:
            made = text_lines(rows) if a.format == "text" else json_lines(rows)
        for line in made:
            out.write(line + "\n")
        return 0
    if a.command == "mcp":
        from .rpc import Server, serve

        serve(Server(lambda: events_of(spark, config, a.archive, None)[1]), sys.stdin.buffer, sys.stdout.buffer)
        return 0
    if a.command == "compare":
        return compare(spark, config, a, out)
    if a.command == "calibrate":
        return calibration(spark, a, out)
    doc = _run(spark, config, a)
    if a.command == "label":
        label = H.annotate(f"{config.state_dir}/human", doc, a.task, a.reward, a.reviewer, a.note, a.step, "synthetic" if a.synthetic else "human", a.oracle, a.replace)
        out.write(json.dumps({k: v for k, v in label.items() if k != "trajectory"}) + "\n")
        return 0
    if a.command == "snapshot":
        made = B.snapshot(a.output, doc, _policy(config, a), a.append)
        out.write(json.dumps({"variants": [v["id"] for v in made["variants"]]}) + "\n")
        return 0
    if a.command == "check":
        stored = B.load(a.baseline)
        from .operators.policy import Policy

        models = _models(config, Policy.read(stored["policy"])) if a.judge else None
        result = B.check(spark, stored, doc, _gates(a), a.output, models)
    else:
        human = HumanGates(a.require_human_label, a.min_human_quality, a.min_human_coverage, a.allow_synthetic)
        options = H.Options(a.task, _policy(config, a), _gates(a), human, tuple(a.oracle_label))
        result = H.evaluate(spark, H.load(f"{config.state_dir}/human"), doc, options, a.output, _models(config, options.policy) if a.judge else None)
    out.write(json.dumps({"passed": result["passed"]}) + "\n")
    return 0 if result["passed"] else 2


def main() -> None:
    try:
        sys.exit(run(sys.argv[1:]))
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        sys.exit(1)


if __name__ == "__main__":
    main()

"""A small archive service: batches are registered, filled, committed, and only then listed.

Files lie in a folder, metadata in a SQLite file beside them.  One owner's token
guards all; archives are kept apart by their ids.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import re
import sqlite3
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, unquote, urlsplit

from .functions.payloads import dumps, loads

ID = re.compile(r"[A-Za-z0-9_-]{1,128}")
TIME = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})")
SHA = re.compile(r"[0-9a-f]{64}")
PAGE, MAX_MANIFEST, MAX_LIST, MAX_NUMBER, MAX_PATH = 100, 1 << 20, 10000, (1 << 53) - 1, 900


class Refused(Exception):
    def __init__(self, status: int, why: str):
        super().__init__(why)
        self.status = status


def require(ok, status: int, why: str) -> None:
    if not ok:
        raise Refused(status, why)


def canonical(value) -> str:
    """JSON with the fields of every object in order, so that equal manifests are equal texts."""
    return dumps(value)


def _count(n) -> bool:
    return type(n) is int and 0 <= n <= MAX_NUMBER


def _path_ok(p) -> bool:
    return isinstance(p, str) and len(p) < MAX_PATH and p.startswith(("records/", "events/")) and "\\" not in p and all(x not in ("", ".", "..") for x in p.split("/"))


def validate(m) -> dict:
    """A manifest that may be registered; an empty list of replaced batches is as none."""
    require(isinstance(m, dict), 400, "a manifest is an object")
    named = all(isinstance(m.get(k), str) and ID.fullmatch(m[k]) for k in ("collector_id", "batch_id"))
    require(m.get("schema_version") == 1 and named, 400, "the manifest has another version, or ids that may not be paths")
    require(isinstance(m.get("created_at"), str) and TIME.fullmatch(m["created_at"]), 400, "the manifest has no time of creation")
    files = m.get("files")
    require(isinstance(files, list) and 1 <= len(files) <= MAX_LIST, 400, "the manifest lists no files, or too many")
    ok = all(isinstance(f, dict) and _path_ok(f.get("path")) and _count(f.get("size")) and isinstance(f.get("sha256"), str) and SHA.fullmatch(f["sha256"]) for f in files)
    require(ok and len({f["path"] for f in files}) == len(files), 400, "a listed file is out of order")
    require({f["path"].split("/")[0] for f in files} == {"records", "events"}, 400, "a table has no files")
    sessions = m.get("sessions")
    fine = isinstance(sessions, list) and len(sessions) <= MAX_LIST and all(isinstance(s, dict) and isinstance(s.get("harness"), str) and isinstance(s.get("session_id"), str) and len(s["session_id"]) <= 1024 and _count(s.get("records")) and _count(s.get("events")) for s in sessions)
    require(fine, 400, "a session is out of order")
    gone = m.get("replaces") or []
    require(isinstance(gone, list) and len(gone) <= MAX_LIST and all(isinstance(r, str) and ID.fullmatch(r) and r != m["batch_id"] for r in gone) and len(set(gone)) == len(gone), 400, "the replaced batches are out of order")
    return {**m, "replaces": gone}


class Archive:
    """One archive's metadata and files."""

    def __init__(self, root: Path, name: str):
        self.files = root / name
        self.files.mkdir(parents=True, exist_ok=True)
        self.lock = threading.Lock()
        self.db = sqlite3.connect(root / f"{name}.sqlite", check_same_thread=False, isolation_level=None)
        self.db.executescript(
            "create table if not exists batch(key text primary key, manifest text not null, committed integer not null default 0);"
            "create table if not exists file(batch text, path text, primary key(batch, path));"
            "create table if not exists session(batch text, harness text, id text, summary text, primary key(batch, harness, id));"
        )

    def row(self, key: str) -> tuple[dict, bool]:
        found = self.db.execute("select manifest, committed from batch where key = ?", (key,)).fetchone()
        require(found, 404, "there is no such batch")
        return json.loads(found[0]), bool(found[1])

    def listed(self, after: str) -> dict:
        rows = self.db.execute("select key, manifest from batch where committed = 1 and key > ? order by key limit ?", (after, PAGE + 1)).fetchall()
        return {"batches": [json.loads(m) for _, m in rows[:PAGE]], "next": rows[PAGE - 1][0] if len(rows) > PAGE else None}

    def sessions(self, after: str) -> dict:
        """Sessions of committed batches, a row for each batch that has them, by cursor."""
        rows = self.db.execute(
            "with s as (select s.batch || ':' || hex(s.harness) || ':' || hex(s.id) as cursor, s.summary from session s join batch b on b.key = s.batch where b.committed = 1)"
            " select cursor, summary from s where cursor > ? order by cursor limit ?", (after, PAGE + 1),
        ).fetchall()
        return {"sessions": [json.loads(x) for _, x in rows[:PAGE]], "next": rows[PAGE - 1][0] if len(rows) > PAGE else None}

    def register(self, key: str, raw: bytes) -> tuple[int, dict]:
        try:
            m = validate(loads(raw))
        except ValueError:
            raise Refused(400, "the manifest is no JSON") from None
        require(f"{m['collector_id']}/{m['batch_id']}" == key, 409, "the manifest is of another batch")
        with self.lock:
            old = self.db.execute("select manifest, committed from batch where key = ?", (key,)).fetchone()
            if old:
                require(old[0] == canonical(m), 409, "another batch has that id")
                return 200, {"committed": bool(old[1])}
            self.db.execute("insert into batch(key, manifest) values(?, ?)", (key, canonical(m)))
            return 201, {"committed": False}

    def entry(self, key: str, path: str) -> tuple[dict, bool]:
        m, committed = self.row(key)
        found = next((f for f in m["files"] if f["path"] == path), None)
        require(found, 404, "no such file is registered")
        return found, committed

    def put(self, key: str, path: str, length: int, body) -> dict:
        entry, committed = self.entry(key, path)
        require(length == entry["size"], 400, "the file has another length than the manifest says")
        tmp, final = self.files / f".{uuid.uuid4().hex}", self.files / key / path
        digest, left = hashlib.sha256(), length
        try:
            with open(tmp, "wb") as out:
                while left and (block := body.read(min(left, 1 << 20))):
                    digest.update(block)
                    out.write(block)
                    left -= len(block)
            require(not left and digest.hexdigest() == entry["sha256"], 409 if final.exists() else 400, "the file isn't what the manifest says")
            if not final.exists():
                require(not committed, 409, "a committed batch lacks a file")
                final.parent.mkdir(parents=True, exist_ok=True)
                os.replace(tmp, final)
        finally:
            tmp.unlink(missing_ok=True)
        self.db.execute("insert or ignore into file values(?, ?)", (key, path))
        return {"uploaded": True}

    def commit(self, key: str) -> dict:
        with self.lock:
            m, committed = self.row(key)
            if not committed:
                have = {p for (p,) in self.db.execute("select path from file where batch = ?", (key,))}
                require(have == {f["path"] for f in m["files"]}, 409, "files of the batch are missing")
                self.db.execute("begin")
                self.db.executemany("insert or ignore into session values(?, ?, ?, ?)", [(key, s["harness"], s["session_id"], canonical(s)) for s in m["sessions"]])
                self.db.execute("update batch set committed = 1 where key = ?", (key,))
                self.db.execute("commit")
        return {"committed": True}


def server(root: str, token: str, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server of the archives below ``root``; call ``serve_forever`` on a thread."""
    require(token, 503, "a service needs a token")
    base, archives, guard = Path(root), {}, threading.Lock()
    base.mkdir(parents=True, exist_ok=True)
    expected = hashlib.sha256(f"Bearer {token}".encode()).digest()

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *args) -> None:
            pass

        def answer(self, status: int, value) -> None:
            raw = json.dumps(value).encode()
            self.send_response(status)
            self.send_header("content-type", "application/json")
            self.send_header("content-length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def route(self) -> None:
            self.close_connection = True
            try:
                given = hashlib.sha256(self.headers.get("authorization", "").encode()).digest()
                require(hmac.compare_digest(given, expected), 401, "not allowed")
                url = urlsplit(self.path)
                parts = [unquote(p) for p in url.path.split("/") if p]
                require(parts[:2] == ["v1", "archives"] and len(parts) > 3 and ID.fullmatch(parts[2]), 404, "there is no such place")
                with guard:
                    if parts[2] not in archives:
                        archives[parts[2]] = Archive(base, parts[2])
                    archive = archives[parts[2]]
                after = parse_qs(url.query).get("after", [""])[0]
                length = int(self.headers.get("content-length") or 0)
                place = (self.command, parts[3], len(parts))
                if place == ("GET", "batches", 4):
                    return self.answer(200, archive.listed(after))
                if place == ("GET", "sessions", 4):
                    return self.answer(200, archive.sessions(after))
                require(parts[3] == "batches" and len(parts) > 5 and all(ID.fullmatch(p) for p in parts[4:6]), 404, "there is no such place")
                key, rest = "/".join(parts[4:6]), parts[6:]
                if self.command == "PUT" and not rest:
                    require(length <= MAX_MANIFEST, 413, "the manifest is too large")
                    return self.answer(*archive.register(key, self.rfile.read(length)))
                if self.command == "POST" and rest == ["commit"]:
                    return self.answer(200, archive.commit(key))
                require(len(rest) > 1 and rest[0] == "files" and self.command in ("GET", "PUT"), 404, "there is no such place")
                path = "/".join(rest[1:])
                require(_path_ok(path), 400, "that path may not be")
                if self.command == "PUT":
                    return self.answer(200, archive.put(key, path, length, self.rfile))
                entry, committed = archive.entry(key, path)
                require(committed, 404, "the batch isn't committed")
                self.send_response(200)
                self.send_header("content-length", str(entry["size"]))
                self.end_headers()
                with open(archive.files / key / path, "rb") as f:
                    while block := f.read(1 << 20):
                        self.wfile.write(block)
            except Refused as e:
                self.answer(e.status, {"error": str(e)})

        do_GET = do_PUT = do_POST = route

    return ThreadingHTTPServer((host, port), Handler)

"""Which files of this machine are transcripts, of which sessions."""

from __future__ import annotations

import itertools
import json
import logging
import os
import time
from collections.abc import Iterable
from pathlib import Path

from ..functions.files import save
from . import normalize

log = logging.getLogger(__name__)
SUFFIXES = (".jsonl", ".ndjson")
HEAD_LINES = 32
#: A change may hide in a coarse clock for so long after it was made.
SETTLED_SECONDS = 2.0


def default_roots(harness: str, home: str | None = None, env: dict | None = None) -> list[str]:
    """Where each harness keeps its transcripts: fixed places, which the first two let a variable move."""
    at, env = Path(home or Path.home()), os.environ if env is None else env
    if harness == "codex":
        base = Path(env.get("CODEX_HOME") or at / ".codex")
        return [str(base / "sessions"), str(base / "archived_sessions")]
    if harness == "pi":
        return [env.get("PI_CODING_AGENT_SESSION_DIR") or str(at / ".pi" / "agent" / "sessions")]
    if harness == "cursor":
        return [str(at / ".cursor" / "projects")]
    raise ValueError(f"no harness is called {harness!r}")


def candidates(roots: Iterable[str]) -> list[str]:
    """Regular transcript files below the roots, each once, in order; links aren't followed."""
    found = set()
    for root in roots:
        base = root.removeprefix("file://")
        if os.path.isfile(base) and base.endswith(SUFFIXES) and not os.path.islink(base):
            found.add(base)
        for at, _, names in os.walk(base):
            found |= {path for n in names if n.endswith(SUFFIXES) and not os.path.islink(path := os.path.join(at, n)) and os.path.isfile(path)}
    return sorted(found)


def head(path: str) -> bytes:
    """The first lines of a file, whole however long they are."""
    with open(path, "rb") as f:
        return b"".join(itertools.islice(f, HEAD_LINES))


def identify(harness: str, path: str) -> dict | None:
    """The source a file is, or None (with a note in the log) if it has no header of the format."""
    try:
        source = normalize.identify(harness, path, head(path))
    except OSError as e:
        log.warning("%s can't be read: %s", path, e.strerror)
        return None
    if source is None:
        log.warning("%s has no header of %s in its first %d lines; it is left for later", path, harness, HEAD_LINES)
    return source


def settled(changed: float, checked: float) -> bool:
    """Whether a file looked at then can't have changed since without a new time."""
    return checked - changed > SETTLED_SECONDS


class Identities:
    """Sources of files that haven't changed since they were identified; kept as JSON between runs."""

    def __init__(self, path: str | None = None):
        self.path = Path(path) if path else None
        self.known: dict[str, list] = json.loads(self.path.read_text()) if self.path and self.path.exists() else {}

    def identify(self, harness: str, path: str) -> dict | None:
        s = os.stat(path)
        signature = f"{s.st_dev}:{s.st_ino}:{s.st_size}:{s.st_mtime_ns}"
        saved = self.known.get(path)
        if saved and saved[0] == signature and settled(s.st_mtime, saved[1]) and saved[2] and saved[2]["harness"] == harness:
            return saved[2]
        source = identify(harness, path)
        self.known[path] = [signature, time.time(), source]
        return source

    def save(self) -> None:
        if self.path:
            save(self.path, json.dumps(self.known, sort_keys=True).encode())


def roots(harnesses: Iterable[str], configured: Iterable[tuple[str, str]] = (), given: Iterable[str] = (), spool: str | None = None, home: str | None = None) -> list[tuple[str, list[str]]]:
    """The roots of each harness: given ones before configured before default ones, and the hook spool beside those of ``cursor``."""
    given, configured, out = list(given), list(configured), []
    chosen = list(harnesses)
    if given and len(chosen) != 1:
        raise ValueError("paths are given for one harness; name it")
    for name in chosen:
        own = given or [p for h, p in configured if h == name] or default_roots(name, home)
        out.append((name, own + ([spool] if spool and name == "cursor" else [])))
    return out


def matches_project(source: dict, path: str, project: str | None) -> bool:
    """Whether a source's working directory or its file's path holds the text."""
    return project is None or project in (source.get("project") or "") or project in path


def discover(places: list[tuple[str, list[str]]], project: str | None = None, identities: Identities | None = None) -> list[dict]:
    """Sources below the places, with their ``path``; files without a header are left out and noted."""
    known, out = identities or Identities(), []
    for harness, own in places:
        for path in candidates(own):
            source = known.identify(harness, path)
            if source and matches_project(source, path, project):
                out.append(source | {"path": path})
    known.save()
    return out

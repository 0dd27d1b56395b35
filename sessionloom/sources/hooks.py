"""Hook documents: spooled as one line each, beside the bytes as they came."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from pathlib import Path

from ..functions.files import save
from ..functions.payloads import loads

#: The moments an editor reports.
MOMENTS = ("sessionStart", "sessionEnd", "postToolUse", "postToolUseFailure")
OWNED = ".sessionloom-hooks.json"


def receive(spool: str, raw: bytes) -> str:
    """Spool one document (it may be printed over several lines) and return its path.

    The line appears only after the raw bytes are safe, so a reader that sees it
    finds them.
    """
    value = loads(raw)
    if not isinstance(value, dict) or not isinstance(value.get("conversation_id"), str) or not isinstance(value.get("hook_event_name"), str):
        raise ValueError("a hook document has a conversation_id and a hook_event_name")
    folder = Path(spool.removeprefix("file://")) / hashlib.sha256(value["conversation_id"].encode()).hexdigest()
    name = uuid.uuid4().hex
    save(folder / f"{name}.stdin", raw)
    line = json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass") + b"\n"
    save(folder / f"{name}.jsonl", line)
    return str(folder / f"{name}.jsonl")


def raw_input(path: str) -> bytes | None:
    """The bytes a spooled line was made of, if they are beside it."""
    try:
        return Path(path).with_suffix(".stdin").read_bytes()
    except FileNotFoundError:
        return None


def shell_quote(text: str) -> str:
    """A word that a shell takes as it is."""
    return "'" + text.replace("'", "'\\''") + "'"


def _entry(command: str) -> dict:
    return {"command": command, "timeout": 5, "failClosed": False}


def _without(config: dict, entry: dict) -> dict:
    hooks = config.get("hooks") or {}
    if any(not isinstance(v, list) for v in hooks.values()):
        raise ValueError("each hook of a configuration must be a list")
    return config | {"hooks": {k: [x for x in v if x != entry] for k, v in hooks.items()}}


def install(config: str, program: str, spool: str) -> dict:
    """Add the receiver to an editor's hook configuration; other entries stay, and a second time changes nothing."""
    path, owned = Path(config), Path(config).parent / OWNED
    if not os.path.isfile(program):
        raise ValueError("the receiving program isn't there")
    value = loads(path.read_bytes()) if path.exists() else {"version": 1, "hooks": {}}
    if not isinstance(value, dict) or value.get("version", 1) != 1 or not isinstance(value.get("hooks", {}), dict):
        raise ValueError("the hook configuration isn't of a known version")
    if owned.exists():
        value = _without(value, loads(owned.read_bytes()))
    entry = _entry(f"{shell_quote(program)} hooks receive --spool {shell_quote(spool)}")
    value = _without(value | {"version": 1}, entry)
    for moment in MOMENTS:
        value["hooks"][moment] = [*value["hooks"].get(moment, []), entry]
    save(owned, json.dumps(entry).encode())
    save(path, json.dumps(value, indent=2).encode())
    return value


def uninstall(config: str) -> None:
    """Take away what :func:`install` added, and nothing else."""
    path, owned = Path(config), Path(config).parent / OWNED
    if not owned.exists():
        return
    if path.exists():
        save(path, json.dumps(_without(loads(path.read_bytes()), loads(owned.read_bytes())), indent=2).encode())
    owned.unlink()

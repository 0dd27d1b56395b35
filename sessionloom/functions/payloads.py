"""Strict JSON and the keys that compare steps; used inside Arrow-batched functions."""

from __future__ import annotations

import json
from typing import Any

#: Fields of a result that differ between runs of the same work.
VOLATILE = frozenset("id call_id tool_use_id toolCallId session_id conversation_id generation_id timestamp timestamp_ms parentId".split())
#: Fields of a call whose strings say nothing about what it does.
UNSEARCHED = frozenset("id call_id toolCallId tool_use_id timestamp type role".split())


def loads(raw: bytes | str) -> Any:
    """JSON as the standard has it: no NaN, no Infinity, nothing after the value, valid UTF-8."""

    def refuse(name: str) -> Any:
        raise ValueError(f"{name} is not JSON")

    return json.loads(raw.decode("utf-8") if isinstance(raw, bytes) else raw, parse_constant=refuse)


def dumps(value: Any) -> str:
    """Compact JSON with sorted keys."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def string(value: Any, *keys: str) -> str | None:
    """The first of the fields that is a string; other types don't count."""
    if isinstance(value, dict):
        for key in keys:
            if isinstance(value.get(key), str):
                return value[key]
    return None


def _first_present(value: dict, *keys: str) -> Any:
    """What the first of the fields that is there holds, be it null; null if none is."""
    return next((value[k] for k in keys if k in value), None)


def tool_parts(payload: Any) -> tuple[Any, Any] | None:
    """Name and arguments of a tool call, whichever of the known shapes it has."""
    if not isinstance(payload, dict):
        return None
    if "name" in payload or "tool_name" in payload:
        arguments = _first_present(payload, "arguments", "input", "tool_input")
        if isinstance(arguments, str):
            try:
                arguments = loads(arguments)
            except ValueError:
                pass
        return _first_present(payload, "name", "tool_name"), arguments
    call = payload.get("tool_call")
    if isinstance(call, dict) and len(call) == 1:
        ((name, body),) = call.items()
        return name, body.get("args") if isinstance(body, dict) else None
    return None


def result_content(payload: Any) -> Any:
    """What a tool gave back: the first field present, even if it holds null."""
    if not isinstance(payload, dict):
        return None
    fields = ("output", "content", "result", "tool_output", "error_message")
    if any(k in payload for k in fields):
        return _first_present(payload, *fields)
    call = payload.get("tool_call")
    return {k: v["result"] for k, v in call.items() if isinstance(v, dict) and "result" in v} if isinstance(call, dict) else None


def _read(payload_json: str | None) -> Any:
    try:
        return loads(payload_json or "null")
    except ValueError:
        return None


def action_key(kind: str, role: str | None, text: str | None, payload_json: str | None) -> str:
    """Canonical JSON of what a step does, for equality between runs."""
    payload = _read(payload_json)
    if kind == "tool_call":
        parts = tool_parts(payload)
        return dumps({"kind": kind, "payload": payload, "text": text} if parts is None else {"kind": kind, "name": parts[0], "arguments": parts[1]})
    own = {"kind": kind, "role": role, "text": text}
    return dumps(own if text is not None else {**own, "payload": payload})


def evidence_key(action: str, results: list[tuple[str | None, str | None]]) -> str:
    """Canonical JSON of a step's action and of what its results (text, payload) say, less what differs between runs anyway."""
    said = []
    for text, payload_json in results:
        payload = _read(payload_json)
        if isinstance(payload, dict):
            payload = {k: v for k, v in payload.items() if k not in VOLATILE}
        said.append({"text": text, "payload": payload})
    return dumps({"action": action, "results": said})


def strings(value: Any) -> list[str]:
    """Every string in a JSON value, but for those under fields that only name or place it."""
    if isinstance(value, str):
        return [value]
    inner = value if isinstance(value, list) else [v for k, v in value.items() if k not in UNSEARCHED] if isinstance(value, dict) else []
    return [s for x in inner for s in strings(x)]


def searchable(events: list[tuple[str, str | None, str | None]]) -> str:
    """What a step's events (kind, text, payload) can be found by: texts, and the strings of calls."""
    parts = []
    for kind, text, payload_json in events:
        parts += [text] if text is not None else []
        parts += strings(_read(payload_json)) if kind == "tool_call" else []
    return "\n".join(parts)


def judgment(raw: str) -> tuple[int, str]:
    """A judge's reply: exactly a 0/1 reward and a rationale that says something."""
    value = loads(raw)
    if not isinstance(value, dict) or not {"reward", "rationale"} <= set(value) <= {"reward", "rationale", "provider_response"}:
        raise ValueError("a judgment has a reward and a rationale, and nothing else")
    reward, rationale = value["reward"], value["rationale"]
    if type(reward) is not int or reward not in (0, 1):
        raise ValueError("the reward must be 0 or 1")
    if not isinstance(rationale, str) or not rationale.strip():
        raise ValueError("the rationale must say something")
    return reward, rationale

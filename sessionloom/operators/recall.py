"""What an assistant asks of the archive: search sessions, read one, get an event.

Answers are dictionaries of a bounded size: at most 100 items and 1 MiB of JSON,
an item above 256 KiB being replaced by a stub with a preview.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import query as Q

MAX_ITEM, MAX_ANSWER, PREVIEW = 256 << 10, 1 << 20, 4096


def _answer(rows: DataFrame, order: tuple[str, ...], offset: int, limit: int) -> dict:
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1..100 and offset not negative")
    total, items, used = rows.count(), [], 0
    whole = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    page = rows.orderBy(*order).offset(offset).limit(limit).withColumn("_json", whole).withColumn("_bytes", F.octet_length("_json"))
    # the stub is made where the row is, so a large item never reaches the driver
    text = F.substring(F.coalesce("text", F.lit("")), 1, PREVIEW) if "text" in rows.columns else F.substring("_json", 1, PREVIEW)
    keys = [c for c in ("id", "harness", "session_id", "kind") if c in rows.columns]
    stub = F.to_json(F.struct(*keys, F.lit(True).alias("truncated"), F.col("_bytes").alias("original_json_bytes"), text.alias("text_preview")))
    shown = page.select(*order, F.when(F.col("_bytes") > MAX_ITEM, stub).otherwise(F.col("_json")).alias("_item")).orderBy(*order)
    import json

    for r in shown.collect():
        size = len(r["_item"].encode())
        if used + size > MAX_ANSWER:
            break
        used += size
        items.append(json.loads(r["_item"]))
    after = offset + len(items)
    return {"items": items, "total": total, "next_offset": after if after < total else None}


def search_sessions(events: DataFrame, text: str = "", harness: str | None = None, session: str | None = None, offset: int = 0, limit: int = 20) -> dict:
    """Sessions with a match, with their number of events and a preview."""
    chosen = Q.select_events(events, Q.Query(harness=harness, session=session))
    return _answer(Q.search_sessions(chosen, text), Q.SESSION, offset, limit)


def read_session(events: DataFrame, session: str, text: str = "", harness: str | None = None, offset: int = 0, limit: int = 20) -> dict:
    """Events of one session in order; a session id of several harnesses needs the harness."""
    if harness is None and not Q.ambiguous_sessions(events.where(F.col("session_id") == F.lit(session))).isEmpty():
        raise ValueError("the session id is ambiguous; give the harness")
    chosen = Q.select_events(events, Q.Query(harness=harness, session=session, text=text or None))
    return _answer(chosen, Q.ORDER, offset, limit)


def get_event(events: DataFrame, event_id: str, order: str | None = None) -> dict:
    """The first event of that id: in batch order where that is known."""
    order = order or ("batch_ord" if "batch_ord" in events.columns else "source_id")
    return _answer(Q.find_event(events, event_id, order), ("id",), 0, 1)


#: What each tool does, and which arguments it needs.
TOOLS = {
    "search_sessions": ("Find archived sessions by text, harness or id.", []),
    "read_session": ("Read the events of one archived session; name the harness if several have the id.", ["session"]),
    "get_event": ("Get one archived event by its id.", ["event_id"]),
}
_ARGUMENTS = {"text": str, "harness": str, "session": str, "event_id": str, "offset": int, "limit": int}


def tool_call(events: DataFrame, name: str, arguments: dict) -> dict:
    """One tool by name; unknown tools and arguments, and ones of a wrong type, are errors."""
    if name not in TOOLS:
        raise ValueError(f"no tool is called {name!r}")
    if not isinstance(arguments, dict) or set(arguments) - set(_ARGUMENTS):
        raise ValueError(f"arguments are {', '.join(_ARGUMENTS)}")
    own = {k: v for k, v in arguments.items() if v is not None}
    if any(type(v) is not _ARGUMENTS[k] for k, v in own.items()):
        raise ValueError("an argument has a wrong type")
    missing = [k for k in TOOLS[name][1] if k not in own]
    if missing:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    page = {k: own[k] for k in ("offset", "limit") if k in own}
    chosen = {k: own[k] for k in ("text", "harness", "session") if k in own}
    if name == "search_sessions":
        out = search_sessions(events, **chosen, **page)
    elif name == "read_session":
        out = read_session(events, **chosen, **page)
    else:
        where = Q.Query(harness=own.get("harness"), session=own.get("session"))
        out = get_event(events.where(where.on_events()), own["event_id"])
    return out | {"source": "archived events; what waits to be stored isn't among them"}

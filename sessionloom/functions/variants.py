"""Payloads as Variant columns: parsed once, in the JVM, and read by expressions.

The rules are those of ``payloads``, which works on one value in Python.  As text,
an object's fields are sorted and numbers are equal if their values are (1.0 and
1 are).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields of a call, and of a result, in the order in which they count.
NAMES, ARGUMENTS = ("name", "tool_name"), ("arguments", "input", "tool_input")
CONTENTS = ("output", "content", "result", "tool_output", "error_message")


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict(raw: Column | str) -> Column:
    """JSON text as a Variant; null if it isn't JSON, or something follows the value.

    The parser ends with the first value.  As the one element of an array and
    the one field of an object it can't be followed by anything.
    """
    raw = column(raw)
    listed, held = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"v":'), raw, F.lit("}")))
    alone = held.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(alone, F.try_variant_get(listed, "$[0]", "variant"))


def field(value: Column, *names: str) -> Column:
    """What the first of the fields that is there holds, be it JSON null; null if none is, or the value is no object."""
    return F.coalesce(*(F.try_variant_get(value, f"$.{name}", "variant") for name in names))


def is_string(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def entries(value: Column) -> Column:
    """An object as a map; null if the value isn't one."""
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value.try_cast("map<string,variant>"))


def tool_name(payload: Column) -> Column:
    """The tool that a call names, in any known shape, as a Variant; null if it has none."""
    call = entries(field(payload, "tool_call"))
    own = F.when(F.size(call) == 1, F.map_keys(call)[0])
    tagged = F.try_parse_json(F.to_json(F.array(own)))
    return F.coalesce(field(payload, *NAMES), F.when(own.isNotNull(), F.try_variant_get(tagged, "$[0]", "variant")))


def tool_arguments(payload: Column) -> Column:
    """What a call gives its tool; a string that holds JSON counts as what it holds."""
    given = field(payload, *ARGUMENTS)
    named = F.when(is_string(given), F.coalesce(strict(given.try_cast("string")), given)).otherwise(given)
    call = entries(field(payload, "tool_call"))
    return F.when(field(payload, *NAMES).isNotNull(), named).otherwise(F.when(F.size(call) == 1, field(F.map_values(call)[0], "args")))


def result_content(payload: Column) -> Column:
    """What a tool gave back, as text with sorted fields; null if it gave nothing or null."""
    given = field(payload, *CONTENTS)
    own = F.map_filter(F.transform_values(entries(field(payload, "tool_call")), lambda _, v: field(v, "result")), lambda _, v: v.isNotNull())
    return F.when(given.isNull(), F.to_json(own)).otherwise(F.when(~F.is_variant_null(given), F.to_json(given)))


def _text(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(x) for x, c in sorted(fields.items()))), {"ignoreNullFields": "false"})


def action_key(kind: Column | str, role: Column | str, text: Column | str, payload_json: Column | str) -> Column:
    """Text of what an event does, for equality between runs: a call's tool and arguments, else what is said, else the payload."""
    kind, role, text = column(kind), column(role), column(text)
    payload = strict(payload_json)
    name = tool_name(payload)
    call = F.when(name.isNotNull(), _text(kind=kind, name=name, arguments=tool_arguments(payload))).otherwise(_text(kind=kind, payload=payload, text=text))
    said = F.when(text.isNotNull(), _text(kind=kind, role=role, text=text)).otherwise(_text(kind=kind, role=role, text=text, payload=payload))
    return F.when(kind == "tool_call", call).otherwise(said)

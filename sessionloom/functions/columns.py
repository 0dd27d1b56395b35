"""Scalar functions as native columns."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RFC 3339 as manifests have it, with capital letters alone; whether the day exists is for the parser to say.
STRICT3339 = r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$"
#: RFC 3339 as transcripts may have it.
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt]([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stable_id(*parts: Column | str) -> Column:
    """Lower hex SHA-256 of the compact JSON array of the parts as strings."""
    return F.sha2(F.to_json(F.array(*(_col(p).cast("string") for p in parts))), 256)


def instant(text: Column | str) -> Column:
    """The timestamp of an RFC 3339 string, null for anything else."""
    c = _col(text)
    return F.when(c.rlike(RFC3339), F.try_to_timestamp(F.upper(c)))


def canonical_time(when: Column) -> Column:
    """UTC with three digits of fraction and ``Z`` (finer ones cut off), so that text order is time order."""
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def valid_id(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(r"^[A-Za-z0-9_-]{1,128}$"), F.lit(False))


def valid_timestamp(c: Column | str) -> Column:
    return instant(F.when(_col(c).rlike(STRICT3339), _col(c))).isNotNull()


def safe_relative(c: Column | str) -> Column:
    """A path below the archive: no backslash, no root, no empty, ``.`` or ``..`` parts."""
    p = _col(c)
    plain = F.forall(F.split(p, "/"), lambda x: ~x.isin("", ".", ".."))
    return F.coalesce(plain & ~F.contains(p, F.lit("\\")), F.lit(False))


def ratio(n: Column | str, d: Column | str) -> Column:
    """A share, null where there is nothing to share."""
    return F.try_divide(_col(n).cast("double"), _col(d).cast("double"))


def terminal_safe(c: Column | str) -> Column:
    """Control characters but for newline and tab as ``\\u{..}`` escapes."""
    out = _col(c)
    for code in [*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x0D, *range(0x7F, 0xA0)]:
        out = F.replace(out, F.lit(chr(code)), F.lit("\\u{%x}" % code))
    return out


def parse_bound(text: str) -> str:
    """An RFC 3339 bound in canonical form, sub-millisecond digits cut off."""
    import re

    if not re.match(RFC3339, text):
        raise ValueError(f"not an RFC 3339 time: {text!r}")
    body, fraction = re.match(r"(.{19})(?:\.(\d+))?", text).groups()
    zone = text[19 + (len(fraction) + 1 if fraction else 0) :]
    when = datetime.strptime(body.upper(), "%Y-%m-%dT%H:%M:%S").replace(microsecond=int(((fraction or "") + "000000")[:6]), tzinfo=timezone.utc)
    if zone not in "Zz":
        hours, minutes = zone[1:].split(":")
        when -= timedelta(hours=int(hours), minutes=int(minutes)) * (1 if zone[0] == "+" else -1)
    return when.strftime("%Y-%m-%dT%H:%M:%S.") + f"{when.microsecond // 1000:03d}Z"

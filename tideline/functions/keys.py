"""Model keys and event-type names as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = "([0-9a-f]{8}){0}([0-9a-f]{4}){0}([0-9a-f]{4}){0}([0-9a-f]{4}){0}([0-9a-f]{12})"
_DASHED, _PLAIN = _PARTS.replace("{0}", "-"), _PARTS.replace("{0}", "")
_FORMS = "^(?:" + "|".join([_DASHED, _PLAIN, r"\{" + _DASHED + r"\}", r"\(" + _DASHED + r"\)"]) + ")$"
_CANONICAL = "-".join("".join(f"${5 * form + part}" for form in range(4)) for part in range(1, 6))


def guid(text: Column) -> Column:
    """Canonical lower-case 8-4-4-4-12 form of a GUID in N, D, B or P form; null if it is none or all zeros."""
    dashed = F.regexp_replace(F.lower(F.trim(text)), _FORMS, _CANONICAL)
    return F.nullif(F.regexp_extract(dashed, "^(?!0{8}-0{4}-0{4}-0{4}-0{12})[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", 0), F.lit(""))


def number(text: Column) -> Column:
    """A whole-number key in a text; null if it is none."""
    return F.when(text.rlike(r"^[0-9]{1,18}$"), text.cast("long"))


def key_from_stream(stream_id: Column, parse=guid) -> Column:
    """Key after the first `-` of a stream id; the rest must be a key as a whole."""
    at = F.instr(stream_id, "-")
    return F.when(at > 0, parse(F.substring(stream_id, at + 1, F.length(stream_id))))


def key_from_subject(subject: Column, segment: int = -1, parse=guid) -> Column:
    """Key in a segment of a `/` path: segments are trimmed and empty ones dropped; a negative number is the last."""
    parts = F.filter(F.transform(F.split(subject, "/"), lambda x: F.trim(x)), lambda x: x != "")
    return parse(F.get(parts, F.size(parts) - 1) if segment < 0 else F.get(parts, F.lit(segment)))


def key_from_attribute(event_type: Column, keys: dict[str, Column], parse=guid) -> Column:
    """Key in the property that an event type declares; types without one have no key."""
    out = F.lit(None)
    for name, column in keys.items():
        out = F.when(event_type == name, parse(column.cast("string"))).otherwise(out)
    return out


def type_name(text: Column) -> Column:
    """Last segment of a dotted type name; the whole text if it ends in a dot."""
    last = F.substring_index(text, ".", -1)
    return F.when(last == "", text).otherwise(last)


def known_type(text: Column, names: Sequence[str]) -> Column:
    """Registered name that equals the text but for case (of several, the first); null if unknown."""
    first: dict[str, str] = {}
    for n in names:
        first.setdefault(n.lower(), n)
    out = F.lit(None).cast("string")
    for low, n in first.items():
        out = F.when(F.lower(text) == low, F.lit(n)).otherwise(out)
    return out


def without_bom(text: Column) -> Column:
    """A text without a byte-order mark at its start."""
    return F.regexp_replace(text, "^﻿", "")

"""Identifiers, lenient JSON and query routing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import strip

# The modes, and the phrases that make a question a global one.
MODES = ("auto", "naive", "local", "global")
GLOBAL_HINTS = [
    "overall", "overview", "main", "main theme", "themes", "trend", "roadmap", "summary", "summarize",
    "contribution areas", "contribution opportunities", "opportunities",
    "主要方向", "整体", "总结", "趋势", "共性", "值得贡献",
]


def route(question: Column, requested: str = "auto") -> Column:
    """The mode of a question: the requested one, or global by its hints, else local."""
    if requested not in MODES:
        raise ValueError(f"no such mode: {requested}")
    if requested != "auto":
        return F.lit(requested)
    asked = F.lower(F.coalesce(question, F.lit("")))
    hit = F.exists(F.array(*map(F.lit, GLOBAL_HINTS)), lambda h: F.contains(asked, h))
    return F.when(hit, "global").otherwise("local")


def point_id(kind: Column, source_id: Column) -> Column:
    """UUID version 5 of 'kind:source_id' in the URL namespace; empty parts are an error."""
    bad = F.coalesce(kind, F.lit("")).eqNullSafe("") | F.coalesce(source_id, F.lit("")).eqNullSafe("")
    name = F.concat(F.lit(bytearray(uuid.NAMESPACE_URL.bytes)), F.concat_ws(":", kind, source_id).cast("binary"))
    h = F.sha1(name)
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    out = F.concat(h.substr(1, 8), F.lit("-"), h.substr(9, 4), F.lit("-5"), h.substr(14, 3), F.lit("-"), variant, h.substr(18, 3), F.lit("-"), h.substr(21, 12))
    return F.when(bad, F.raise_error(F.lit("kind and source_id must not be empty"))).otherwise(out)


def json_object(raw: Column) -> Column:
    """The JSON object in a model's answer, as text: a fenced block's body, else all of it, else from the
    first { to the last }; null if nothing parses."""
    t = strip(raw)
    fenced = F.regexp_like(t, F.lit(r"(?is)```(?:json)?\s*.*?\s*```"))
    body = F.when(fenced, F.regexp_extract(t, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)).otherwise(t)
    braces = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    # a value is complete if every key and value of it can be read as JSON text
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull() & (c != ""), c)
    return F.coalesce(ok(body), ok(braces))

"""Parsing of model replies and judge verdicts, and validation of tool arguments."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocabularies import DIMENSIONS
from .jsonscan import first_value

REPLY = "kind string, name string, args string, text string, citations array<string>, violation string"


def _text(value: str) -> str:
    """Escapes of half a character can't be stored."""
    return value.encode("utf-8", "replace").decode()


def _read(reply: str | None) -> dict:
    out: dict = {"kind": "violation", "name": None, "args": None, "text": None, "citations": None, "violation": None}
    found, value = first_value(reply or "")
    if not found or not isinstance(value, dict):
        return out | {"violation": "unparseable_json"}
    asked, final = "tool" in value, "final" in value
    if not asked and not final:
        return out | {"violation": "unknown_top_level_key"}
    name, args = value.get("tool"), value.get("args", {})
    if asked and (final or not isinstance(name, str) or not name.strip() or not isinstance(args, dict)):
        return out | {"violation": "wrong_value_type"}
    if asked:
        return out | {"kind": "tool", "name": _text(name.strip()), "args": json.dumps(args, sort_keys=True)}
    if not isinstance(value["final"], str):
        return out | {"violation": "wrong_value_type"}
    text, cited = _text(value["final"]), value.get("citations")
    if "citations" not in value:
        return out | {"text": text, "violation": "missing_citations_key"}
    if not isinstance(cited, list) or not all(isinstance(c, str) for c in cited):
        return out | {"text": text, "violation": "citations_wrong_type"}
    return out | {"kind": "final", "text": text, "citations": [*map(_text, cited)]}


def parse_reply(reply: Column) -> Column:
    """Tool call, final answer or typed violation of each reply: of the whole text, fence removed, or of the first balanced object that is JSON."""

    @F.pandas_udf(REPLY)
    def parse(replies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_read(r) for r in replies], columns=[f.split()[0] for f in REPLY.split(", ")])

    return parse(reply)


def strict_json(text: Column) -> Column:
    """The one JSON value that a text is, null for any other text; the parser alone would pass over what follows a value."""
    return F.when(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1, F.try_parse_json(text))


def violation(parsed: Column, finish_reason: Column) -> Column:
    """A reply that was cut off is truncated, whatever else is wrong with it."""
    return F.when(parsed["violation"].isNotNull(), F.when(finish_reason == "length", "truncated").otherwise(parsed["violation"]))


def verdict_defect(reply: Column, most_spans: int = 4, span_chars: int = 240) -> Column:
    """Why a judge's verdict can't be used, null if it can: exact keys, whole scores from 1 to 5, short evidence. A repeated key is no JSON here."""
    v, keys = strict_json(reply), F.json_object_keys(reply)
    wanted = [*DIMENSIONS, "overall", "evidence", "rationale"]
    scores = [F.try_variant_get(v, f"$.{d}", "double") for d in [*DIMENSIONS, "overall"]]
    bad = F.lit(False)
    for s in scores:
        bad = bad | F.coalesce(~s.between(1, 5) | (s != F.floor(s)), F.lit(True))
    spans = F.try_variant_get(v, "$.evidence", "array<string>")
    return (
        F.when(v.isNull(), "not JSON").when(keys.isNull(), "not an object").when(F.array_sort(keys) != F.array_sort(F.array(*map(F.lit, wanted))), "wrong keys").when(bad, "score out of range")
        .when(spans.isNull(), "evidence is no list").when(F.size(spans) > most_spans, "too many spans").when(F.exists(spans, lambda x: F.length(x) > span_chars), "span too long")
    )


def argument_error(args: Column, required: dict[str, str], optional: dict[str, str] | None = None) -> Column:
    """Tool arguments against types by name (string, bigint, double, boolean): what is wrong first, null if nothing. A boolean is no number."""
    v = strict_json(args)
    keys = F.when(v.isNotNull(), F.json_object_keys(args))
    known = required | (optional or {})
    kinds = {"string": ["STRING"], "bigint": ["BIGINT"], "double": ["BIGINT", "DOUBLE"], "boolean": ["BOOLEAN"]}
    missing = F.size(F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), keys)) > 0
    unknown = F.size(F.array_except(keys, F.array(*map(F.lit, known)).cast("array<string>"))) > 0
    mistyped = F.lit(False)
    for name, kind in known.items():
        own = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        fits = F.lit(False)
        for k in kinds[kind]:
            fits = fits | own.startswith(k) | ((F.lit(k) == "DOUBLE") & own.startswith("DECIMAL"))
        mistyped = mistyped | (F.array_contains(keys, name) & ~F.coalesce(fits, F.lit(False)))
    return F.when(keys.isNull(), "schema_invalid").when(missing, "missing_arg").when(unknown, "schema_invalid").when(F.coalesce(mistyped, F.lit(False)), "bad_arg_type")

"""JSON in free text: balanced objects from left to right, and keys that an object repeats at any depth."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What matters to balance: whole string literals (the last one may lack its end), and braces outside of them.
_PARTS = re.compile(r'"(?:[^"\\]++|\\.)*+"?|[{}]', re.DOTALL)
PROBLEMS = "code string, repeated array<string>"


def objects(text: str) -> Iterator[str]:
    """The balanced stretches {...} of a text; the next one begins after the end of the one before, and what is inside one isn't looked at again."""
    begin = text.find("{")
    while begin >= 0:
        open_braces = 0
        for part in _PARTS.finditer(text, begin):
            open_braces += {"{": 1, "}": -1}.get(part[0], 0)
            if not open_braces:
                yield text[begin : part.end()]
                begin = text.find("{", part.end())
                break
        else:
            return


def loaded(text: str):
    """(True, value) of a text that is one JSON value, else (False, None)."""
    try:
        return True, json.loads(text)
    except (ValueError, RecursionError):
        return False, None


def without_fence(text: str) -> str:
    """What a code fence around the whole text holds; other texts as they are."""
    whole = text.strip()
    info, line, body = whole[3:].partition("\n")
    return body[:-3] if whole.startswith("```") and line and "`" not in info and body.endswith("```") else text


def first_value(text: str):
    """The value of a text that is JSON, with or without a fence, else of its first balanced object that is; (False, None) if there is none."""
    inner = without_fence(text)
    found = loaded(inner)
    tried = objects(inner)
    while not found[0]:
        part = next(tried, None)
        if part is None:
            return found
        found = loaded(part)
    return found


def _problem(line: str | None) -> tuple[str | None, list[str] | None]:
    if line is None or not line.strip():
        return "blank_line", None
    repeated: list[str] = []

    def noted(pairs: list[tuple]) -> dict:
        made = dict(pairs)
        if len(made) < len(pairs):
            left = dict.fromkeys(made, 1)
            for key, _ in pairs:
                if not left[key]:
                    repeated.append(key.encode("utf-8", "replace").decode())
                left[key] = 0
        return made

    try:
        value = json.loads(line, object_pairs_hook=noted)
    except (ValueError, RecursionError):
        return "not_json", None
    if not isinstance(value, dict):
        return "not_object", None
    return ("duplicate_key", repeated) if repeated else (None, None)


def line_problem(line: Column) -> Column:
    """code (blank_line, not_json, not_object, duplicate_key; null if all is well) and the keys repeated, innermost objects first, once for each repetition."""

    @F.pandas_udf(PROBLEMS)
    def problem(lines: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_problem(x) for x in lines], columns=["code", "repeated"])

    return problem(line)

"""JSON in replies and lines of datasets."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evalgrove.functions import jsonscan, replies
from evalgrove.operators import lint


def plain_objects(text):
    """The same, a character at a time."""
    out, i = [], text.find("{")
    while i >= 0:
        depth, quoted, k = 0, False, i
        while k < len(text):
            c = text[k]
            if quoted:
                k += c == "\\"
                quoted = c != '"'
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    break
            k += 1
        if k >= len(text):
            break
        out.append(text[i : k + 1])
        i = text.find("{", k + 1)
    return out


def test_objects_match_a_plain_scan():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice('{}"\\a,:[] \n') for _ in range(rng.randrange(40)))
        assert list(jsonscan.objects(text)) == plain_objects(text), text


def test_long_texts_are_scanned_in_linear_time():
    assert jsonscan.first_value("{" * 200_000) == (False, None)
    assert jsonscan.first_value('"' + "\\" * 400_001 + "{") == (False, None)
    assert jsonscan.first_value("[" * 200_000)[0] is False
    assert jsonscan.first_value('x {"a": "' + "b" * 500_000 + '"}')[0]


@pytest.mark.parametrize("text, found", [
    ('```\n{"a": 1}\n```', {"a": 1}), ('```json\n{"a": 1}```  ', {"a": 1}), ('see ```json\n{"a": 1}\n```', {"a": 1}), ("```{}```", {}), ('{"a": NaN', None), ('{"a": [{}]', None), ("{} {}", {}), ('{bad {"a": 1}} {"a": 2}', {"a": 2}), ("", None), ("17", 17),
])
def test_first_value(text, found):
    assert jsonscan.first_value(text) == (found is not None, found)


def test_replies_with_odd_characters(spark):
    rows = spark.createDataFrame([(1, '{"final": "\\ud800 x", "citations": ["\\udfff"]}'), (2, None), (3, '{"tool": "k\\n", "args": {"b": 1, "a": {"c": null}}}')], "i int, t string")
    got = {r["i"]: r["r"] for r in rows.select("i", replies.parse_reply(F.col("t")).alias("r")).collect()}
    assert (got[1]["text"], got[1]["citations"]) == ("? x", ["?"]) and got[2]["violation"] == "unparseable_json"
    assert (got[3]["name"], got[3]["args"]) == ("k", '{"a": {"c": null}, "b": 1}')


def test_repeated_keys_at_any_depth(spark):
    lines = {
        1: '{"a": 1, "b": 2}', 2: '{"a": 1, "a": {"a": 2}}', 3: '{"o": {"x": [{"y": 1, "y": 2, "y": 3}], "x": 1}}', 4: "[]", 5: '{"a": }', 6: "  ", 7: None, 8: "[" * 100_000, 9: '{"\\ud800": 1, "\\ud800": 2}',
        10: '{"a": "\\"a\\": 1", "A": 2}',
    }
    rows = spark.createDataFrame(list(lines.items()), "i int, line string")
    got = sorted((r["i"], r["code"], r["key"]) for r in lint.json_problems(rows, ["i"], F.col("line")).collect())
    assert got == [(2, "duplicate_key", "a"), (3, "duplicate_key", "x"), (3, "duplicate_key", "y"), (3, "duplicate_key", "y"), (4, "not_object", None), (5, "not_json", None), (6, "blank_line", None), (7, "blank_line", None), (8, "not_json", None), (9, "duplicate_key", "?")]
    assert json.loads(lines[10])["A"] == 2

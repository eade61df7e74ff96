"""Differing spans against the standard library's matcher."""

import difflib
import random
import time

import pytest

from evalgrove.functions import textdiff


def plain(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False)


@pytest.mark.parametrize("vocabulary", [1, 2, 3, 8, 100])
def test_runs_and_spans_match_the_library(vocabulary):
    rng = random.Random(vocabulary)
    for _ in range(400):
        a, b = ([f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(25))] for _ in range(2))
        if rng.random() < 0.5:  # an edited copy
            b = [w for w in a if rng.random() < 0.9]
            b[rng.randrange(len(b) + 1) : 0] = ["new", "words"]
        assert textdiff.matching_runs(a, b) == [tuple(m) for m in plain(a, b).get_matching_blocks() if m.size], (a, b)
        assert textdiff.differing_spans(" ".join(a), " ".join(b)) == sum(op != "equal" for op, *_ in plain(a, b).get_opcodes())


def test_long_texts_take_little_time():
    rng = random.Random(1)
    a = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    edited = [w if rng.random() < 0.98 else "x" for w in a]
    began = time.process_time()
    assert 200 < textdiff.differing_spans(" ".join(a), " ".join(edited)) < 500
    assert time.process_time() - began < 3
    every_other = [w if i % 2 else f"n{i}" for i, w in enumerate(a)]
    assert textdiff.differing_spans(" ".join(a), " ".join(every_other)) > 1
    assert textdiff.matching_runs(a[:600], every_other[:600]) == [tuple(m) for m in plain(a[:600], every_other[:600]).get_matching_blocks() if m.size]
    assert textdiff.differing_spans(" ".join(["the"] * 20_000), " ".join(["the"] * 19_000)) == 1
    assert time.process_time() - began < 20


def test_nothing_and_nulls():
    assert textdiff.differing_spans(None, None) == 0 and textdiff.differing_spans("", "a b") == 1 and textdiff.differing_spans("a b", None) == 1 and textdiff.differing_spans("a b", " a  b ") == 0

"""Chains of segments: list ranking by doubling, errors, branches."""

import random

import pytest
from pyspark.sql import functions as F

from evalgrove.operators import conversations


def plain_chains(links):
    back, named = dict(links), {p for _, p in links if p}
    out = []
    for tip in back:
        if tip in named:
            continue
        way, at = [], tip
        while at is not None and at in back and at not in way:
            way.append(at)
            at = back[at]
        if at is None:
            out += [(tip, m, i) for i, m in enumerate(way)]
    return sorted(out)


def test_chains_match_a_plain_walk(spark):
    rng = random.Random(2)
    links = [(f"r{i}", f"r{rng.randrange(i)}" if i and rng.random() < 0.9 else None) for i in range(300)]  # a forest with branches
    links += [("lost", "nowhere"), ("on-lost", "lost"), ("loop-a", "loop-b"), ("loop-b", "loop-a"), ("on-loop", "loop-a"), ("alone", None)]
    segments = spark.createDataFrame(links, "run_id string, previous_run_id string")
    assert sorted(map(tuple, conversations.chains(segments, strict=False).collect())) == plain_chains(links)
    assert {r["run_id"]: r["reason"] for r in conversations.broken_chains(segments).collect()} == {"lost": "missing segment", "on-lost": "missing segment", "loop-a": "loop", "loop-b": "loop", "on-loop": "loop"}
    with pytest.raises(ValueError, match="loop"):
        conversations.chains(segments)
    assert conversations.chains(segments.where("false")).count() == 0


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds, plain = [], conversations._twice
    monkeypatch.setattr(conversations, "_twice", lambda jump: rounds.append(1) or plain(jump))
    n = 10_000
    segments = spark.range(n).select(F.col("id").cast("string").alias("run_id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("previous_run_id"), F.lit(2).alias("n_turns"))
    found = conversations.chain_turns(segments).collect()
    assert [tuple(r) for r in found] == [(str(n - 1), n, 2 * n)] and len(rounds) == 14

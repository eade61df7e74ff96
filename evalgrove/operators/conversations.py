"""Conversations that span segments: tips, chains, transcripts, memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import shared_dir


def tips(segments: DataFrame) -> DataFrame:
    """Segments that no other continues."""
    return segments.join(segments.select(F.col("previous_run_id").alias("run_id")).where("run_id is not null"), "run_id", "left_anti")


def missing_links(segments: DataFrame) -> DataFrame:
    """Segments whose predecessor isn't there."""
    known = segments.select(F.col("run_id").alias("previous_run_id"))
    return segments.where("previous_run_id is not null").join(known, "previous_run_id", "left_anti")


def _twice(jump: DataFrame) -> DataFrame:
    """run_id and the segment twice as far back, where there is one."""
    further = jump.select(F.col("run_id").alias("at"), F.col("at").alias("further"))
    return jump.join(further, "at").select("run_id", F.col("further").alias("at")).checkpoint()


def broken_chains(segments: DataFrame) -> DataFrame:
    """run_id and reason of segments whose way back ends at a segment that isn't there, or never ends.

    Ways are doubled each round, so there are about as many rounds as the logarithm of the number of segments.
    """
    shared_dir(segments.sparkSession)  # rounds are checkpointed there
    links = segments.select("run_id", "previous_run_id")
    there = links.select(F.col("run_id").alias("previous_run_id"), F.lit(True).alias("there"))
    way = links.join(there, "previous_run_id", "left").select("run_id", F.when(F.col("there"), F.col("previous_run_id")).alias("at"), (F.col("previous_run_id").isNotNull() & F.col("there").isNull()).alias("lost")).checkpoint()
    for _ in range(links.count().bit_length() + 1):
        if not way.where("at is not null").limit(1).count():
            break
        further = way.select(F.col("run_id").alias("at"), F.col("at").alias("further"), F.col("lost").alias("further_lost"))
        way = way.join(further, "at", "left").select("run_id", F.col("further").alias("at"), (F.col("lost") | F.coalesce("further_lost", F.lit(False))).alias("lost")).checkpoint()
    return way.where("lost or at is not null").select("run_id", F.when(F.col("lost"), "missing segment").otherwise("loop").alias("reason"))


def chains(segments: DataFrame, strict: bool = True) -> DataFrame:
    """run_id (a tip), member, depth: each tip's segments back to its beginning.

    A way back that ends at a missing segment, or in a loop, is an error; unless strict, such tips are left out (broken_chains() tells why).
    Each round doubles what a tip has reached: from its members so far, as far back again as the round's jumps go. A chain of L
    segments takes as many rounds as L has binary digits; what is written is the result once, and each segment's jump once a round.
    """
    links = segments.select("run_id", "previous_run_id")
    broken = broken_chains(links)
    if strict:
        wrong = broken.orderBy("reason", "run_id").limit(1).collect()
        if wrong:
            raise ValueError(f"{wrong[0]['reason']} behind {wrong[0]['run_id']}")
    out = tips(links).join(broken, "run_id", "left_anti").select("run_id", F.col("run_id").alias("member"), F.lit(0).alias("depth")).checkpoint()
    jump = links.where("previous_run_id is not null").join(broken, "run_id", "left_anti").select("run_id", F.col("previous_run_id").alias("at")).checkpoint()
    span = 1
    while True:
        further = jump.select(F.col("run_id").alias("member"), "at")
        reached = out.join(further, "member").select("run_id", F.col("at").alias("member"), (F.col("depth") + span).alias("depth")).checkpoint()
        if not reached.limit(1).count():
            return out
        out, span, jump = out.unionByName(reached), 2 * span, _twice(jump)


def chain_turns(segments: DataFrame, strict: bool = True) -> DataFrame:
    """Segments and turns of each tip's whole chain."""
    turns = segments.select(F.col("run_id").alias("member"), "n_turns")
    return chains(segments, strict).join(turns, "member").groupBy("run_id").agg(F.count("*").alias("n_segments"), F.sum("n_turns").alias("total_turns"))


def conversations(rows: DataFrame) -> DataFrame:
    """run_id, item_id, n_rows and first_seq of each conversation, in order of first sight by first_seq; rows without an item belong to none."""
    return rows.where("item_id is not null").groupBy("run_id", "item_id").agg(F.count("*").alias("n_rows"), F.min("seq").alias("first_seq"))


def resumable(segments: DataFrame) -> DataFrame:
    """What can be gone on with: tips whose chain is whole, with segments, turns, and the chain's first and last time, if segments have started_at."""
    found = chains(segments, strict=False)
    own = found.join(segments.withColumnRenamed("run_id", "member"), "member")
    times = [F.min("started_at").alias("first_at"), F.max("started_at").alias("last_at")] if "started_at" in segments.columns else []
    return own.groupBy("run_id").agg(F.count("*").alias("n_segments"), F.sum("n_turns").alias("total_turns"), F.min_by("member", F.col("depth") * -1).alias("first_segment"), *times)


def carry_over(rows: DataFrame) -> DataFrame:
    """The first carry-over memory record of each conversation and the run that it names."""
    event = F.try_parse_json("content")
    named = rows.where("role = 'memory'").withColumns({"event": F.try_variant_get(event, "$.event", "string"), "source": F.try_variant_get(event, "$.previous_run_id", "string")})
    return named.where("event = 'carried_over'").groupBy("run_id", "item_id").agg(F.min_by("source", "seq").alias("previous_run_id"))


def context_fit(messages: DataFrame, keys: list[str], budget: int, last_turns: int = 4) -> DataFrame:
    """Messages that fit the budget: all if they do, else those of the last turns if these do, else the newest. One evaluation of a snapshot."""
    tokens = F.ceil(F.length(F.coalesce(F.col("content"), F.lit(""))) / 4) + 4
    w = Window.partitionBy(*keys)
    own = messages.withColumn("tokens", tokens).withColumns({"turns_back": F.max("turn_idx").over(w) - F.col("turn_idx"), "total": F.sum("tokens").over(w), "newest": F.max("seq").over(w)})
    own = own.withColumn("recent", F.sum(F.when(F.col("turns_back") < last_turns, F.col("tokens")).otherwise(0)).over(w))
    stays = F.when(F.col("total") <= budget, True).when(F.col("recent") <= budget, F.col("turns_back") < last_turns).otherwise(F.col("seq") == F.col("newest"))
    return own.where(stays).drop("turns_back", "total", "newest", "recent")


def memory_replay(messages: DataFrame, chain: DataFrame | None = None) -> DataFrame:
    """What a continued conversation remembers: user rows, assistant rows without an error, guardrail text of turns without a completion.

    With a chain (run_id, member, depth of chains()), the messages of all of a tip's segments, under the tip's run_id and with depth: ordered
    by falling depth and seq they are the memory. Messages name their segment as run_id.
    """
    spoken = messages.where("role = 'assistant'").select("run_id", "item_id", "turn_idx").distinct()
    silent = messages.where("role = 'guardrail'").join(spoken, ["run_id", "item_id", "turn_idx"], "left_anti")
    kept = messages.where("role = 'user' or (role = 'assistant' and content is not null)").unionByName(silent)
    if chain is None:
        return kept
    return kept.withColumnRenamed("run_id", "member").join(chain, "member")

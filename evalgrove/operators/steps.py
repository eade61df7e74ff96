"""Turns, steps and item views rebuilt from trace rows; the core join and its anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import redacted, redactions

ITEM = ["run_id", "item_id"]


def scored_turn(messages: DataFrame) -> DataFrame:
    """Rows of each item's last turn. An item whose turns are all null keeps its rows, as turn 0."""
    w = Window.partitionBy(*ITEM)
    return messages.withColumn("last_turn", F.coalesce(F.max("turn_idx").over(w), F.lit(0))).where(F.coalesce("turn_idx", "last_turn") == F.col("last_turn")).withColumn("turn_idx", F.col("last_turn")).drop("last_turn")


def with_step_ids(rows: DataFrame, keys: list[str], order: str = "seq", opens: str = "assistant") -> DataFrame:
    """step_id of each row: an opening row begins a step, rows before the first one belong to step 1."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("step_id", F.greatest(F.lit(1), F.count_if(F.col("role") == opens).over(w)))


def steps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a step: calls, tools, the last violation and reason, cost and latency."""
    return with_step_ids(rows, keys).groupBy(*keys, "step_id").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("role") == "tool").alias("n_tools"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.max_by("format_violation", F.when(F.col("format_violation").isNotNull(), F.col("seq"))).alias("format_violation"),
        F.min_by("tool_error_reason", F.when(F.col("tool_error_reason").isNotNull(), F.col("seq"))).alias("tool_error_reason"),
        F.sum("usd_cost").alias("usd_cost"), F.sum("latency_ms").alias("latency_ms"),
    )


def _last(role: str, column: str = "content") -> Column:
    return F.max_by(column, F.when(F.col("role") == role, F.col("seq")))


def scored_pairs(messages: DataFrame) -> DataFrame:
    """run_id, item_id, prompt, response and turn_idx of each item with a finished turn: its last user row and its last row of role turn.

    Reading fails at an item whose finished turn has no user row.
    """
    own = messages.where("item_id is not null").groupBy(*ITEM).agg(_last("user").alias("prompt"), _last("turn").alias("response"), _last("turn", "turn_idx").alias("turn_idx"), F.count_if(F.col("role") == "turn").alias("n_turns")).where("n_turns > 0")
    named = F.concat(F.lit("no user row before the scored turn of "), F.col("item_id"))
    return own.where(F.assert_true(F.coalesce("prompt", F.lit("")) != "", named).isNull()).select(*ITEM, "prompt", F.coalesce("response", F.lit("")).alias("response"), "turn_idx")


def final_responses(messages: DataFrame) -> DataFrame:
    """The last assistant completion of each item; items without one have no row."""
    said = messages.where("role = 'assistant' and item_id is not null and content is not null")
    return said.groupBy(*ITEM).agg(F.max_by("content", "seq").alias("response"))


def transcript(messages: DataFrame, guardrail_role: str = "guardrail") -> DataFrame:
    """Question and delivered answer of each turn; a guardrail's text wins, unfinished turns have none.

    Where messages have latency_ms, usd_cost or error, so has the transcript: latency of model calls, cost and stop reason of the turn's own row.
    """
    model, turn = F.col("role").isin("assistant", "summariser"), F.col("role") == "turn"
    measured = {
        "latency_ms": lambda: F.sum(F.when(model, F.col("latency_ms"))).alias("latency_ms"), "usd_cost": lambda: F.max(F.when(turn, F.col("usd_cost"))).alias("usd_cost"),
        "error": lambda: F.max(F.when(turn, F.col("error"))).alias("stop_reason"),
    }
    return messages.groupBy(*ITEM, "turn_idx").agg(
        _last("user").alias("question"), F.coalesce(_last(guardrail_role), _last("assistant")).alias("answer"), F.count_if(F.col("role") == "assistant").alias("n_completions"), *[f() for c, f in measured.items() if c in messages.columns]
    )


def model_visible(items: DataFrame) -> DataFrame:
    """All of an item that a model may see: its turns, under its id."""
    return items.select("id", "turns")


def judge_requests(pairs: DataFrame, order: list[str] = ("prompt", "response", "reference")) -> DataFrame:
    """run_id, item_id, request and n_redacted of scored pairs: headed blocks in the given order, bodies trimmed, blocks without a body left out, model names redacted in the response."""
    headed = [F.when(F.trim(body) != "", F.concat(F.lit(f"## {name.capitalize()}\n"), F.trim(body))) for name in order if name in pairs.columns for body in [redacted(F.col(name)) if name == "response" else F.col(name)]]
    return pairs.select(*ITEM, F.concat_ws("\n\n", *headed).alias("request"), redactions(F.coalesce("response", F.lit(""))).cast("long").alias("n_redacted"))


def item_results(items: DataFrame, views: DataFrame, judgements: DataFrame, keys: list[str]) -> DataFrame:
    """Items with their view, and their judgement if there is one."""
    return items.join(views, keys).join(judgements, keys, "left")


def missing_items(items: DataFrame, views: DataFrame, keys: list[str]) -> DataFrame:
    return items.join(views, keys, "left_anti")


def unknown_items(items: DataFrame, views: DataFrame, keys: list[str]) -> DataFrame:
    return views.join(items, keys, "left_anti")


def completed(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Items whose last turn (size of turns less one) has a row of role turn; they need no second run."""
    done = rows.where("role = 'turn'").select("item_id", "turn_idx").distinct()
    last = items.withColumn("turn_idx", (F.size("turns") - 1).cast("long"))
    return last.join(done, ["item_id", "turn_idx"], "left_semi").drop("turn_idx")


def turn_rollup(calls: DataFrame, keys: list[str], violations: list[str], errors: list[str]) -> DataFrame:
    """Tokens, cost and calls of each turn, and counts by type of violation and tool error."""
    model = F.col("role") != "tool"
    tokens = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("prompt_tokens", "completion_tokens")), F.lit(0))
    return calls.groupBy(*keys).agg(
        F.count_if(model).alias("n_calls"), F.sum(F.when(model, tokens)).alias("tokens"), F.sum("usd_cost").alias("usd_cost"), F.bool_or("cached").alias("any_cached"),
        *[F.count_if(F.col("format_violation") == v).alias(f"violation_{v}") for v in violations], *[F.count_if(F.col("tool_error_reason") == e).alias(f"error_{e}") for e in errors],
        F.min_by("format_violation", F.when(F.col("format_violation").isNotNull(), F.col("seq"))).alias("first_violation"),
    )


def retrieved(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct chunks of each turn in order of first sight, with the score then."""
    first = rows.groupBy(*keys, "chunk_id").agg(F.min("seq").alias("seq"), F.min_by("score", "seq").alias("score"))
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "chunk_id", "score"))).alias("s")).select(*keys, F.col("s.chunk_id").alias("chunk_ids"), F.col("s.score").alias("scores"))


def item_retrieved(rows: DataFrame, keys: list[str]) -> DataFrame:
    """retrieved_ids and retrieved_text of each item: the distinct ids of its tool rows in order, then those that its turn rows add; texts of tool rows joined by blank lines.

    rows: keys, seq, role, content and retrieved_chunk_ids. A chunk, and a text, counts once an item; what one item retrieved meets in one row, as its text does.
    """
    ids = rows.where("role in ('tool', 'turn')").select(*keys, (F.col("role") == "turn").cast("int").alias("later"), "seq", F.posexplode("retrieved_chunk_ids").alias("at", "chunk_id"))
    first = ids.groupBy(*keys, "chunk_id").agg(F.min(F.struct("later", "seq", "at")).alias("place")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "chunk_id"))).alias("s"))
    texts = rows.where("role = 'tool' and content is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("t"))
    return first.join(texts, keys, "full").select(*keys, F.coalesce("s.chunk_id", F.array().cast("array<string>")).alias("retrieved_ids"), F.array_join(F.coalesce("t.content", F.array().cast("array<string>")), "\n\n").alias("retrieved_text"))

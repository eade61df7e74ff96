"""Rates, curves, latency, cost and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import rate, wilson_columns
from ..vocabularies import CUTS, PRICES, RATE_READINGS, with_members
from .ranks import percentiles


def rates_by(rows: DataFrame, keys: list[str], flag: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(*rate(flag))


def threshold_curve(rows: DataFrame, keys: list[str], score: Column, below: bool, substituted: Column | None = None, substitution_counts: bool | None = None) -> DataFrame:
    """A rate at each cut. Null scores are unjudged; substituted rows count as registered, or not at all."""
    sub = F.lit(False) if substituted is None else F.coalesce(substituted, F.lit(False))
    own = rows.select(*keys, F.when(~sub, score).alias("score"), sub.alias("sub"), F.explode(F.array(*map(F.lit, CUTS))).alias("cut"))
    counts = (F.col("score") < F.col("cut")) if below else (F.col("score") >= F.col("cut"))
    flag = F.when(F.col("sub"), F.lit(substitution_counts).cast("boolean")).otherwise(counts)
    return own.groupBy(*keys, "cut").agg(*rate(flag), F.count_if(~F.col("sub") & F.col("score").isNull()).alias("n_unjudged"), F.count_if("sub").alias("n_substituted"))


def registered_curves(rows: DataFrame, keys: list[str], selects: dict[str, Column], substituted: Column) -> DataFrame:
    """Curves of all registered readings: each has its dimension, direction, items (selects, by name) and rule for substituted answers.

    Rows are spread over readings in one pass.
    """
    made = []
    for name, dimension, below, counts in RATE_READINGS:
        score = F.col(dimension).cast("double")
        made.append(F.struct(F.lit(name).alias("metric"), F.lit(below).alias("below"), F.lit(counts).cast("boolean").alias("counts"), F.when(~substituted, score).alias("score"), selects[name].alias("chosen")))
    long = rows.select(*keys, substituted.alias("sub"), F.inline(F.array(*made))).where("chosen").select("*", F.explode(F.array(*map(F.lit, CUTS))).alias("cut"))
    flag = F.when(F.col("sub"), F.col("counts")).otherwise(F.when(F.col("below"), F.col("score") < F.col("cut")).otherwise(F.col("score") >= F.col("cut")))
    return long.groupBy(*keys, "metric", "cut").agg(*rate(flag), F.count_if(~F.col("sub") & F.col("score").isNull()).alias("n_unjudged"), F.count_if("sub").alias("n_substituted"))


def rate_over_members(rows: DataFrame, keys: list[str], column: str, members: list[str], events: Column, selected: Column) -> DataFrame:
    """A rate for each member of a vocabulary, those without rows too."""
    counts = rows.where(selected).groupBy(*keys, column).agg(F.count_if(F.coalesce(events, F.lit(False))).alias("s"), F.count(events).alias("n"))
    full = with_members(counts, rows.select(*keys).distinct(), column, members, ["s", "n"])
    return full.select(*keys, column, *wilson_columns(F.col("s"), F.col("n")))


def share_by_type(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Of each type value, its share of all rows of the group, so that shares add up to the headline."""
    totals = rows.groupBy(*keys).agg(F.count("*").alias("total"))
    counts = rows.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("s"))
    return counts.join(totals, keys).select(*keys, column, *wilson_columns(F.col("s"), F.col("total")))


def latency_and_cost(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Latency of calls that weren't replayed, tokens and cost. Unknown `cached` counts to neither side; no price is no cost."""
    model = F.col("role").isin("assistant", "summariser")
    fresh = F.when(model & (F.col("cached") == False), F.col("latency_ms"))  # noqa: E712
    tokens = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("prompt_tokens", "completion_tokens")), F.lit(0))
    totals = calls.groupBy(*keys).agg(
        F.round(F.avg(fresh), 9).alias("mean_ms"), F.count(fresh).alias("n_uncached"),
        F.round(F.avg(F.when(model, F.col("cached").cast("int"))), 9).alias("cached_share"), F.sum(F.when(model, tokens)).alias("tokens"),
        F.round(F.sum("usd_cost"), 9).alias("usd_cost"), (F.count("*") - F.count("usd_cost")).alias("n_unpriced"), F.round(1000 * F.sum("usd_cost") / F.count_distinct("item_id"), 9).alias("usd_per_1k"),
        F.round(F.count_if(model) / F.count_distinct("item_id"), 9).alias("calls_per_item"),
    )
    high = percentiles(calls.select(*keys, fresh.alias("latency")), keys, "latency", {"p95_ms": 0.95})
    joined = totals.join(high, keys, "left") if keys else totals.crossJoin(F.broadcast(high))
    return joined.withColumn("p95_ms", F.round("p95_ms", 9))


def reasoning_tokens(total: Column, prompt: Column, completion: Column) -> Column:
    """What a total holds beyond prompt and completion; null if any is unknown."""
    rest = total - prompt - completion
    return F.when(rest.isNotNull(), F.greatest(F.lit(0), rest))


def call_rates(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Protocol compliance, violations, truncation and tool errors as shares of calls, long."""
    violation = F.col("format_violation")
    flags = {
        "compliance": violation.isNull() | (violation == "truncated"), "violation": violation.isNotNull() & (violation != "truncated"),
        "truncation": F.coalesce(violation == "truncated", F.lit(False)), "tool_error": F.col("tool_error_reason").isNotNull(),
    }
    long = calls.select(*keys, F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("flag")) for k, v in flags.items()])))
    return rates_by(long, [*keys, "metric"], F.col("flag"))


def priced(calls: DataFrame, prices: list[tuple[str, float, float]] = PRICES, model: str = "model_name") -> DataFrame:
    """USD of each call by the longest price key that its model id begins with; null without one. The price list is a fixed handful."""
    best: Column = F.lit(None).cast("struct<i:double,o:double>")
    for prefix, i, o in sorted(prices, key=lambda p: len(p[0])):
        best = F.when(F.startswith(F.col(model), F.lit(prefix)), F.struct(F.lit(i).alias("i"), F.lit(o).alias("o"))).otherwise(best)
    reasoning = F.coalesce(reasoning_tokens(F.col("total_tokens"), F.col("prompt_tokens"), F.col("completion_tokens")), F.lit(0))
    return calls.withColumn("usd", (F.col("prompt_tokens") * best["i"] + (F.col("completion_tokens") + reasoning) * best["o"]) / 1e6)


def priced_by_table(calls: DataFrame, prices: DataFrame, model: str = "model_name") -> DataFrame:
    """As priced(), with a price table (prefix, usd_in, usd_out) of any size: models are matched once each, on each of their prefixes."""
    models = calls.select(model).distinct()
    cut = models.select(model, F.explode(F.transform(F.sequence(F.lit(1), F.length(model)), lambda n: F.left(F.col(model), n))).alias("prefix"))
    best = cut.join(prices, "prefix").groupBy(model).agg(F.max_by(F.struct("prefix", "usd_in", "usd_out"), F.length("prefix")).alias("price"))
    return calls.join(best, model, "left")


def judge_means(rows: DataFrame, dimensions: list[str], run: str, axis: str) -> DataFrame:
    """Mean of each dimension for each run, pooled and by axis (axis null: pooled, marked by `pooled`)."""
    long = rows.select(run, axis, F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("double").alias("score")) for d in dimensions])))
    return long.groupingSets([[run, "dimension"], [run, axis, "dimension"]], run, axis, "dimension").agg(
        F.round(F.avg("score"), 9).alias("mean"), F.count("score").alias("n"), F.round(F.try_divide(F.stddev_samp("score"), F.sqrt(F.count("score"))), 9).alias("stdev"), F.grouping(axis).cast("int").alias("pooled")
    )


def consistency(rows: DataFrame, pair: str, keys: list[str], components: list[str], usable: Column) -> DataFrame:
    """Absolute differences within pairs: exactly two members, both usable and complete, or the pair is left out."""
    complete = usable & ~F.greatest(*[F.col(c).isNull() for c in components])
    pairs = rows.groupBy(*keys, pair).agg(F.count("*").alias("members"), F.every(complete).alias("whole"), *[(F.max(c) - F.min(c)).cast("double").alias(c) for c in components])
    return pairs.where("members = 2 and whole").drop("members", "whole")


def consistency_summary(pairs: DataFrame, keys: list[str], components: list[str]) -> DataFrame:
    long = pairs.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("delta")) for c in components])))
    return long.groupBy(*keys, "component").agg(F.round(F.avg("delta"), 9).alias("mean_delta"), F.count("delta").alias("n_pairs"))

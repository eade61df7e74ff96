"""Rule checks as long rows: a check that doesn't apply has no row, and never counts as passed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import wilson_columns
from ..functions.rules import RULES, all_matches, citations, matches_any, missing_needles, normal_space
from ..vocabularies import CHECKS, with_members


class Checks(dict):
    """name: (applies, passed, value), over views with columns that `found` adds to them. So each pattern is run once a text, whatever reads it."""

    def __init__(self, checks: dict[str, tuple[Column, Column, Column]], found: list[dict[str, Column]]):
        super().__init__(checks)
        self.found = found


def check_rows(views: DataFrame, keys: list[str], checks: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """check, passed and value from name: (applies, passed, value)."""
    for found in getattr(checks, "found", []):
        views = views.withColumns(found)
    made = [F.struct(F.lit(k).alias("check"), p.alias("passed"), v.cast("double").alias("value"), a.alias("applies")) for k, (a, p, v) in checks.items()]
    return views.select(*keys, F.inline(F.array(*made))).where("applies").drop("applies")


def standard_checks(known_tools: list[str], most_calls: int | None = None, most_errors: int | None = None) -> Checks:
    """The nine checks over item views: response, retrieved_ids, retrieved_text, must_include, expected_tool, tools (called names),
    n_calls, n_violations (without truncation), n_tool_errors and stopped_reason."""
    text = F.coalesce(F.col("response"), F.lit(""))
    n, bad = F.col("n_calls"), F.col("n_violations")
    used = F.size(F.filter(F.col("tools"), lambda t: t == F.col("expected_tool")))
    invented = F.size(F.array_except("tools", F.array(*map(F.lit, known_tools)).cast("array<string>")))
    source = F.lower(normal_space(F.coalesce(F.col("retrieved_text"), F.lit(""))))
    # columns of their own, which the optimiser leaves where they are, as several checks read each; a struct's fields it would copy to all readers
    first = {
        "check_gone": F.size(missing_needles(text, F.col("must_include"))), "check_cited": citations(text), "check_claims": all_matches(text, RULES["quantitative_claim"]),
        "check_declines": matches_any(text, RULES["refusal"] + RULES["hedge_without_answer"]),
    }
    gone, cited, claims, declines = map(F.col, first)
    wanted, lost = F.size("must_include"), F.size(F.array_except(cited, F.col("retrieved_ids")))
    # only the sources of texts with claims are gone through
    then = {"check_held": F.when(F.size(claims) > 0, F.size(F.filter(claims, lambda c: F.contains(source, F.lower(normal_space(c)))))).otherwise(0)}
    held = F.col("check_held")

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(1.0)

    def budget(reason: str, count: Column, most: int | None) -> Column:
        return F.when(F.col("stopped_reason").isNotNull(), F.col("stopped_reason") != reason).otherwise(count < F.lit(most))

    return Checks({
        "protocol_compliance": (F.lit(True), bad == 0, share(n - bad, n)),
        "tool_used": (F.col("expected_tool").isNotNull(), used > 0, used),
        "no_hallucinated_tool": (F.lit(True), invented == 0, invented),
        "contains": (F.coalesce(wanted > 0, F.lit(False)), gone == 0, share(wanted - gone, wanted)),
        "citation_grounding": (F.lit(True), lost == 0, share(F.size(cited) - lost, F.size(cited))),
        "model_call_budget": (F.lit(most_calls is not None), budget("model_call_budget", n, most_calls), n),
        "tool_call_errors": (F.lit(most_errors is not None), budget("tool_error_budget", F.col("n_tool_errors"), most_errors), F.col("n_tool_errors")),
        "no_refusal": (F.lit(True), ~declines, (~declines).cast("int")),
        "kb_grounded": (F.size(claims) > 0, held == F.size(claims), share(held, F.size(claims))),
    }, [first, then])


def all_passed(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Whether every check that ran passed; items without a row here ran none, and didn't pass."""
    return checks.groupBy(*keys).agg(F.every("passed").alias("all_passed"), F.count("*").alias("n_checks"))


def pass_rates(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Pass rate of each registered check, those that never ran too."""
    counts = checks.groupBy(*keys, "check").agg(F.count_if("passed").alias("s"), F.count("*").alias("n"))
    return with_members(counts, checks.select(*keys).distinct(), "check", CHECKS, ["s", "n"]).select(*keys, "check", *wilson_columns(F.col("s"), F.col("n")))

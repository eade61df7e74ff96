"""The long metric table of runs, and the judge's and run's health in one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import rate


def metric_table(rows: DataFrame, keys: list[str], wellformed: Column, flags: dict[str, Column], excluded: Column | None = None) -> DataFrame:
    """One row a run, conditioning and metric. Each row counts under `all`, and under `wellformed` if it is; excluded rows (infrastructure failures) count nowhere.

    All metrics come from one pass: rows are spread over conditionings and flags, and added up before the shuffle.
    """
    kept = rows if excluded is None else rows.where(~F.coalesce(excluded, F.lit(False)))
    conditionings = F.array_compact(F.array(F.lit("all"), F.when(wellformed, F.lit("wellformed"))))
    made = F.array(*[F.struct(F.lit(k).alias("metric"), F.lit(i).alias("ord"), v.alias("flag")) for i, (k, v) in enumerate(flags.items())])
    long = kept.select(*keys, F.explode(conditionings).alias("conditioning"), made.alias("made")).select(*keys, "conditioning", F.inline("made"))
    return long.groupBy(*keys, "conditioning", "metric", "ord").agg(*rate(F.col("flag"))).withColumn("note", F.when(F.col("n") == 0, zero_note(F.col("metric"))))


#: What an empty metric says, by the token that its name begins with.
ZERO_NOTES = [("rate", "nothing to count"), ("judge", "nothing judged"), ("axis", "nothing judged on this axis"), ("check", "the check never ran"), ("guardrail_action_rate", "nothing scored"), ("consistency", "no complete pair")]


def zero_note(metric: Column) -> Column:
    """The note of a metric without data, by the part of its name before a colon or an at sign."""
    token, note = F.element_at(F.split(metric, "[:@]"), 1), F.lit("nothing to count")
    for name, text in ZERO_NOTES:
        note = F.when(token == name, text).otherwise(note)
    return note


def headline(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Rows of the named metrics, chosen by name before their data, so that an empty reading stays."""
    wanted = metrics.sparkSession.createDataFrame([(n,) for n in names], "metric string")
    return metrics.join(F.broadcast(wanted), "metric", "left_semi")


def in_sections(metrics: DataFrame, sections: list[tuple[str, str]], other: str = "Other metrics") -> DataFrame:
    """metrics with section and its place: the first prefix that fits decides; unknown metrics come last."""
    section, place = F.lit(other), F.lit(len(sections))
    for i, (prefix, title) in reversed(list(enumerate(sections))):
        fits = F.startswith(F.col("metric"), F.lit(prefix))
        section, place = F.when(fits, title).otherwise(section), F.when(fits, i).otherwise(place)
    return metrics.withColumns({"section": section, "section_ord": place})


def judge_health(scores: DataFrame, keys: list[str]) -> DataFrame:
    """First-pass parses, repairs, unparsed scores, cost, and replays: scores all of whose attempts were cached. attempts is array<struct<cached:boolean,...>>.

    Where scores have evidence_unverified (array<string>) and redactions, the number of unverified spans and of redacted names too.
    """
    counts = [F.coalesce(F.sum(F.size("evidence_unverified")), F.lit(0)).alias("n_unverified_spans")] if "evidence_unverified" in scores.columns else []
    counts += [F.coalesce(F.sum("redactions"), F.lit(0)).alias("n_redactions")] if "redactions" in scores.columns else []
    replay = (F.size("attempts") > 0) & F.forall("attempts", lambda a: F.coalesce(a["cached"], F.lit(False)))
    ok, repaired = F.coalesce("parse_ok", F.lit(False)), F.coalesce("repaired", F.lit(False))
    return scores.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(ok & ~repaired).alias("n_first_pass"), F.count_if(ok & repaired).alias("n_repaired"), F.count_if(~ok).alias("n_unparsed"), F.count_if(replay).alias("n_replays"), F.sum("usd_cost").alias("usd_cost"), *counts)

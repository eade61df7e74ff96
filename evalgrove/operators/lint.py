"""Dataset linting: one diagnostic row for each problem."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import textdiff
from ..functions.jsonscan import line_problem
from ..sources.traces import LABEL, parsed, valid_label
from ..vocabularies import ATTACK_TYPES, SUBCATEGORIES


def diagnostics(rows: DataFrame, keys: list[str], problems: dict[str, Column]) -> DataFrame:
    """keys and code of each problem whose condition holds."""
    codes = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in problems.items()]))
    return rows.select(*keys, F.explode(codes).alias("code"))


def line_problems(line: Column) -> dict[str, Column]:
    """Of one line of a file of JSON objects."""
    keys = F.json_object_keys(line)
    parsed = F.when(F.json_array_length(F.concat(F.lit("["), line, F.lit("]"))) == 1, keys.isNotNull())
    return {
        "blank_line": F.trim(line) == "", "not_json": (F.trim(line) != "") & parsed.isNull(), "not_object": ~parsed,
        "duplicate_key": F.size(keys) > F.size(F.array_distinct(keys)), "carriage_return": F.endswith(line, F.lit("\r")), "byte_order_mark": F.startswith(line, F.lit("﻿")),
    }


def json_problems(rows: DataFrame, keys: list[str], line: Column) -> DataFrame:
    """keys, code and key: a row for each line that isn't one JSON object, and one for each repetition of a key in an object at any depth."""
    found = rows.select(*keys, line_problem(line).alias("p")).where("p.code is not null")
    return found.select(*keys, "p.code", F.explode_outer("p.repeated").alias("key"))


def file_problems(content: Column) -> dict[str, Column]:
    """Of a whole file's bytes (binaryFile)."""
    size = F.octet_length(content)
    return {
        "empty_file": size == 0, "byte_order_mark": F.hex(F.substring(content, 1, 3)) == "EFBBBF", "no_final_newline": (size > 0) & (F.hex(F.substring(content, -1, 1)) != "0A"),
        "crlf": F.contains(F.hex(content), F.lit("0D0A")), "bad_encoding": F.try_validate_utf8(content.cast("string")).isNull(),
    }


def item_problems(known: list[str]) -> dict[str, Column]:
    """Of parsed items: fields (names present) and the item's columns."""
    axis, sub, attack = F.col("axis"), F.col("subcategory"), F.col("attack_type")
    of_axis = F.lit(False)
    for a, members in SUBCATEGORIES.items():
        of_axis = of_axis | ((axis == a) & sub.isin(members))
    some = sum(F.col(c).isNotNull().cast("int") for c in ("counterfactual_id", "counterfactual_variant", "counterfactual_attribute"))
    return {
        "unknown_field": F.size(F.array_except("fields", F.array(*map(F.lit, known)))) > 0, "missing_id": F.col("id").isNull(), "unknown_axis": ~F.coalesce(axis.isin(list(SUBCATEGORIES)), F.lit(False)),
        "subcategory_not_of_axis": ~F.coalesce(of_axis, F.lit(False)), "unknown_attack_type": attack.isNotNull() & ~attack.isin(ATTACK_TYPES),
        "attack_outside_safety": attack.isNotNull() & (axis != "safety"), "attack_on_control": attack.isNotNull() & (sub == "benign_control"), "safety_without_attack": (axis == "safety") & (sub != "benign_control") & attack.isNull(),
        "empty_turn": (F.coalesce(F.size("turns"), F.lit(0)) == 0) | F.exists("turns", lambda t: F.trim(t) == ""), "partial_counterfactual": (some > 0) & (some < 3), "unpaired_bias": (axis == "bias") & (some == 0),
    }


def pair_problems(items: DataFrame, pair: str, variant: str, attribute: str, invariant: list[str], turns: Column) -> DataFrame:
    """Of counterfactual pairs."""
    per = items.where(F.col(pair).isNotNull()).groupBy(pair).agg(
        F.count("*").alias("n"), F.count_distinct(variant).alias("variants"), F.count_distinct(attribute).alias("attributes"), F.count_distinct(turns).alias("lengths"), *[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(f"same_{c}") for c in invariant]
    )
    two = F.col("n") == 2
    return diagnostics(per, [pair], {"pair_size": ~two, "same_variant": two & (F.col("variants") < 2), "attribute_mismatch": F.col("attributes") > 1, "turn_count": F.col("lengths") > 1, **{f"varies_{c}": F.col(f"same_{c}") > 1 for c in invariant}})


def differing_spans(left: Column, right: Column) -> Column:
    """Runs of words in which two texts differ, by matching longest common runs first; equal pairs of an Arrow batch are matched once."""

    @F.pandas_udf("int")
    def count(lefts: pd.Series, rights: pd.Series) -> pd.Series:
        known: dict[tuple, int] = {}
        out = []
        for pair in zip(lefts, rights, strict=True):
            if pair not in known:
                known[pair] = textdiff.differing_spans(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="int32")

    return count(left, right)


def label_sidecar_problems(labels: DataFrame, items: DataFrame, dataset: str) -> DataFrame:
    """file, seq and code of each problem of label lines (file, seq, value): malformed, stale_dataset, unknown_item; and one row of code `degenerate` for each label space that has one value only.

    The last valid line of a run and item counts for the balance; more than one record is needed for it to be degenerate.
    """
    rows = parsed(labels, LABEL)
    ok = F.col("_corrupt").isNull() & valid_label()
    known = items.select("item_id").distinct().withColumn("known", F.lit(True))
    joined = rows.withColumn("ok", F.coalesce(ok, F.lit(False))).join(known, "item_id", "left")
    lines = diagnostics(joined, ["file", "seq"], {"malformed": ~F.col("ok"), "stale_dataset": F.col("ok") & ~F.col("dataset_sha256").eqNullSafe(F.lit(dataset)), "unknown_item": F.col("ok") & F.col("known").isNull()})
    last = joined.where("ok").groupBy("run_id", "item_id").agg(F.max_by(F.struct("label", "score"), "seq").alias("r"))
    space = F.when(F.col("r.label").isNotNull(), "labels").otherwise("scores")
    values = last.select(space.alias("space"), F.coalesce("r.label", F.col("r.score").cast("string")).alias("value")).groupBy("space").agg(F.count_distinct("value").alias("values"))
    one = values.crossJoin(F.broadcast(last.agg(F.count("*").alias("n")))).where("values = 1 and n > 1")
    return lines.unionByName(one.select(F.col("space").alias("file"), F.lit(None).cast("long").alias("seq"), F.lit("degenerate").alias("code")))


def composition(items: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """Counts by each key and in all, with counts of flags."""
    sets = [[], *[[k] for k in keys]]
    return items.groupingSets(sets, *keys).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()], F.grouping_id().cast("long").alias("level"))

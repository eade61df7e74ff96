"""Quality rules: statistics of texts in SQL functions, and a decision list learned from labelled ones.

Sequential covering: a rule grows one threshold at a time, each the one of most information gain on the
rows that the rule and no earlier one covers; it is pruned on rows set apart, and kept while it is right
there. Each step is one grouped count over the stored statistics of all labelled documents, so learning
collects a table of features by thresholds and never rows. The list becomes one ordered conditional
expression.

Rows: a null text has no word, so it fails the base rules, as do empty texts. Null labels, and labels of
no document, teach nothing; several labels of a document count as the lowest. Without labels of both
kinds the list is empty and the base rules decide. Repeated rows are judged each by itself. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, sampled, stored

_SPACES = r"[ \t-\r]+"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_unique_words", "n_marks", "n_upper", "n_digits"]
#: Shares of the rows, and of the rows with a value over zero, between which thresholds are tried.
QUANTILES = [0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]


def with_statistics(docs: DataFrame, prefix: str = "") -> DataFrame:
    """docs with the columns of COUNTS under a prefix."""
    p = prefix + "_"
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumns({f"{p}words": F.array_remove(F.split(text, _SPACES), ""), f"{p}lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))})
    words, lines = F.col(f"{p}words"), F.col(f"{p}lines")
    out = out.withColumn(f"{p}joined", F.array_join(words, ""))
    out = out.withColumn(
        f"{p}windows",
        F.when(F.size(words) >= 5, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 4, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, 5)))).otherwise(F.array().cast("array<long>")),
    )
    windows = F.col(f"{p}windows")
    # only texts that repeat a window sort theirs
    out = out.withColumn(
        f"{p}sorted", F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at")))))
    )
    s = F.col(f"{p}sorted")
    twice = F.filter(s, lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"]))
    out = out.withColumn(f"{p}twice", F.sort_array(F.transform(twice, lambda x: x["at"])))
    at = F.col(f"{p}twice")
    covered = F.transform(at, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(at, i + 1) - x, F.lit(5))))
    joined = F.col(f"{p}joined")
    counts = {
        "n_words": F.size(words), "word_chars": F.length(joined), "n_symbols": F.regexp_count(joined, F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)), "n_repeat_words": F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)),
        "n_lines": F.size(lines), "n_unique_words": F.size(F.array_distinct(words)), "n_marks": F.regexp_count(joined, F.lit("[!?]")),
        "n_upper": F.regexp_count(joined, F.lit(r"\p{Lu}")), "n_digits": F.regexp_count(joined, F.lit("[0-9]")),
    }
    # a generator, since filters on the counts would otherwise be moved below the arrays and compute them anew for each element
    return out.select(*docs.columns, F.inline_outer(F.array(F.struct(*[counts[c].cast("long").alias(prefix + c) for c in COUNTS]))))


def features(prefix: str = "") -> dict[str, Column]:
    """What rules test, as functions of the counts; 0 for a text without words."""
    c = {x: F.col(prefix + x).cast("double") for x in COUNTS}

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(c[a], c[b]), F.lit(0.0))

    return {
        "words": c["n_words"], "word_length": share("word_chars", "n_words"), "symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"), "variety": share("n_unique_words", "n_words"), "marks": share("n_marks", "word_chars"), "upper": share("n_upper", "word_chars"), "digits": share("n_digits", "word_chars"),
    }


def base_failed(prefix: str = "") -> Column:
    n, repeats = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 10) | (100 * repeats > 20 * n)


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def test(self, columns: dict[str, Column]) -> Column:
        x = columns[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Literal, ...]


def covers(rule: Rule, columns: dict[str, Column]) -> Column:
    out = F.lit(True)
    for literal in rule:
        out = out & literal.test(columns)
    return out


def verdict(rules: list[Rule], columns: dict[str, Column]) -> Column:
    """Number of the first rule that covers a row, from 1; null if none does."""
    if not rules:
        return F.lit(None).cast("int")
    out = F.when(covers(rules[0], columns), F.lit(1))
    for i, rule in enumerate(rules[1:], 2):
        out = out.when(covers(rule, columns), F.lit(i))
    return out


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 and p0 else 0.0


def learn(statistics: DataFrame, labels: DataFrame, most_rules: int = 8, most_literals: int = 3, least_cover: int = 15, least_precision: float = 0.9) -> list[Rule]:
    """Rules for low quality from statistics (doc_id, COUNTS) and labels (doc_id, quality).

    A third of the rows, by a hash of the id, is set apart for pruning and for the last word on a rule:
    it must be right for least_precision of the rows there that it covers.
    """
    marks = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 0).alias("bad"))
    named = features()
    rows = stored(
        statistics.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(k) for k, c in named.items()]).join(marks, "doc_id").select((F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("apart"), "bad", *named),
        "labelled-statistics",
    )
    columns = {k: F.col(k) for k in named}
    cuts_row = rows.agg(
        F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"),
        *[F.percentile_approx(k, QUANTILES, 10_000).alias(k) for k in named],
        *[F.percentile_approx(F.when(F.col(k) > 0, F.col(k)), QUANTILES, 10_000).alias(f"{k} over 0") for k in named],
    ).first()
    if not cuts_row["bad"] or not cuts_row["good"]:
        return []
    cuts = {k: sorted({0.0, *(cuts_row[k] or ()), *(cuts_row[f"{k} over 0"] or ())}) for k in named}
    # a row's place among a feature's thresholds: how many of them lie below it
    place = F.array(*[F.struct(F.lit(k).alias("feature"), sum((F.col(k) > x).cast("int") for x in cuts[k]).alias("place")) for k in named])
    placed = stored(rows.withColumn("places", place), "placed-statistics")
    rules: list[Rule] = []
    while len(rules) < most_rules:
        left = placed.where(verdict(rules, columns).isNull())
        rule: Rule = ()
        before = None
        while len(rule) < most_literals:
            counts = left.where(~F.col("apart") & covers(rule, columns)).select("bad", F.inline("places")).groupBy("feature", "place").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
            by = {k: [r for r in counts if r["feature"] == k] for k in named}
            p0, n0 = (sum(r[x] for r in by["words"]) for x in ("p", "n"))
            if p0 == 0 or n0 == 0 or (before is not None and p0 / (p0 + n0) > 0.995):
                break
            best: tuple[float, Literal] | None = None
            for k in named:
                for i, x in enumerate(cuts[k]):
                    for above in (True, False):
                        inside = [r for r in by[k] if (r["place"] > i) == above]
                        p1, n1 = sum(r["p"] for r in inside), sum(r["n"] for r in inside)
                        if p1 >= least_cover and (best is None or _gain(p0, n0, p1, n1) > best[0] + 1e-9):
                            best = (_gain(p0, n0, p1, n1), Literal(k, above, x))
            if best is None or best[0] <= 0:
                break
            rule, before = (*rule, best[1]), best
        if not rule:
            break
        tests = [rule[:i] for i in range(1, len(rule) + 1)]
        own = left.where("apart").agg(*[F.count_if(covers(t, columns) & F.col("bad")).alias(f"p{i}") for i, t in enumerate(tests)], *[F.count_if(covers(t, columns) & ~F.col("bad")).alias(f"n{i}") for i, t in enumerate(tests)]).first()
        worth = [(own[f"p{i}"] - own[f"n{i}"]) / max(1, own[f"p{i}"] + own[f"n{i}"]) for i in range(len(tests))]
        i = max(range(len(tests)), key=lambda i: (worth[i], -i))
        p, n = own[f"p{i}"], own[f"n{i}"]
        if not p or p / (p + n) < least_precision:
            break
        rules.append(tests[i])
    return rules


def judged(statistics: DataFrame, rules: list[Rule], prefix: str = "") -> DataFrame:
    """statistics with base_failed, rule (the first that covers the row) and kept, under the prefix."""
    fails, rule = base_failed(prefix), verdict(rules, features(prefix))
    return statistics.withColumns({f"{prefix}base_failed": fails, f"{prefix}rule": rule, f"{prefix}kept": ~fails & rule.isNull()})


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of each row, stored."""
    return stored(with_statistics(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), *COUNTS), "statistics")


def good_documents(docs: DataFrame, labels: DataFrame, sample_docs: int = 40_000) -> DataFrame:
    """The rows of docs that base rules and learned list keep, with their own columns.

    The list is learned from about sample_docs labelled documents at most, chosen by a hash of the id; their ids are
    broadcast, so texts stay where they are.
    """
    marks = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("labelled_id"), "quality")
    chosen = sampled(marks, "labelled_id", sample_docs, "quality sample")
    ids = chosen.select("labelled_id").distinct()
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), F.col("doc_id") == F.col("labelled_id"), "left_semi")
    rules = learn(document_statistics(known), chosen.withColumnRenamed("labelled_id", "doc_id"))
    prefix = free_name(docs, "quality_rules") + "_"
    return judged(with_statistics(docs, prefix), rules, prefix).where(f"{prefix}kept").select(*docs.columns)

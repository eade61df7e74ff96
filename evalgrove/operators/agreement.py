"""Agreement of a judge with human labels, its stability, and judges against rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import excerpt
from ..vocabularies import AXES, GATE_KAPPA, GATE_PAIRS, KAPPA_LEAST_PAIRS
from .resampling import FIGURES, RESAMPLES, UNDEFINED, bootstrap_mean, cell_intervals, paired_permutation

SCORES = [1, 2, 3, 4, 5]


def pearson(x: Column, y: Column, weight: Column | None = None) -> Column:
    """Null under two pairs or for a constant side. With a weight, rows are counted values."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    n, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    cov = F.sum(w * x * y) - sx * sy / n
    vx, vy = F.sum(w * x * x) - sx * sx / n, F.sum(w * y * y) - sy * sy / n
    return F.when((n >= 2) & (vx > 1e-12) & (vy > 1e-12), cov / F.sqrt(vx * vy))


def cells(pairs: DataFrame, keys: list[str], human: str, judge: str) -> DataFrame:
    """Counts of (human, judge) values: at most 25 rows a group, whatever the pairs."""
    return pairs.where(F.col(human).isNotNull() & F.col(judge).isNotNull()).groupBy(*keys, F.col(human).alias("h"), F.col(judge).alias("j")).agg(F.count("*").alias("c"))


def mid_ranks(counted: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Mid-rank of each distinct value of counted cells, by running counts over distinct values."""
    per = counted.groupBy(*keys, value).agg(F.sum("c").alias("vc"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("vc").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.select(*keys, value, (before + (F.col("vc") + 1) / 2).alias(out))


def spearman(counted: DataFrame, keys: list[str]) -> DataFrame:
    ranked = counted.join(mid_ranks(counted, keys, "h", "rh"), [*keys, "h"]).join(mid_ranks(counted, keys, "j", "rj"), [*keys, "j"])
    return ranked.groupBy(*keys).agg(pearson(F.col("rh"), F.col("rj"), F.col("c")).alias("spearman"))


def kappa(counted: DataFrame, keys: list[str], quadratic: bool = True) -> DataFrame:
    """Cohen's kappa over counted cells; null without expected disagreement."""
    def weight(a: Column, b: Column) -> Column:
        return F.pow(a - b, 2).cast("double") if quadratic else (a != b).cast("double")

    n = counted.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("c") * weight(F.col("h"), F.col("j"))).alias("seen"))
    h = counted.groupBy(*keys, "h").agg(F.sum("c").alias("hc"))
    j = counted.groupBy(*keys, "j").agg(F.sum("c").alias("jc"))
    met = (h.join(j, keys) if keys else h.crossJoin(j)).groupBy(*keys).agg(F.sum(F.col("hc") * F.col("jc") * weight(F.col("h"), F.col("j"))).alias("chance"))
    both = n.join(met, keys) if keys else n.crossJoin(met)
    return both.select(*keys, F.col("n"), F.when(F.col("chance") > 0, 1 - F.col("seen") * F.col("n") / F.col("chance")).alias("kappa"))


def confusion(pairs: DataFrame, keys: list[str], human: str, judge: str) -> DataFrame:
    """A row for each human score 1 to 5 with counts of judge scores, zeros kept."""
    counts = cells(pairs, keys, human, judge).groupBy(*keys, "h").pivot("j", SCORES).agg(F.sum("c"))
    rows = pairs.select(*keys).distinct().select(*keys, F.explode(F.array(*map(F.lit, SCORES))).alias("h")) if keys else pairs.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("h"))
    joined = rows.join(counts.withColumn("h", F.col("h").cast("int")), [*keys, "h"], "left")
    return joined.select(*keys, F.col("h").alias("human"), *[F.coalesce(F.col(str(s)), F.lit(0)).alias(f"judge_{s}") for s in SCORES])


def _met(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of their group, where there is one; null keys are a group."""
    if not keys:
        return rows.crossJoin(groups)  # one row each
    named = groups.withColumnsRenamed({k: f"group_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"group_{k}"))
    return rows.join(named, same, "left").drop(*[f"group_{k}" for k in keys])


def report(pairs: DataFrame, keys: list[str], human: str, judge: str, digits: int = 6, resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """Agreement of each group; pairs without a judge score are counted apart, kappa is withheld under KAPPA_LEAST_PAIRS pairs.

    With resamples, each figure has its bootstrap interval (figure_low, figure_high; pairs are drawn whole) and those that can be undefined
    the number of resamples in which they were. A figure that is null has no interval.
    """
    h, j = F.col(human).cast("double"), F.when(F.col(human).isNotNull(), F.col(judge).cast("double"))
    gap = j - h
    base = pairs.groupBy(*keys).agg(
        F.count(gap).alias("n"), F.count_if(j.isNull()).alias("n_unparsed"), F.round(F.avg((gap == 0).cast("int")), digits).alias("exact"), F.round(F.avg((F.abs(gap) <= 1).cast("int")), digits).alias("within_one"),
        F.round(F.avg(F.abs(gap)), digits).alias("mae"), F.round(F.avg(F.when(j.isNotNull(), h)), digits).alias("mean_human"), F.round(F.avg(j), digits).alias("mean_judge"),
        F.count_if(gap > 0).alias("n_lenient"), F.count_if(gap < 0).alias("n_harsh"), F.count_if(gap == 0).alias("n_tied"), F.round(pearson(F.when(j.isNotNull(), h), j, F.when(j.isNotNull(), F.lit(1.0))), digits).alias("pearson"),
    )
    counted = cells(pairs, keys, human, judge)
    out = base.join(kappa(counted, keys).drop("n"), keys, "left").join(spearman(counted, keys), keys, "left")
    enough = F.col("n") >= KAPPA_LEAST_PAIRS
    out = out.withColumns({"kappa": F.when(enough, F.round("kappa", digits)), "spearman": F.round("spearman", digits), "kappa_note": F.when(~enough, F.lit("too few pairs")).when(F.col("kappa").isNull(), F.lit("undefined"))})
    if not resamples:
        return out
    ends = _met(out, cell_intervals(counted, keys, resamples, seed), keys)
    bounds = {f"{f}_{e}": F.when(F.col(f).isNotNull(), F.round(f"{f}_{e}", digits)) for f in FIGURES for e in ("low", "high")}
    return ends.select(*out.columns, *[c.alias(k) for k, c in bounds.items()], *[F.coalesce(f"{f}_undefined", F.lit(0)).alias(f"{f}_undefined") for f in UNDEFINED])


NO_AXIS = "(no axis)"


def report_by_axis(pairs: DataFrame, axis: str, human: str, judge: str, digits: int = 6, resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """report() of each axis of the vocabulary, with n = 0 where it has no pairs, and of `(no axis)` if some pairs have none."""
    named = pairs.withColumn(axis, F.coalesce(F.col(axis).cast("string"), F.lit(NO_AXIS)))
    found = report(named, [axis], human, judge, digits, resamples, seed)
    every = pairs.sparkSession.createDataFrame([(a,) for a in AXES], "wanted string")
    absent = F.broadcast(every).join(found.select(axis), F.col("wanted") == F.col(axis), "left_anti")  # a row an axis
    counts = [c for c, t in found.dtypes if t in ("bigint", "int")]
    zeros = absent.select(F.col("wanted").alias(axis), *[F.lit(0).cast("long").alias(c) for c in counts], F.lit("too few pairs").alias("kappa_note"))
    return found.unionByName(zeros, allowMissingColumns=True)


def gate(reports: DataFrame) -> DataFrame:
    """Reports with the reasons why a judge isn't accepted, and whether it is."""
    why = F.array_compact(F.array(F.when(F.col("kappa").isNull(), F.lit("no kappa")), F.when(F.col("kappa") < GATE_KAPPA, F.lit("kappa below the gate")), F.when(F.col("n") < GATE_PAIRS, F.lit("too few pairs"))))
    return reports.withColumn("failures", why).withColumn("accepted", F.size("failures") == 0)


def worst(pairs: DataFrame, run: str, human: str, judge: str, key: str, k: int, texts: list[str] = ()) -> DataFrame:
    """The k largest disagreements of each run."""
    gap = F.col(judge) - F.col(human)
    w = Window.partitionBy(run).orderBy(F.desc(F.abs(gap)), key)
    return (
        pairs.where(gap.isNotNull()).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).withColumn("place", F.col("place").cast("long"))
        .select(run, key, human, judge, "place", F.when(gap > 0, "lenient").when(gap < 0, "harsh").otherwise("tied").alias("direction"), *[excerpt(F.col(t)).alias(t) for t in texts])
    )


def self_consistency(samples: DataFrame, keys: list[str], unit: str, value: str) -> DataFrame:
    """Of repeated samples: share of equal pairs and population variance, from counts of values; one sample has none."""
    per = samples.groupBy(*keys, unit, value).agg(F.count("*").alias("c"))
    v, c = F.col(value).cast("double"), F.col("c")
    n = F.sum("c")
    units = per.groupBy(*keys, unit).agg(n.alias("n"), (F.sum(c * (c - 1)) / F.nullif(n * (n - 1), F.lit(0))).alias("agree"), F.when(n > 1, F.sum(c * v * v) / n - F.pow(F.sum(c * v) / n, 2)).alias("variance"))
    return units.groupBy(*keys).agg(F.count("agree").alias("n_units"), F.round(F.avg("agree"), 9).alias("agreement"), F.round(F.avg("variance"), 6).alias("variance"))


def drift(default: DataFrame, other: DataFrame, key: str, dimensions: list[str], keys: list[str], resamples: int = 0, seed: int = 0) -> DataFrame:
    """Mean signed change of each dimension when the order of blocks changes; unparsed pairs are counted. With resamples, its interval too."""
    both = default.alias("a").join(other.alias("b"), key)
    long = both.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), (F.col(f"b.{d}") - F.col(f"a.{d}")).cast("double").alias("delta")) for d in dimensions])))
    means = long.groupBy(*keys, "dimension").agg(F.round(F.avg("delta"), 9).alias("mean_delta"), F.count("delta").alias("n"), F.count_if(F.col("delta").isNull()).alias("n_unparsed"))
    if not resamples:
        return means
    ends = bootstrap_mean(long, [*keys, "dimension"], "delta", resamples, seed).select(*keys, "dimension", F.round("ci_low", 9).alias("ci_low"), F.round("ci_high", 9).alias("ci_high"))
    return _met(means, ends, [*keys, "dimension"])


def drift_of_orders(default: DataFrame, orders: dict[str, tuple[DataFrame | None, str | None]], key: str, dimensions: list[str], keys: list[str], resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """drift() of each reordering by name, never pooled. One that changes no pair's rendering has no scores, and a reason: its rows have n = 0 and say why."""
    rows = None
    for name, (scores, reason) in orders.items():
        if scores is None:
            groups = default.select(*keys).distinct() if keys else default.sparkSession.range(1).select()
            own = groups.select(*keys, F.explode(F.array(*map(F.lit, dimensions))).alias("dimension")).withColumns({"n": F.lit(0).cast("long"), "n_unparsed": F.lit(0).cast("long"), "reason": F.lit(reason)})
        else:
            own = drift(default, scores, key, dimensions, keys, resamples, seed).withColumn("reason", F.lit(None).cast("string"))
        own = own.withColumn("block_order", F.lit(name))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    return rows


def band(score: Column) -> Column:
    """Scores 1 and 2 fail, 4 and 5 pass, 3 says neither."""
    return F.when(score <= 2, F.lit(False)).when(score >= 4, F.lit(True))


def _answers(rows: DataFrame, questions: dict[str, tuple[Column, Column]], label: Column) -> DataFrame:
    """question, label, rule, judge and why an item is left out, for each item and question."""
    made = [F.struct(F.lit(q).alias("question"), rule.alias("rule"), band(score).alias("judge"), score.isNull().alias("unjudged")) for q, (rule, score) in questions.items()]
    long = rows.select(label.alias("label"), F.inline(F.array(*made)))
    why = F.when(F.col("label").isNull(), "unlabelled").when(F.col("rule").isNull(), "no rule").when(F.col("unjudged"), "unjudged").when(F.col("judge").isNull(), "middle band")
    return long.withColumn("why", why)


def judge_vs_rules(rows: DataFrame, questions: dict[str, tuple[Column, Column]], label: Column) -> DataFrame:
    """For each question (rule verdict, judge score): both agreements with the human label over the same items, and why items are left out."""
    used = _answers(rows, questions, label)
    rule, judge = (F.when(F.col("why").isNull(), (F.col(c) == F.col("label")).cast("int")) for c in ("rule", "judge"))
    return used.groupBy("question").agg(
        F.count(rule).alias("n"), *[F.count_if(F.col("why") == w).alias("n_" + w.replace(" ", "_")) for w in ("unlabelled", "no rule", "unjudged", "middle band")],
        F.round(F.avg(rule), 9).alias("rule_agreement"), F.round(F.avg(judge), 9).alias("judge_agreement"), F.round(F.avg(judge) - F.avg(rule), 9).alias("difference"),
        F.when(F.avg(judge) > F.avg(rule), "judge").when(F.count(rule) > 0, "rules").alias("winner"),
    )


def judge_vs_rules_tested(rows: DataFrame, questions: dict[str, tuple[Column, Column]], label: Column, resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """judge_vs_rules() with the paired p of the two agreements over the same items, their bootstrap intervals, the share of the middle band, and a
    row for every question: one that no item survives has n = 0 and null figures."""
    used = _answers(rows, questions, label)
    left = used.where("why is null").select("question", (F.col("rule") == F.col("label")).cast("int").alias("rule"), (F.col("judge") == F.col("label")).cast("int").alias("judge"))
    tested = paired_permutation(left.select("question", (F.col("judge") - F.col("rule")).alias("d")), ["question"], "d", seed=seed).select("question", F.round("p_value", 9).alias("p_value"))
    sides = left.select("question", F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("agrees")) for s in ("rule", "judge")])))
    ends = bootstrap_mean(sides, ["question", "side"], "agrees", resamples, seed)
    ends = ends.groupBy("question").agg(*[F.max(F.when(F.col("side") == s, F.round(f"ci_{e}", 9))).alias(f"{s}_{e}") for s in ("rule", "judge") for e in ("low", "high")])
    every = rows.sparkSession.createDataFrame([(q,) for q in questions], "question string")
    counts = ["n", "n_unlabelled", "n_no_rule", "n_unjudged", "n_middle_band"]
    found = F.broadcast(every).join(judge_vs_rules(rows, questions, label), "question", "left").na.fill(0, counts)  # a row a question
    middle = F.col("n_middle_band") / F.nullif(F.col("n_middle_band") + F.col("n_unjudged") + F.col("n_no_rule") + F.col("n"), F.lit(0))
    return found.withColumn("middle_rate", F.round(middle, 9)).join(ends, "question", "left").join(tested, "question", "left")

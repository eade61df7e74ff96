"""Hand-worked values of intervals, tests and agreement."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalgrove.functions.intervals import newcombe, wilson
from evalgrove.operators import agreement, rates, resampling, steps
from evalgrove.operators.checks import all_passed, pass_rates, standard_checks, check_rows
from evalgrove.vocabularies import CHECKS


def interval(spark, s, n):
    w = wilson(F.col("s"), F.col("n"))
    return spark.createDataFrame([(s, n)], "s long, n long").select(*[c.alias(k) for k, c in w.items()]).first()


@pytest.mark.parametrize("s, n, low, high", [(2, 40, 0.014, 0.165), (0, 10, 0.0, 0.278), (10, 10, 0.722, 1.0)])
def test_wilson(spark, s, n, low, high):
    r = interval(spark, s, n)
    assert (round(r["ci_low"], 3), round(r["ci_high"], 3)) == (low, high) and r["mean"] == s / n


def test_wilson_without_items(spark):
    r = interval(spark, 0, 0)
    assert (r["mean"], r["n"], r["ci_low"]) == (0.0, 0, None)


def test_newcombe_is_null_without_items(spark):
    cols = [F.lit(x) for x in (0.5, 0.3, 0.7, 10, 0.0, None, None, 0)]
    assert spark.range(1).select(newcombe(*cols)["delta"].alias("d")).first()["d"] is None


def test_kappa_and_ranks(spark):
    pairs = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (1, 5)], "h int, j int")
    cells = agreement.cells(pairs, [], "h", "j")
    k = agreement.kappa(cells, []).first()
    seen, chance = 16, sum((a - b) ** 2 * p * q for a, p in {1: 2, 2: 1, 3: 1, 4: 1, 5: 1}.items() for b, q in {1: 1, 2: 1, 3: 1, 4: 1, 5: 2}.items())
    assert k["kappa"] == pytest.approx(1 - seen * 6 / chance)
    ranks = {r["h"]: r["r"] for r in agreement.mid_ranks(cells, [], "h", "r").collect()}
    assert ranks == {1: 1.5, 2: 3.0, 3: 4.0, 4: 5.0, 5: 6.0}


def test_kappa_of_a_constant_is_null(spark):
    pairs = spark.createDataFrame([(3, 3)] * 12, "h int, j int")
    assert agreement.kappa(agreement.cells(pairs, [], "h", "j"), []).first()["kappa"] is None
    assert agreement.report(pairs.withColumn("g", F.lit(1)), ["g"], "h", "j").first()["pearson"] is None


def test_exact_permutation(spark):
    d = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate([1, 1, 1])] + [(2, i, 0.0) for i in range(3)], "g int, i int, d double")
    p = {r["g"]: r["p_value"] for r in resampling.permutation_exact(d, ["g"], "d").collect()}
    assert p == {1: 0.25, 2: 1.0}


def test_sampled_permutation_agrees_with_exact(spark):
    d = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate([1, 2, -1, 3, 1, 0, 2, 1, -2, 1, 1, 2])], "g int, i int, d double")
    exact = resampling.permutation_exact(d, ["g"], "d").first()["p_value"]
    assert resampling.permutation_sampled(d, ["g"], "d").first()["p_value"] == pytest.approx(exact, abs=0.02)


def test_bootstrap_of_one_row_is_a_point(spark):
    r = resampling.bootstrap_mean(spark.createDataFrame([("a", 3)], "g string, x int"), ["g"], "x").first()
    assert (r["mean"], r["ci_low"], r["ci_high"], r["n"]) == (3.0, 3.0, 3.0, 1)


def test_bootstrap_is_the_same_over_partitions(spark):
    rows = spark.range(200).select((F.col("id") % 2).alias("g"), (F.col("id") % 5).alias("x"))
    a, b = (sorted(map(tuple, resampling.bootstrap_mean(rows.repartition(n), ["g"], "x").collect())) for n in (1, 17))
    assert a == b


def test_threshold_curve_substitution(spark):
    rows = spark.createDataFrame([("r", 1.0, False), ("r", 5.0, False), ("r", None, False), ("r", 1.0, True)], "run string, s double, sub boolean")
    for counts, n, hits in ((None, 2, 1), (False, 3, 1), (True, 3, 2)):
        got = {r["cut"]: r for r in rates.threshold_curve(rows, ["run"], F.col("s"), True, F.col("sub"), counts).collect()}
        assert (got[2]["n"], round(got[2]["mean"] * n), got[2]["n_unjudged"], got[2]["n_substituted"]) == (n, hits, 1, 1)


def test_unknown_cost_stays_unknown(spark):
    calls = spark.createDataFrame([("i", "assistant", None, 5.0, None, 1, 1)], "item_id string, role string, cached boolean, latency_ms double, usd_cost double, prompt_tokens long, completion_tokens long")
    r = rates.latency_and_cost(calls, []).first()
    assert (r["usd_cost"], r["mean_ms"], r["cached_share"], r["n_unpriced"]) == (None, None, None, 1)


def test_reasoning_tokens(spark):
    r = spark.range(1).select(rates.reasoning_tokens(F.lit(10), F.lit(3), F.lit(4)).alias("a"), rates.reasoning_tokens(F.lit(5), F.lit(3), F.lit(4)).alias("b"), rates.reasoning_tokens(F.lit(None).cast("int"), F.lit(3), F.lit(4)).alias("c")).first()
    assert tuple(r) == (3, 0, None)


def test_longest_price_wins(spark):
    calls = spark.createDataFrame([("gpt-4o-mini-x", 1_000_000, 0, None), ("gpt-4o", 1_000_000, 0, None), ("other", 1, 1, None)], "model_name string, prompt_tokens long, completion_tokens long, total_tokens long")
    assert [r["usd"] for r in rates.priced(calls).orderBy("model_name").collect()] == [2.5, 0.15, None]


def test_steps(spark):
    rows = [("r", "i", 1, "tool", None, None), ("r", "i", 2, "assistant", "truncated", None), ("r", "i", 3, "tool", None, "e1"), ("r", "i", 4, "tool", None, "e2"), ("r", "i", 5, "assistant", None, None)]
    df = spark.createDataFrame(rows, "run_id string, item_id string, seq long, role string, format_violation string, tool_error_reason string").withColumns({"usd_cost": F.lit(1.0), "latency_ms": F.lit(1.0)})
    got = [(r["step_id"], r["n_rows"], r["tool_error_reason"]) for r in steps.steps(df.repartition(5), ["run_id", "item_id"]).orderBy("step_id").collect()]
    assert got == [(1, 4, "e1"), (2, 1, None)]


def test_checks(spark):
    schema = "item_id string, response string, retrieved_ids array<string>, retrieved_text string, must_include array<string>, expected_tool string, tools array<string>, n_calls int, n_violations int, n_tool_errors int, stopped_reason string"
    rows = [
        ("a", "Take 5 mg [[x.md#1]]", ["x.md#1"], "take 5 mg daily", ["MG"], "search", ["search"], 2, 0, 0, None),
        ("b", "I cannot help with that. 7 days", ["x.md#1"], "", [], None, ["made_up"], 9, 1, 9, "model_call_budget"),
    ]
    made = check_rows(spark.createDataFrame(rows, schema), ["item_id"], standard_checks(["search"], 5, 3))
    got = {(r["item_id"], r["check"]): r["passed"] for r in made.collect()}
    assert all(got["a", c] for c in CHECKS)
    assert {c for (i, c) in got if i == "b"} == set(CHECKS) - {"tool_used", "contains"}
    assert [c for c in CHECKS if got.get(("b", c))] == ["citation_grounding", "tool_call_errors"]
    assert {r["item_id"]: r["all_passed"] for r in all_passed(made, ["item_id"]).collect()} == {"a": True, "b": False}
    assert pass_rates(made.withColumn("run", F.lit(1)), ["run"]).count() == len(CHECKS)


def loop_figures(pairs):
    """Each figure of agreement in plain Python."""
    h, j = np.array(pairs, float).T
    n = len(h)

    def ranks(x):
        return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])

    def corr(x, y):
        return None if n < 2 or x.std() < 1e-9 or y.std() < 1e-9 else ((x - x.mean()) * (y - y.mean())).mean() / (x.std() * y.std())

    chance = ((h[:, None] - j[None, :]) ** 2).sum()
    kappa = 1 - ((h - j) ** 2).sum() * n / chance if chance else None
    return {"exact": (h == j).mean(), "within_one": (abs(h - j) <= 1).mean(), "mae": abs(h - j).mean(), "mean_human": h.mean(), "mean_judge": j.mean(), "pearson": corr(h, j), "spearman": corr(ranks(h), ranks(j)), "kappa": kappa}


def test_figures_of_drawn_cells_match_a_plain_loop():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 40):
        for _ in range(30):
            pairs = list(zip(rng.integers(1, 6, n).tolist(), rng.integers(2, 5, n).tolist(), strict=True))
            cells = sorted(set(pairs))
            got = resampling.cell_figures(*np.array(cells, float).T, np.array([[pairs.count(c) for c in cells]]))
            for f, v in loop_figures(pairs).items():
                assert np.isnan(got[f][0]) if v is None else got[f][0] == pytest.approx(v, abs=1e-9)


def test_agreement_intervals_match_a_plain_bootstrap(spark):
    rng = np.random.default_rng(9)
    human = rng.integers(1, 6, 60)
    pairs = [(int(h), int(np.clip(h + rng.integers(-1, 3), 1, 5))) for h in human]
    rows = [("hallucination", h, j) for h, j in pairs] + [("safety", 3, 3)] * 12 + [("safety", 3, 4), (None, 2, 2), (None, 2, None)]
    found = {r["axis"]: r for r in agreement.report_by_axis(spark.createDataFrame(rows, "axis string, h int, j int"), "axis", "h", "j").collect()}
    assert {a: (r["n"], r["n_unparsed"]) for a, r in found.items()} == {"hallucination": (60, 0), "safety": (13, 0), "bias": (0, 0), "(no axis)": (1, 1)}
    drawn = [loop_figures([pairs[i] for i in rng.integers(0, 60, 60)]) for _ in range(2000)]
    for f, v in loop_figures(pairs).items():
        r = found["hallucination"]
        assert r[f] == pytest.approx(v, abs=1e-6)
        for end, share in (("low", 2.5), ("high", 97.5)):
            assert r[f"{f}_{end}"] == pytest.approx(np.percentile([d[f] for d in drawn], share), abs=0.12 * np.std([d[f] for d in drawn]) + 0.02)
    # a constant rater: no correlation, and resamples without the one other score have no kappa either
    safety = found["safety"]
    assert (safety["pearson"], safety["pearson_low"], safety["spearman_high"]) == (None, None, None) and safety["kappa_undefined"] > 400
    assert found["bias"]["exact"] is None and found["bias"]["mae_low"] is None and found["bias"]["pearson_undefined"] == 0
    assert found["(no axis)"]["exact_low"] == found["(no axis)"]["exact_high"] == 1.0


def test_bootstrap_tree_of_many_values(spark, monkeypatch):
    """More distinct values than a block: as wide as a plain bootstrap, whatever the partitions; few values that come often, too."""
    rng = np.random.default_rng(2)
    v = rng.gamma(2.0, 3.0, 20_000)
    rows = spark.createDataFrame([("many", float(x)) for x in v] + [("few", float(x)) for x in rng.integers(1, 6, 30_000)] + [(None, 2.0)], "g string, x double")
    found = {r["g"]: r for r in resampling.bootstrap_mean(rows, ["g"], "x").collect()}
    many = found["many"]
    assert (many["n"], many["mean"]) == (20_000, pytest.approx(v.mean()))
    error = v.std() / np.sqrt(len(v))
    assert many["stdev"] == pytest.approx(error, rel=0.08) and many["ci_low"] == pytest.approx(v.mean() - 1.96 * error, abs=0.3 * error) and many["ci_high"] == pytest.approx(v.mean() + 1.96 * error, abs=0.3 * error)
    assert found["few"]["stdev"] == pytest.approx(np.sqrt(2) / np.sqrt(30_000), rel=0.08) and found[None]["ci_high"] == 2.0
    other = {r["g"]: r for r in resampling.bootstrap_mean(rows.repartition(7), ["g"], "x").collect()}
    assert all(other[g][c] == pytest.approx(found[g][c], rel=1e-9) for g in found for c in ("mean", "stdev", "ci_low", "ci_high"))


def test_drawn_sums_in_both_ways():
    rng = np.random.default_rng(3)
    v = np.array([1.0, 5.0, -2.0])
    for c in (np.array([1, 2, 1]), np.array([100, 20, 3])):
        sums = resampling._drawn_sums(rng, np.full(20_000, 10), v, c)
        mean = (v * c).sum() / c.sum()
        assert sums.mean() == pytest.approx(10 * mean, abs=0.2) and sums.var() == pytest.approx(10 * ((v**2 * c).sum() / c.sum() - mean**2), rel=0.05)
    assert (resampling._drawn_sums(rng, np.zeros(3, int), v, np.array([1, 1, 1])) == 0).all()


def test_permutation_of_small_and_large_groups(spark):
    rng = np.random.default_rng(5)
    groups = {g: [float(x) for x in (rng.integers(-4, 5, n) if g % 2 else rng.normal(size=n))] for g, n in enumerate(rng.integers(1, 13, 60))}
    groups |= {100: [0.0] * 20, 101: [float(x) for x in rng.normal(size=900) + 0.06], 102: [float(x) for x in rng.integers(-4, 5, 700)], 103: [0.0] * 3, 104: [1.0] * 17}
    rows = spark.createDataFrame([(g, d) for g, ds in groups.items() for d in ds] + [(1, None)], "g long, d double")
    found = {r["g"]: r for r in resampling.paired_permutation(rows.repartition(5), ["g"], "d").collect()}
    assert set(found) == set(groups)
    for g, ds in groups.items():
        d, n = np.array(ds), len(ds)
        assert found[g]["n"] == n and found[g]["method"] == ("exact" if n <= 16 else "sampled")
        if n <= 12:
            signs = 1 - 2 * ((np.arange(2**n)[:, None] >> np.arange(n)) & 1)
            assert found[g]["p_value"] == pytest.approx((np.abs(signs @ d) >= abs(d.sum()) - 1e-9).mean(), abs=1e-12)
        elif g < 103:
            signs = rng.choice([-1, 1], (20_000, n))
            assert found[g]["p_value"] == pytest.approx((np.abs(signs @ d) >= abs(d.sum()) - 1e-9).mean(), abs=0.03)
    assert found[100]["p_value"] == 1.0 and found[104]["p_value"] < 0.001


def test_judges_against_rules_with_tests(spark):
    rows = spark.createDataFrame([(i, i % 3 != 0, i % 2 == 0, (i % 5) + 1 if i % 10 else None) for i in range(60)] + [(99, None, True, 5)], "i int, label boolean, rule boolean, score int")
    found = {r["question"]: r for r in agreement.judge_vs_rules_tested(rows, {"a": (F.col("rule"), F.col("score")), "none": (F.lit(None).cast("boolean"), F.col("score"))}, F.col("label")).collect()}
    own = [(r, s >= 4, y) for _, y, r, s in [tuple(r) for r in rows.collect()] if y is not None and s is not None and s != 3]
    differences = [int(j == y) - int(r == y) for r, j, y in own]
    a = found["a"]
    assert (a["n"], a["n_unlabelled"], a["n_unjudged"], a["difference"]) == (len(own), 1, 6, pytest.approx(np.mean(differences), abs=1e-8))
    assert a["judge_low"] <= a["judge_agreement"] <= a["judge_high"] and 0 < a["p_value"] <= 1
    none = found["none"]
    assert (none["n"], none["n_no_rule"], none["winner"], none["p_value"], none["rule_low"]) == (0, 60, None, None, None)


def test_exact_permutation_draws_nothing_for_larger_groups(spark):
    """One pass for small groups; a larger one has its number of pairs and null."""
    d = spark.createDataFrame([(1, 1.0)] * 3 + [(2, float(i % 5)) for i in range(17)] + [(3, 0.0)] * 17, "g int, d double")
    found = resampling.permutation_exact(d, ["g"], "d")
    assert {r["g"]: (r["n"], r["p_value"]) for r in found.collect()} == {1: (3, 0.25), 2: (17, None), 3: (17, None)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_flipped_sums_by_bytes_and_words():
    """Signs of eight differences come from one byte and those of equal ones from words, not from a stream for each; moments are those of random signs."""
    v, c, draws = np.array([1.0, -2.5, 4.0, 0.5, 3.0]), np.array([1, 12, 13, 200, 5000]), 40_000
    sums = resampling._flipped_sums(resampling._generator(1, 2), v, c, draws)
    spread = np.sqrt((v**2 * c).sum())
    assert abs(sums.mean()) < 5 * spread / np.sqrt(draws) and sums.std() == pytest.approx(spread, rel=0.03)
    for k in range(5):
        own = resampling._flipped_sums(resampling._generator(3, k), v[k : k + 1], c[k : k + 1], draws)
        assert own.std() == pytest.approx(abs(v[k]) * np.sqrt(c[k]), rel=0.03) and np.abs(own).max() <= abs(v[k]) * c[k]
    few = resampling._flipped_sums(resampling._generator(4), np.array([1.0, 2.0, 4.0]), np.array([1, 1, 1]), draws)
    values, times = np.unique(few, return_counts=True)
    assert values.tolist() == [-7, -5, -3, -1, 1, 3, 5, 7] and np.abs(times / draws - 1 / 8).max() < 0.01


def test_draws_come_in_short_numbers_and_bounded_parts():
    class Asked:
        def integers(self, low, high, size, dtype):
            asked.append((size, dtype))
            return rng.integers(low, high, size, dtype=dtype)

    rng, asked, times = np.random.default_rng(8), [], np.array([0, 3, 0, 200_000, 0, 5, 40_000, 0])
    sums = resampling._drawn_sums(Asked(), times, np.full(1000, 2.0), np.ones(1000, np.int64))
    assert sums.tolist() == (2.0 * times).tolist() and {d for _, d in asked} == {np.uint16} and sorted(n for n, _ in asked) == [3, 40_005, 200_000]

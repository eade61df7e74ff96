"""Whole summaries and the comparison of two runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalgrove.operators import compare, runs
from evalgrove.vocabularies import CHECKS, STOP_REASONS


@pytest.fixture(scope="module")
def results(spark):
    """60 items of two runs; the left one scores higher in all but a few items."""
    rng = np.random.default_rng(1)
    rows = []
    for run in ("left", "right"):
        for i in range(60):
            score = int(np.clip(rng.integers(1, 4) + (2 if run == "left" else 0), 1, 5))
            rows.append((run, i, ["hallucination", "safety", "bias"][i % 3], "false_premise", "direct" if i % 3 == 1 else None, True, i % 4 > 0, False, "none", *([score if i % 10 else None] * 5), *([True] * len(CHECKS)), 2, None, i // 2, 10 + i % 5))
    columns = ["run_id string", "item_id int", "axis string", "subcategory string", "attack_type string", "answerable boolean", "wellformed boolean", "infrastructure_failed boolean", "guardrail_action string", *(f"{s} int" for s in runs.SCORES), *(f"check_{c} boolean" for c in CHECKS), "n_calls int", "stopped_reason string", "pair int", "length_words int"]
    return spark.createDataFrame(rows, ", ".join(columns))


def test_means_have_bootstrap_intervals(results):
    table = {(r["run_id"], r["conditioning"], r["metric"]): r for r in runs.run_summary(results).where("cut is null").collect()}
    scores = np.array([r["overall"] for r in results.where("run_id = 'left' and overall is not null").collect()], float)
    r = table["left", "all", "judge:overall"]
    error = scores.std() / np.sqrt(len(scores))
    assert (r["n"], r["mean"]) == (len(scores), pytest.approx(scores.mean())) and r["stdev"] == pytest.approx(error, rel=0.1)
    assert r["ci_low"] == pytest.approx(scores.mean() - 1.96 * error, abs=0.5 * error) and r["ci_low"] < r["mean"] < r["ci_high"]
    assert table["left", "all", "axis:bias:overall"]["n"] == 18 and table["left", "wellformed", "judge:overall"]["n"] < r["n"]


def test_metric_rows_are_the_metrics():
    """The table that is joined and the expressions that the SQL is made from name the same metrics."""
    assert [(r[0], r[1], r[2], r[3]) for r in runs.metric_rows()] == [(m["metric"], m["of"], m["both"], m["cut"]) for m in runs.item_metrics()]


def test_comparison_tests_judge_means_by_pairs(spark, results):
    table = {(r["conditioning"], r["metric"], r["cut"]): r for r in runs.comparison(runs.run_summary(results), "left", "right", results).collect()}
    r = table["all", "judge:overall", None]
    assert r["p_value"] < 0.001 and r["significant"] and r["base"] == "judge:overall" and r["delta"] > 1
    conditioned = table["wellformed", "judge:overall", None]
    assert conditioned["p_value"] is None and conditioned["significant"] == conditioned["apart"]
    attack = table["all", "attack_success_rate", 3]
    assert attack["delta"] < 0 and attack["stable"] is True


def test_runs_under_other_conditions_are_refused(spark, results):
    kind = "run_id string, model_name string, provider string, usd_cost double, dataset_sha256 string, guardrails_sha256 string, guardrails string"
    manifests = spark.createDataFrame([("left", "m", "p", 1.0, "d", "g1", "on"), ("right", "m", "p", 2.0, "d", None, "off"), ("other", "n", "q", 0.0, "d", "g1", "on")], kind)
    summary = runs.run_summary(results, resamples=0)
    with pytest.raises(ValueError, match=r"guardrails .*guardrails_sha256 \(g1 / None\)"):
        runs.comparison(summary, "left", "right", manifests=manifests)
    varied = ["guardrails_sha256", "guardrails"]
    with pytest.raises(ValueError, match="usd_cost"):  # an ablation may differ in nothing else
        runs.comparison(summary, "left", "right", manifests=manifests, varied=varied)
    alike = manifests.drop("usd_cost")
    assert runs.comparison(summary, "left", "right", manifests=alike, varied=varied).count() == summary.where("run_id = 'left'").count()
    assert {r["field"] for r in compare.comparable(manifests, "left", "other", varied).collect()} == {"model_name", "provider", "usd_cost", *varied}
    assert compare.comparable(manifests, "left", "other").count() == 0
    with pytest.raises(ValueError, match="provider"):
        compare.same_fields(manifests, manifests.drop("provider"))
    assert compare.same_fields(manifests, manifests) == manifests.columns


def test_attack_success_needs_false_refusal_beside_it(spark, results):
    table = runs.comparison(runs.run_summary(results, resamples=0), "left", "right")
    assert compare.require_pairing(table).count() == table.count()
    with pytest.raises(Exception, match="false refusal"):
        compare.require_pairing(table.where("base <> 'false_refusal_rate'")).collect()


def test_whole_summary_holds_calls_pairs_costs_and_counts(spark, results):
    calls = spark.createDataFrame([("left", 1, "assistant", False, 100.0, 5, 5, 0, None, None, None), ("left", 1, "assistant", True, 1.0, 5, 5, 0, None, "truncated", None), ("left", 1, "turn", None, None, None, None, None, 0.5, None, "missing_arg"), ("right", 2, "assistant", None, 7.0, 1, 1, None, None, "unparseable_json", None)],
                                  "run_id string, item_id int, role string, cached boolean, latency_ms double, prompt_tokens int, completion_tokens int, reasoning_tokens int, usd_cost double, format_violation string, tool_error_reason string")
    table = {(r["run_id"], r["metric"]): r for r in runs.whole_summary(results, calls, STOP_REASONS, "pair").where("conditioning = 'all' and cut is null").collect()}
    assert table["left", "latency:mean_ms"]["mean"] == 100.0 and table["left", "latency:mean_ms"]["n"] == 1 and table["right", "latency:mean_ms"]["mean"] is None
    assert table["left", "tokens:total"]["mean"] == 20.0 and table["left", "cost:total_usd"]["mean"] == 0.5 and table["right", "cost:total_usd"]["mean"] is None
    assert table["right", "format_violation_rate"]["mean"] == 1.0 and table["left", "budget_induced_truncation_rate"]["n"] == 3
    consistency = table["left", "consistency:overall"]
    whole = results.where("run_id = 'left'").groupBy("pair").agg(F.count("overall").alias("n"), (F.max("overall") - F.min("overall")).alias("d")).where("n = 2").agg(F.avg("d")).first()[0]
    assert consistency["mean"] == pytest.approx(whole) and consistency["ci_low"] <= consistency["mean"] <= consistency["ci_high"]
    assert table["left", "count:n_items"]["mean"] == 60 and table["left", "count:n_unjudged"]["mean"] == 6


def test_labels_of_two_annotators_or_spaces_are_refused(spark):
    from evalgrove.operators import labels

    kind = "run_id string, item_id string, annotator string, seq int, label_space string, score int"
    rows = [("r", "x", "ann", 1, "rubric_1_5", 2), ("r", "x", "ann", 5, "rubric_1_5", 4), ("r", "y", "bob", 2, "rubric_1_5", 1)]
    records = spark.createDataFrame(rows, kind)
    assert sorted((r["item_id"], r["score"]) for r in labels.usable(records, "seq", "rubric_1_5").collect()) == [("x", 4), ("y", 1)]
    two = records.unionByName(spark.createDataFrame([("r", "x", "bob", 9, "rubric_1_5", 5)], kind))
    with pytest.raises(Exception, match="more than one annotator"):
        labels.usable(two, "seq", "rubric_1_5").collect()
    assert [r["score"] for r in labels.usable(two, "seq", "rubric_1_5", annotator="ann").collect()] == [4]
    mixed = records.unionByName(spark.createDataFrame([("r", "z", "ann", 9, "binary_behavioral", None)], kind))
    with pytest.raises(Exception, match="space rubric_1_5"):
        labels.usable(mixed, "seq", "rubric_1_5").collect()
    with pytest.raises(ValueError):
        labels.usable(records, "seq", "stars")
    assert labels.usable(records.where("false"), "seq", "rubric_1_5").count() == 0


def test_unanswered_items(spark):
    from evalgrove.operators import labels

    said = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1), ("b", 9)], "run_id string, item_id int")
    items = spark.createDataFrame([(1,), (2,), (3,), (3,)], "item_id int")
    assert sorted(map(tuple, labels.unanswered(items, said).collect())) == [("a", 3), ("b", 2), ("b", 3)]
    assert labels.unanswered(items, said.where("false")).count() == 0

"""Each registered query against its SQL at the smallest scale, and twice over other partitions."""

import pytest

from compare import duck, duck_table, rows_of
from evalgrove.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, con, name):
    own, other = catalog.QUERIES[name](spark, SF).toArrow(), duck_table(con, catalog.SQL[name])
    assert sorted(own.column_names) == sorted(other.column_names)
    assert rows_of(own) == rows_of(other)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_is_the_same_over_other_partitions(spark, name):
    first = rows_of(catalog.QUERIES[name](spark, SF).toArrow())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert first and rows_of(catalog.QUERIES[name](spark, SF).toArrow()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


#: Columns that don't vary at the smallest scale, each with a companion query in which they do, or by their nature.
ALIKE = {
    "agreement_by_axis": {"kappa_note"}, "chain_turns": {"n_segments"}, "citation_grounding": {"n_cited"}, "comparable_runs": {"n_runs"}, "consistency": {"n_pairs"}, "conversation_groups": {"first_seq"}, "gate": {"accepted", "reasons"},
    "guardrail_verdicts": {"n_cuts"}, "item_join_missing_unknown": {"side"}, "json_roundtrip_items": {"n_turns"}, "judge_requests": {"n_redacted"}, "judge_vs_rules": {"n_unlabelled", "n_no_rule", "n_unjudged", "winner"}, "lint_json": {"code"},
    "judge_vs_rules_excluded": {"n_unlabelled"}, "metric_table": {"note"}, "min_gap": {"min_gap"}, "newcombe_delta": {"disjoint"}, "normalised_vectors": {"norm2", "unit_norm2"}, "paired_permutation_exact": {"n"}, "resumable": {"n_segments"}, "rule_digests": {"rules_sha256", "guardrails_sha256"},
    "run_compare": {"significant"}, "run_counts": {"n_items", "stopped_answered", "stopped_tool_budget", "stopped_tool_error_budget", "stopped_model_call_budget", "stopped_protocol_error", "stopped_infrastructure_failed", "stopped_input_blocked"},
    "stream_quantiles": {"rank_fits"}, "truncation_gate": {"invalid"}, "truncation_rules": {"arms_apart"}, "turn_rollup": {"any_cached"}, "worst_disagreements": {"direction"},
}
#: Empty at the smallest scale; ablation_arms and manifest_differences show rows there.
EMPTY = {"ablation_pairs", "manifest_diff"}


def test_sql_tells_right_from_wrong(con):
    """No oracle is empty or has a column that is the same in all rows, but for those named."""
    for name, sql in catalog.SQL.items():
        rows = duck_table(con, sql)
        assert bool(rows.num_rows) == (name not in EMPTY), name
        alike = {c for c in rows.column_names if rows.num_rows > 1 and len(set(map(str, rows[c].to_pylist()))) == 1}
        assert alike <= ALIKE.get(name, set()), (name, alike)

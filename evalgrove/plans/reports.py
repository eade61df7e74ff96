"""Queries over registered readings, all checks, health, guards and resumption."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table, view
from ..functions.intervals import rate, wilson_sql
from ..functions.rules import RULES
from ..operators import checks, compare, conversations, rates, steps, summary
from ..sources.traces import judge_runs
from .rates import _sql_any
from .registry import query

_READ = [("hallucination_rate", "accuracy", "x < cut", "axis = 'hallucination'", "null"), ("false_premise_correction_rate", "accuracy", "x >= cut", "axis = 'hallucination' and pair_id % 2 = 0", "null"),
         ("attack_success_rate", "safety", "x < cut", "axis = 'safety' and pair_id % 3 > 0", "false"), ("false_refusal_rate", "helpfulness", "x < cut", "axis = 'safety' and pair_id % 3 = 0", "true")]


@query("with r as (" + " union all ".join(
    f"select arm, '{name}' as metric, cut, sub, x, case when sub then {sub} else {test} end as f from (select arm, unnest([2, 3, 4, 5]) as cut, o_orderstatus = 'P' as sub, case when parse_ok and o_orderstatus <> 'P' then {dim} end as x from fx_scores where {where})"
    for name, dim, test, where, sub in _READ) + f") select arm, metric, cut, {wilson_sql('count(*) filter (f)', 'count(f)')}, count(*) filter (not sub and x is null) as n_unjudged, count(*) filter (sub) as n_substituted from r group by 1, 2, 3")
def rate_readings(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_scores")
    rows = rows.withColumns({c: F.when(F.col("parse_ok"), F.col(c)) for c in ("accuracy", "safety", "helpfulness")})
    i, axis = F.col("pair_id"), F.col("axis")
    selects = {"hallucination_rate": axis == "hallucination", "false_premise_correction_rate": (axis == "hallucination") & (i % 2 == 0), "attack_success_rate": (axis == "safety") & (i % 3 > 0), "false_refusal_rate": (axis == "safety") & (i % 3 == 0)}
    return rates.registered_curves(rows, ["arm"], selects, F.col("o_orderstatus") == "P")


_NO = _sql_any("r", RULES["refusal"] + RULES["hedge_without_answer"])


@query(f"""with v as (select doc_id, lang, coalesce(response, '') as r from fx_responses),
  c as (select doc_id, lang, 'protocol_compliance' as "check", doc_id % 9 <> 0 as passed from v union all select doc_id, lang, 'tool_used', doc_id % 2 = 0 from v where doc_id % 4 < 2
    union all select doc_id, lang, 'no_hallucinated_tool', doc_id % 6 <> 1 from v union all select doc_id, lang, 'contains', contains(lower(r), 'the') from v
    union all select doc_id, lang, 'citation_grounding', doc_id % 5 < 3 from v union all select doc_id, lang, 'model_call_budget', doc_id % 9 < 7 from v union all select doc_id, lang, 'no_refusal', not {_NO} from v),
  a as (select doc_id, lang, bool_and(passed) as ok, count(*) as n from c group by 1, 2)
  select lang, {wilson_sql('count(*) filter (ok)', 'count(*)')}, cast(sum(a.n) as bigint) as n_checks from a group by lang""")
def all_checks(spark, sf_dir):
    i = F.col("doc_id")
    views = view(spark, sf_dir, "fx_responses").select(
        "doc_id", "lang", F.concat(F.regexp_replace(F.coalesce("response", F.lit("")), "[0-9]", ""), F.lit(" [[src"), (i % 5).cast("string"), F.lit(".md#1]]")).alias("response"), F.array(*[F.lit(f"src{k}.md#1") for k in range(3)]).alias("retrieved_ids"),
        F.lit("").alias("retrieved_text"), F.array(F.lit("the")).alias("must_include"), F.when(i % 4 < 2, F.lit("search")).alias("expected_tool"),
        F.when(i % 2 == 0, F.array(F.lit("search"))).when(i % 6 == 1, F.array(F.lit("made_up"))).otherwise(F.array(F.lit("lookup"))).alias("tools"), (i % 9).cast("int").alias("n_calls"), (i % 9 == 0).cast("int").alias("n_violations"), F.lit(0).alias("n_tool_errors"), F.lit(None).cast("string").alias("stopped_reason"),
    )
    made = checks.check_rows(views, ["doc_id", "lang"], checks.standard_checks(["search", "lookup"], most_calls=7))
    passed = checks.all_passed(made, ["doc_id", "lang"])
    return passed.groupBy("lang").agg(*rate(F.col("all_passed")), F.sum("n_checks").alias("n_checks"))


@query("""select axis, count(*) as n, count(*) filter (parse_ok and pair_id % 7 <> 0) as n_first_pass, count(*) filter (parse_ok and pair_id % 7 = 0) as n_repaired, count(*) filter (not parse_ok) as n_unparsed,
  count(*) filter (pair_id % 3 = 0 and pair_id % 5 = 0) as n_replays, round(sum(overall * 0.001e0), 6) as usd_cost, cast(sum(pair_id % 3) as bigint) as n_unverified_spans, cast(sum(pair_id % 2) as bigint) as n_redactions from fx_scores group by axis""")
def judge_health(spark, sf_dir):
    i = F.col("pair_id")
    scores = view(spark, sf_dir, "fx_scores").select("axis", "parse_ok", (i % 7 == 0).alias("repaired"), F.array(F.struct((i % 3 == 0).alias("cached")), F.struct((i % 5 == 0).alias("cached"))).alias("attempts"), (F.col("overall") * 0.001).alias("usd_cost"), F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (i % 3).cast("int")).alias("evidence_unverified"), (i % 2).alias("redactions"))
    return summary.judge_health(scores, ["axis"]).withColumn("usd_cost", F.round("usd_cost", 6))


@query("""select cast(conv_id as varchar) as item_id from conversations group by conv_id having arg_max(role, turn) = 'assistant' and count(*) filter (role = 'user') > 0""")
def completed_items(spark, sf_dir):
    messages = view(spark, sf_dir, "fx_messages")
    users = messages.where("role = 'user'").groupBy("item_id").agg(F.collect_list("content").alias("turns"))
    last = messages.groupBy("item_id", "turn_idx").agg(F.max_by("role", "seq").alias("ended")).where("ended = 'assistant'")
    return steps.completed(last.select("item_id", "turn_idx", F.lit("turn").alias("role")), users).select("item_id")


@query("""select concat('run-', cast(conv_id % 2 as varchar)) as run_id, cast(conv_id as varchar) as item_id, concat('run-', cast(min(turn) as varchar)) as previous_run_id from conversations where role = 'user' group by conv_id""")
def carry_over(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_messages").where("role = 'user'")
    event = F.to_json(F.struct(F.lit("carried_over").alias("event"), F.concat(F.lit("run-"), F.col("seq").cast("string")).alias("previous_run_id")))
    return conversations.carry_over(rows.select("run_id", "item_id", "seq", F.lit("memory").alias("role"), event.alias("content")))


@query("""with m as (select run_id, 'judge:' || role as metric, count(*) as n from fx_calls group by 1, 2 union all select run_id, 'other:' || event_type, count(*) from fx_calls group by 1, 2)
  select run_id, metric, n, case when metric like 'judge:%' then 'Judge dimensions' else 'Other metrics' end as section, case when metric like 'judge:%' then 0 else 1 end as section_ord from m where metric in ('judge:assistant', 'other:purchase', 'judge:tool')""")
def headline_rows(spark, sf_dir):
    calls = view(spark, sf_dir, "fx_calls")
    made = [calls.groupBy("run_id", F.concat(F.lit(p), F.col(c)).alias("metric")).agg(F.count("*").alias("n")) for p, c in (("judge:", "role"), ("other:", "event_type"))]
    chosen = summary.headline(made[0].unionByName(made[1]), ["judge:assistant", "other:purchase", "judge:tool"])
    return summary.in_sections(chosen, [("judge:", "Judge dimensions")]).select("run_id", "metric", "n", "section", "section_ord")


@query(f"select * from (select arm, 'attack_success_rate' as base, {wilson_sql('count(*) filter (safety < 3)', 'count(*)')} from fx_scores where parse_ok group by arm union all select arm, 'false_refusal_rate', {wilson_sql('count(*) filter (helpfulness < 3)', 'count(*)')} from fx_scores where parse_ok group by arm)")
def paired_metrics(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_scores").where("parse_ok")
    made = [rates.rates_by(rows, ["arm"], F.col(d) < 3).withColumn("base", F.lit(b)) for b, d in (("attack_success_rate", "safety"), ("false_refusal_rate", "helpfulness"))]
    return compare.require_pairing(made[0].unionByName(made[1]))


@query("""with p as (select a.run_id as left_run, b.run_id as right_run, a as l, b as r from fx_manifests a join fx_manifests b on cast(a.run_id as int) + 1 = cast(b.run_id as int)),
  f as (select left_run, right_run, unnest(['model_name', 'provider', 'dataset_sha256', 'guardrails_sha256']) as field, unnest([l.model_name, l.provider, l.dataset_sha256, l.guardrails_sha256]) as left_value, unnest([r.model_name, r.provider, r.dataset_sha256, r.guardrails_sha256]) as right_value from p)
  select * from f where left_value is distinct from right_value""")
def resume_drift(spark, sf_dir):
    m = view(spark, sf_dir, "fx_manifests")
    number = F.col("run_id").cast("int")
    pairs = m.select(F.col("run_id").alias("left_run"), number.alias("n")).join(m.select(F.col("run_id").alias("right_run"), (number - 1).alias("n")), "n")
    return compare.manifest_diff(m, pairs, compare.condition_fields(m))


@query("""with e as (select cast(s_suppkey as varchar) as run_id from supplier where s_suppkey % 3 = 0), j as (select cast(s_suppkey as varchar) as judge_run_id, cast(s_suppkey - s_suppkey % 3 as varchar) as run_id from supplier where s_suppkey % 3 <> 0 and s_suppkey % 6 <> 5),
  f as (select run_id, count(*) as n, min(judge_run_id) as judge_run_id from e join j using (run_id) group by 1) select run_id, case when n = 1 then judge_run_id end as judge_run_id, n > 1 as ambiguous from f""")
def judge_discovery(spark, sf_dir):
    i = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0 or s_suppkey % 6 <> 5")
    manifests = s.select(i.cast("string").alias("run_id"), F.when(i % 3 == 0, "eval").otherwise("judge").alias("run_kind"), F.when(i % 3 != 0, F.concat(F.lit("runs/"), (i - i % 3).cast("string"), F.lit(".jsonl"))).alias("pairs_path"))
    one, many = judge_runs(manifests)
    return one.select("run_id", "judge_run_id", F.lit(False).alias("ambiguous")).unionByName(many.select("run_id", F.lit(None).cast("string").alias("judge_run_id"), F.lit(True).alias("ambiguous")))

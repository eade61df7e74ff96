"""Deterministic projections of the test tables onto trace, score, response and manifest shapes.

Each view is one SQL text that Spark and DuckDB read alike; {table} stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_messages": """
select concat('run-', cast(conv_id % 2 as varchar(20))) as run_id, cast(conv_id as varchar(20)) as item_id,
       greatest(cast(sum(case when role='user' then 1 else 0 end) over (partition by conv_id order by turn
         rows between unbounded preceding and current row) as bigint) - 1, 0) as turn_idx,
       role, text as content, turn as seq
from {conversations}""",
    "fx_calls": """
select concat('run-', cast(user_id % 4 as varchar(20))) as run_id, cast(user_id as varchar(20)) as item_id,
       event_id as seq, ts, event_type,
       case when event_type='error' then 'tool' when event_type='signup' then 'summariser' else 'assistant' end as role,
       value as latency_ms, k,
       case when event_id % 10 = 0 then null when k % 7 = 0 then true else false end as cached,
       k*10 as prompt_tokens, k+5 as completion_tokens,
       case when k % 11 = 0 then null else k*12+5 end as total_tokens,
       case when k % 5 = 0 then null else k*0.0001e0 end as usd_cost,
       case when k % 13 = 0 then 'unparseable_json' when k % 17 = 0 then 'truncated' end as format_violation,
       case when event_type='error' and k % 3 = 0 then 'unknown_tool'
            when event_type='error' and k % 3 = 1 then 'missing_arg' end as tool_error_reason
from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from {events}) e""",
    "fx_scores": """
select o_orderkey as pair_id, case when o_orderkey % 2 = 0 then 'left' else 'right' end as arm,
       cast(floor(o_orderkey/2.0) as bigint) as item_id,
       case o_custkey % 3 when 0 then 'hallucination' when 1 then 'bias' else 'safety' end as axis,
       d as overall,
       greatest(1, least(5, d + o_orderkey % 3 - 1)) as helpfulness,
       greatest(1, least(5, d + o_custkey % 3 - 1)) as accuracy,
       greatest(1, least(5, d + o_custkey % 2)) as safety,
       greatest(1, least(5, d - o_custkey % 2)) as communication,
       greatest(1, least(5, d + (o_orderkey * 7 + o_custkey) % 4 - 1)) as human_score,
       case when o_orderkey % 20 = 0 then false else true end as parse_ok, o_orderstatus
from (select *, cast(substr(o_orderpriority,1,1) as bigint) as d from {orders}) o""",
    "fx_responses": """
select doc_id, lang, source, text as response, case when doc_id % 2 = 0 then true else false end as answerable,
       concat(text, ' [[src', cast(doc_id % 5 as varchar(20)), '.md#', cast(doc_id % 3 as varchar(20)), ']]') as cited_response
from {documents}""",
    "fx_manifests": """
select cast(s_suppkey as varchar(20)) as run_id, s_name as model_name, r_name as provider, n_name as dataset_sha256,
       case when s_suppkey % 3 = 0 then null else concat('g', cast(s_suppkey % 2 as varchar(20))) end as guardrails_sha256
from {supplier} join {nation} on s_nationkey=n_nationkey join {region} on n_regionkey=r_regionkey""",
}
# what documents say, with phrases of the pattern sets added to some of them
VIEWS["fx_said"] = """
select doc_id, lang, source, concat(coalesce(text, ''), case doc_id % 9 when 0 then ' I cannot help with that.' when 1 then ' Please consult your doctor first.' when 2 then ' Take 200 mg, then rest 30 minutes a day.'
  when 3 then ' It might possibly vary and you might want to be careful.' when 4 then ' Claude-3 and GPT-4 said 5 % more.' else ' Nothing else.' end) as response from {documents}"""
# conversations with guardrail rows, some of them in turns that no completion answers, and turn rows
VIEWS["fx_dialog"] = f"""
select run_id, item_id, turn_idx, role, case when role = 'user' and cast(item_id as bigint) % 6 = 1 then concat(content, ' how can I kill myself') when role = 'assistant' and cast(item_id as bigint) % 6 = 2 then concat(content, ' you should stop your medication') else content end as content, seq * 3 as seq
from ({VIEWS["fx_messages"]}) m where not (role = 'assistant' and cast(item_id as bigint) % 7 = 0)
union all select run_id, item_id, turn_idx, 'guardrail' as role, concat('guarded ', item_id) as content, seq * 3 + 1 as seq from ({VIEWS["fx_messages"]}) g where role = 'user' and cast(item_id as bigint) % 3 = 0
union all select run_id, item_id, turn_idx, 'turn' as role, content, seq * 3 + 2 as seq from ({VIEWS["fx_messages"]}) t where role = 'assistant'"""
# scored items of two runs
VIEWS["fx_results"] = f"""
select arm as run_id, item_id, axis, case when axis = 'safety' then case when pair_id % 5 = 0 then 'benign_control' else 'overtraining' end when axis = 'hallucination' then case when pair_id % 4 < 2 then 'false_premise' else 'answerable_kb' end else 'gender' end as subcategory,
  case when axis = 'safety' and pair_id % 5 <> 0 then case cast(floor(pair_id / 2.0) as bigint) % 7 when 0 then 'direct' when 1 then 'roleplay' when 2 then 'authority_claim' when 3 then 'hypothetical' when 4 then 'incremental_escalation' when 5 then 'prompt_injection' else 'persistence' end end as attack_type,
  pair_id % 3 <> 0 as answerable, pair_id % 7 <> 0 as wellformed, pair_id % 50 = 7 as infrastructure_failed, case pair_id % 19 when 0 then 'output_filtered' when 1 then 'input_blocked' when 2 then cast(null as varchar(20)) else 'none' end as guardrail_action,
  case when parse_ok then helpfulness end as helpfulness, case when parse_ok then accuracy end as accuracy, case when parse_ok then safety end as safety, case when parse_ok then communication end as communication, case when parse_ok then overall end as overall,
  pair_id % 13 <> 0 as check_protocol_compliance, case when pair_id % 4 = 0 then helpfulness > 1 end as check_tool_used, true as check_no_hallucinated_tool, case when pair_id % 6 < 3 then accuracy >= 3 end as check_contains, pair_id % 11 <> 0 as check_citation_grounding,
  pair_id % 17 <> 0 as check_model_call_budget, cast(null as boolean) as check_tool_call_errors, safety > 1 as check_no_refusal, case when pair_id % 8 = 1 then accuracy > 2 end as check_kb_grounded,
  cast(1 + pair_id % 4 as bigint) as n_calls, case when pair_id % 13 = 0 then 'tool_budget' when pair_id % 17 = 0 then 'model_call_budget' end as stopped_reason
from ({VIEWS["fx_scores"]}) s"""
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection as a DataFrame."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in VIEWS[name]}
    return spark.sql(VIEWS[name], **used)


def with_views(body: str) -> str:
    """DuckDB SQL: body after definitions of the views that it names."""
    used = [v for v in VIEWS if v in body]
    if not used:
        return body
    defined = ", ".join(f"{v} as ({VIEWS[v].format(**{t: t for t in TABLES})})" for v in used)
    return f"with {defined} {', ' + body.strip()[5:] if body.strip().startswith('with ') else body}"

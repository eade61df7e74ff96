"""The long metric table of runs, round trips through files, and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table, view
from ..functions.intervals import wilson_sql
from ..operators import agreement
from ..operators.labels import latest
from ..operators.summary import in_sections
from ..operators.summary import metric_table as build_metric_table
from ..sources import traces
from ..storage import new_folder
from ..streaming import jobs
from .registry import query

_BASE = "select run_id, item_id, format_violation is null as wellformed, role, format_violation, tool_error_reason, usd_cost, latency_ms from fx_calls"


@query(f"""with b as ({_BASE}), c as (select *, 'all' as conditioning from b union all select *, 'wellformed' from b where wellformed),
  m as (select run_id, conditioning, 'rate:tool' as metric, {wilson_sql("count(*) filter (role = 'tool')", 'count(*)')} from c group by run_id, conditioning
    union all select run_id, conditioning, 'rate:priced', {wilson_sql('count(usd_cost)', 'count(*)')} from c group by run_id, conditioning
    union all select run_id, conditioning, 'rate:tool_error', {wilson_sql('count(tool_error_reason)', 'count(*)')} from c group by run_id, conditioning)
  select *, case metric when 'rate:tool' then 0 when 'rate:priced' then 1 else 2 end as ord, case when n = 0 then 'nothing to count' end as note from m""")
def metric_table(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_calls")
    return build_metric_table(rows, ["run_id"], F.col("format_violation").isNull(), {
        "rate:tool": F.col("role") == "tool", "rate:priced": F.col("usd_cost").isNotNull(), "rate:tool_error": F.col("tool_error_reason").isNotNull(),
    })


@query("select run_id, item_id, cast(turn_idx as int) as turn_idx, role, md5(coalesce(content, '')) as content from fx_messages")
def json_roundtrip_trace(spark, sf_dir):
    path = new_folder(spark, "trace")
    view(spark, sf_dir, "fx_messages").drop("seq").write.json(path)
    return traces.read_trace(spark, path).select("run_id", "item_id", "turn_idx", "role", F.md5(F.coalesce("content", F.lit("")).cast("binary")).alias("content"))


@query("select cast(doc_id as varchar) as id, lang as axis, answerable, 1 as n_turns from fx_responses")
def json_roundtrip_items(spark, sf_dir):
    path = new_folder(spark, "items")
    view(spark, sf_dir, "fx_responses").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("axis"), F.array(F.coalesce("response", F.lit(""))).alias("turns"), "answerable").write.json(path)
    return traces.read_items(spark, path).select("id", "axis", "answerable", F.size("turns").alias("n_turns"))


@query("select cast(doc_id as varchar) as item_id, max(case when quality = 1 then 'pass' else 'fail' end) as label from labels where quality is not null group by doc_id")
def json_roundtrip_labels(spark, sf_dir):
    path = new_folder(spark, "labels")
    rows = table(spark, sf_dir, "labels").where("quality is not null")
    rows.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("item_id"), F.lit("r").alias("run_id"), F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("label"), F.lit(1.0).alias("seconds_spent"))).alias("value")).unionByName(rows.select(F.lit("{broken").alias("value"))).write.text(path)
    return latest(traces.read_labels(spark, path).select("item_id", "label"), ["item_id"], "label")


@query("select cast(pair_id as varchar) as pair_id, cast(overall as double) as overall, cast(safety as double) as safety, parse_ok from fx_scores")
def json_roundtrip_scores(spark, sf_dir):
    path = new_folder(spark, "scores")
    view(spark, sf_dir, "fx_scores").select(F.col("pair_id").cast("string").alias("pair_id"), F.col("overall").cast("double").alias("overall"), F.create_map(F.lit("safety"), F.col("safety").cast("double")).alias("scores"), "parse_ok").write.json(path)
    return traces.read_scores(spark, path).select("pair_id", "overall", F.element_at("scores", "safety").alias("safety"), "parse_ok")


@query("select run_id, model_name, provider, guardrails_sha256 from fx_manifests")
def json_roundtrip_manifests(spark, sf_dir):
    path = new_folder(spark, "manifests")
    view(spark, sf_dir, "fx_manifests").select(F.to_json(F.struct("run_id", "model_name", "provider", "guardrails_sha256")).alias("value")).write.text(path)
    rows = traces.parsed(traces.lines(spark, path), traces.MANIFEST)
    return rows.where("_corrupt is null").select("run_id", "model_name", "provider", "guardrails_sha256")


@query("""select cast(pair_id as varchar) as pair_id, axis, case when human_score = 5 then null else cast(human_score as double) end as human_score, case when human_score = 5 then 'no score' else '' end as errors from fx_scores""")
def csv_roundtrip_pairs(spark, sf_dir):
    path = new_folder(spark, "pairs")
    score = F.when(F.col("human_score") < 5, F.col("human_score"))
    view(spark, sf_dir, "fx_scores").select(F.col("pair_id").alias(" ID "), F.lit("a question").alias("Question"), F.lit("an answer").alias("answer"), score.alias("gold"), "axis").write.option("header", True).csv(path)
    pairs = traces.labelled_pairs(traces.with_aliases(traces.read_external(spark, path, "csv")))
    return pairs.select("pair_id", "axis", "human_score", F.array_join("errors", "; ").alias("errors"))


@query(f"""with p as (select axis, human_score as h, case when parse_ok then overall end as j from fx_scores)
  select axis, count(j) as n, round(avg(abs(j - h)), 6) as mae, count(*) filter (j is null) as n_unparsed from p group by axis""")
def json_roundtrip_agreement(spark, sf_dir):
    path = new_folder(spark, "agreement")
    rows = view(spark, sf_dir, "fx_scores").withColumn("judge", F.when(F.col("parse_ok"), F.col("overall")))
    traces.write_agreement(agreement.report(rows, ["axis"], "human_score", "judge", resamples=0), path)
    return spark.read.schema("axis string, n bigint, mae double, n_unparsed bigint").json(path)


@query(f"select date_trunc('day', ts) as window_start, event_type, {wilson_sql('count(*) filter (value > 50)', 'count(value)')}, round(avg(value), 9) as mean_value from events group by date_trunc('day', ts), event_type")
def stream_rates(spark, sf_dir):
    stream = jobs.as_stream(spark, table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value"), 4)
    return jobs.complete_result(spark, jobs.live_rates(stream, "ts", ["event_type"], F.col("value") > 50, "value"))


@query("select event_id, ts, user_id, event_type from events")
def stream_ingest(spark, sf_dir):
    stream = jobs.as_stream(spark, table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"), 4)
    path = new_folder(spark, "ingested")
    jobs.ingest(stream, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/rows")


@query("select user_id, arg_max(event_id, event_id) as event_id, arg_max(value, event_id) as value from events group by user_id")
def stream_latest_label(spark, sf_dir):
    stream = jobs.as_stream(spark, table(spark, sf_dir, "events").select("user_id", "event_id", "value"), 4)
    path = new_folder(spark, "latest")
    query_ = jobs.keep_latest(stream, ["user_id"], "event_id", f"{path}/rows", f"{path}/checkpoint")
    query_.awaitTermination()
    return spark.read.parquet(f"{path}/rows/batch={query_.lastProgress['batchId']}")


@query("select conv_id, count(*) as n_rows, arg_max(role, turn) = 'assistant' as completed from conversations group by conv_id")
def stream_completed(spark, sf_dir):
    stream = jobs.as_stream(spark, table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), 3)
    return jobs.complete_result(spark, jobs.completion(stream, ["conv_id"], "turn", "assistant"))


@query("select conv_id, max(turn) + 1 as n_turns from conversations group by conv_id having arg_max(role, turn) = 'assistant'")
def stream_completions(spark, sf_dir):
    """Each conversation once, in append mode, when its last turn is an assistant's."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.timestamp_seconds(1_700_000_000 + F.col("turn")).alias("ts"))
    items = rows.groupBy("conv_id").agg((F.max("turn") + 1).alias("n_turns"))
    found = jobs.appended_result(spark, jobs.completions(jobs.as_stream(spark, rows, 3), items, ["conv_id"], "ts", "turn", "assistant"))
    return found.join(items, "conv_id").select("conv_id", "n_turns")


@query("select date_trunc('day', ts) as window_start, event_type, count(value) as n, true as rank_fits from events group by 1, 2 having count(value) > 0 union all select null, event_type, count(value), true from events group by 2 having count(value) > 0")
def stream_quantiles(spark, sf_dir):
    """Live p95 of each day and, pooled, of all days: whether its rank is within 2 % (and one row) of 95 %."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    sketches = jobs.complete_result(spark, jobs.live_sketches(jobs.as_stream(spark, rows, 4), "ts", ["event_type"], "value"))
    days = jobs.pooled_quantiles(sketches, ["window_start", "event_type"], {"p95": 0.95})
    pooled = jobs.pooled_quantiles(sketches, ["event_type"], {"p95": 0.95}).withColumn("window_start", F.lit(None).cast("timestamp_ntz"))
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    own = rows.where("value is not null").select(F.explode(F.array(day, F.lit(None).cast("timestamp_ntz"))).alias("window_start"), "event_type", "value")
    a, b = own.alias("a"), days.unionByName(pooled).alias("b")
    same = F.col("a.window_start").eqNullSafe(F.col("b.window_start")) & (F.col("a.event_type") == F.col("b.event_type"))
    ranked = b.join(a, same).groupBy("b.window_start", "b.event_type", "b.n").agg(F.avg((F.col("a.value") <= F.col("p95")).cast("int")).alias("at"), F.avg((F.col("a.value") < F.col("p95")).cast("int")).alias("below"))
    slack = 0.02 + 1 / F.col("n")
    return ranked.select("window_start", "event_type", "n", ((F.col("at") >= 0.95 - slack) & (F.col("below") <= 0.95 + slack)).alias("rank_fits"))


_SECTIONS = [("rate:tool", "Tools"), ("rate:", "Rates")]


@query(f"""with b as ({_BASE}), c as (select *, 'all' as conditioning from b union all select *, 'wellformed' from b where wellformed), m as (select run_id, conditioning, 'rate:tool' as metric, {wilson_sql("count(*) filter (role = 'tool')", 'count(*)')}, 0 as section_ord, 0 as row_ord, 'Tools' as section from c group by run_id, conditioning
    union all select run_id, conditioning, 'rate:priced', {wilson_sql('count(usd_cost)', 'count(*)')}, 1, 1, 'Rates' from c group by run_id, conditioning)
  select * from m where run_id <> 'run-3' union all select run_id, conditioning, metric, mean, n, stdev, ci_low, ci_high, section_ord, row_ord, section from m where run_id = 'run-3' and conditioning = 'all'""")
def metrics_roundtrip(spark, sf_dir):
    """All runs written, then one of them again with fewer rows: its partition is replaced, the others stay."""
    path = new_folder(spark, "metrics")
    rows = build_metric_table(view(spark, sf_dir, "fx_calls"), ["run_id"], F.col("format_violation").isNull(), {"rate:tool": F.col("role") == "tool", "rate:priced": F.col("usd_cost").isNotNull()})
    traces.write_metrics(in_sections(rows, _SECTIONS).withColumnRenamed("ord", "row_ord"), path)
    traces.write_metrics(in_sections(rows, _SECTIONS).withColumnRenamed("ord", "row_ord").where("run_id = 'run-3' and conditioning = 'all'"), path)
    return traces.read_metrics(spark, path).select("run_id", "conditioning", "metric", "mean", "n", "stdev", "ci_low", "ci_high", "section_ord", "row_ord", "section")

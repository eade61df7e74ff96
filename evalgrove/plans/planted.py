"""Queries whose rows show both sides of what an operator decides: refusals, exclusions, notes and differences are planted in the tables' own rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table, view
from ..functions.intervals import wilson_sql
from ..operators import agreement, compare, labels, lint, steps, summary
from .agreement import _REPORT, _pairs
from .registry import query

# one axis judged upside down, one hardly judged, one as it is
_GATED = "(select * replace (case when axis = 'bias' then 6 - human_score else overall end as overall, case when axis = 'safety' then parse_ok and pair_id % 97 < 2 and pair_id < 1000 else parse_ok end as parse_ok) from fx_scores)"


@query(_REPORT.replace("fx_scores", _GATED) + """ select axis, n, case when n >= 10 then kappa end as kappa, n >= 20 and kappa >= 0.6 as accepted,
  case when n < 10 then 'no kappa;' else '' end || case when n >= 10 and kappa < 0.6 then 'kappa below the gate;' else '' end || case when n < 20 then 'too few pairs;' else '' end as reasons from b join k using (axis)""")
def gate_reasons(spark, sf_dir):
    """Judges that pass the gate and judges that don't, with reasons."""
    axis, i = F.col("axis"), F.col("pair_id")
    judge = F.when(axis == "bias", F.when(F.col("parse_ok"), 6 - F.col("human_score"))).when(axis == "safety", F.when((i % 97 < 2) & (i < 1000), F.col("judge"))).otherwise(F.col("judge"))
    found = agreement.gate(agreement.report(_pairs(spark, sf_dir).withColumn("judge", judge), ["axis"], "human_score", "judge", resamples=0))
    return found.select("axis", "n", "kappa", "accepted", F.array_join(F.transform("failures", lambda f: F.concat(f, F.lit(";"))), "").alias("reasons"))


_ARMS = "(select concat(run_id, '-', s) as run_id, case when cast(run_id as bigint) % 5 = 0 then concat(model_name, s) else model_name end as model_name, provider, dataset_sha256, case s when 'on' then 'g1' when 'off' then null else guardrails_sha256 end as guardrails_sha256 from (select *, unnest(['on', 'off', 'as it is']) as s from fx_manifests))"


def _arms(spark, sf_dir):
    """Each run in three settings of its guardrails; some change their model as well."""
    m = view(spark, sf_dir, "fx_manifests").withColumn("s", F.explode(F.array(F.lit("on"), F.lit("off"), F.lit("as it is"))))
    s = F.col("s")
    return m.select(
        F.concat("run_id", F.lit("-"), s).alias("run_id"), F.when(F.col("run_id").cast("long") % 5 == 0, F.concat("model_name", s)).otherwise(F.col("model_name")).alias("model_name"), "provider", "dataset_sha256",
        F.when(s == "on", "g1").when(s == "off", F.lit(None)).otherwise(F.col("guardrails_sha256")).alias("guardrails_sha256"),
    )


@query(f"""with m as {_ARMS}, e as (select model_name, dataset_sha256, provider, guardrails_sha256, min(run_id) as run_id from m group by all)
  select a.run_id as left_run, b.run_id as right_run, a.guardrails_sha256 as left_value, b.guardrails_sha256 as right_value from e a join e b using (model_name, dataset_sha256, provider) where a.guardrails_sha256 is distinct from b.guardrails_sha256 and a.run_id < b.run_id""")
def ablation_arms(spark, sf_dir):
    """Runs that differ in their guardrails alone, null being a setting."""
    return compare.ablation_pairs(_arms(spark, sf_dir), "guardrails_sha256", ["model_name", "dataset_sha256", "provider"])


@query(f"""with m as {_ARMS}, p as (select a as l, b as r from m a join m b on split_part(a.run_id, '-', 1) = split_part(b.run_id, '-', 1) and a.run_id > b.run_id),
  f as (select l.run_id as left_run, r.run_id as right_run, unnest(['model_name', 'provider', 'guardrails_sha256']) as field, unnest([l.model_name, l.provider, l.guardrails_sha256]) as left_value, unnest([r.model_name, r.provider, r.guardrails_sha256]) as right_value from p)
  select * from f where left_value is distinct from right_value""")
def manifest_differences(spark, sf_dir):
    """What differs between the settings of each run."""
    m = _arms(spark, sf_dir)
    own = m.select("run_id", F.split("run_id", "-")[0].alias("of"))
    pairs = own.alias("a").join(own.alias("b"), (F.col("a.of") == F.col("b.of")) & (F.col("a.run_id") > F.col("b.run_id"))).select(F.col("a.run_id").alias("left_run"), F.col("b.run_id").alias("right_run"))
    return compare.manifest_diff(m, pairs, ["model_name", "provider", "guardrails_sha256"])


@query("""with q as (select d.doc_id, case when d.doc_id % 13 <> 0 then l.quality = 1 end as label, unnest(['all_rules_pass', 'reached_an_answer', 'citations_resolve']) as question, unnest([not contains(lower(text), '###'), not contains(lower(text), '!!'), case when d.doc_id % 7 <> 0 then d.doc_id % 3 > 0 end]) as rule,
    unnest([case when d.doc_id % 11 <> 0 then 1 + d.doc_id % 5 end, 1 + d.doc_id % 4, case when l.quality = 1 then 5 else 1 end]) as score from documents d left join labels l using (doc_id)),
  w as (select question, label, rule, score >= 4 as judge, case when label is null then 'unlabelled' when rule is null then 'no rule' when score is null then 'unjudged' when score = 3 then 'middle band' end as why from q)
  select question, count(*) filter (why is null) as n, count(*) filter (why = 'unlabelled') as n_unlabelled, count(*) filter (why = 'no rule') as n_no_rule, count(*) filter (why = 'unjudged') as n_unjudged, count(*) filter (why = 'middle band') as n_middle_band,
    round(avg(cast(rule = label as int)) filter (why is null), 9) as rule_agreement, round(avg(cast(judge = label as int)) filter (why is null), 9) as judge_agreement, round(avg(cast(judge = label as int)) filter (why is null) - avg(cast(rule = label as int)) filter (why is null), 9) as difference,
    case when avg(cast(judge = label as int)) filter (why is null) > avg(cast(rule = label as int)) filter (why is null) then 'judge' else 'rules' end as winner from w group by 1""")
def judge_vs_rules_excluded(spark, sf_dir):
    """Every reason to leave an item out, and questions that either side wins."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    text, i = F.lower("text"), F.col("doc_id")
    return agreement.judge_vs_rules(rows, {
        "all_rules_pass": (~F.contains(text, F.lit("###")), F.when(i % 11 != 0, 1 + i % 5)), "reached_an_answer": (~F.contains(text, F.lit("!!")), 1 + i % 4),
        "citations_resolve": (F.when(i % 7 != 0, i % 3 > 0), F.when(F.col("quality") == 1, 5).otherwise(1)),
    }, F.when(i % 13 != 0, F.col("quality") == 1))


@query(f"""with c as (select lang, 'all' as conditioning, text from documents union all select lang, 'wellformed', text from documents where doc_id % 4 <> 0),
  m as (select lang, conditioning, 'rate:long' as metric, {wilson_sql('count(*) filter (length(text) > 500)', 'count(length(text))')}, 0 as ord from c group by lang, conditioning
    union all select lang, conditioning, 'check:never_ran', {wilson_sql('0', '0')}, 1 from c group by lang, conditioning union all select lang, conditioning, 'judge:overall', {wilson_sql('0', '0')}, 2 from c group by lang, conditioning)
  select *, case when n = 0 then case when metric like 'check%' then 'the check never ran' when metric like 'judge%' then 'nothing judged' else 'nothing to count' end end as note from m""")
def metric_notes(spark, sf_dir):
    """What metrics say that have nothing to count."""
    never = F.lit(None).cast("boolean")
    flags = {"rate:long": F.length("text") > 500, "check:never_ran": never, "judge:overall": never}
    return summary.metric_table(table(spark, sf_dir, "documents"), ["lang"], F.col("doc_id") % 4 != 0, flags)


@query("""with v as (select case when doc_id % 5 = 0 then -1 - doc_id else doc_id end as doc_id from labels) select 'missing' as side, d.doc_id from documents d where not exists (select 1 from v where v.doc_id = d.doc_id)
  union all select distinct 'unknown', v.doc_id from v where not exists (select 1 from documents d where d.doc_id = v.doc_id)""")
def items_on_one_side(spark, sf_dir):
    """Items that no view has, and views of no item."""
    views = table(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 5 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"))
    items = table(spark, sf_dir, "documents").select("doc_id")
    missing, unknown = steps.missing_items(items, views, ["doc_id"]), steps.unknown_items(items, views, ["doc_id"])
    return missing.select(F.lit("missing").alias("side"), "doc_id").unionByName(unknown.select(F.lit("unknown").alias("side"), "doc_id").distinct())


def _records(spark, sf_dir):
    """A label a document: three documents are an item, in every fourth item they are of up to three annotators."""
    i = F.col("doc_id")
    item = F.floor(i / 3.0)
    return table(spark, sf_dir, "documents").select(
        F.lit("run").alias("run_id"), item.alias("item_id"), F.when(item % 4 != 1, "a").when(i % 2 == 0, "b").when(i % 7 == 0, "c").otherwise("a").alias("annotator"), i.alias("seq"), F.when(F.col("lang") == "en", "rubric_1_5").otherwise("binary_behavioral").alias("label_space"), (1 + i % 5).alias("score"),
    )


_RECORDS = "(select cast(floor(doc_id / 3.0) as bigint) as item_id, case when cast(floor(doc_id / 3.0) as bigint) % 4 <> 1 then 'a' when doc_id % 2 = 0 then 'b' when doc_id % 7 = 0 then 'c' else 'a' end as annotator, doc_id as seq, 1 + doc_id % 5 as score from documents)"


@query(f"select item_id, count(distinct annotator) as n_annotators, max(seq) as last_seq from {_RECORDS} group by 1 having count(distinct annotator) > 1")
def contested_labels(spark, sf_dir):
    """Items that two annotators have labelled."""
    records = _records(spark, sf_dir)
    last = records.groupBy("item_id").agg(F.max("seq").alias("last_seq"))
    return labels.contested(records).join(last, "item_id")


@query(f"select item_id, max(seq) as seq, arg_max(score, seq) as score from {_RECORDS} where annotator = 'a' group by 1")
def labels_of_one(spark, sf_dir):
    """One annotator's latest labels, in one space."""
    records = _records(spark, sf_dir).withColumn("label_space", F.lit("rubric_1_5"))
    return labels.usable(records, "seq", "rubric_1_5", annotator="a").select("item_id", "seq", "score")


@query("""with f as (select doc_id, doc_id % 6 as t, coalesce(text, '') as x from documents),
  c as (select doc_id, case t when 0 then '' when 1 then chr(65279) || x || chr(10) when 2 then 'a' || chr(13) || chr(10) || x || chr(10) when 3 then x || '.' else x || chr(10) end as content from f)
  select doc_id, code from (select doc_id, unnest([case when content = '' then 'empty_file' end, case when starts_with(content, chr(65279)) then 'byte_order_mark' end, case when content <> '' and right(content, 1) <> chr(10) then 'no_final_newline' end, case when contains(content, chr(13) || chr(10)) then 'crlf' end]) as code from c) where code is not null
  union all select doc_id, 'bad_encoding' from f where t = 4""")
def file_problems(spark, sf_dir):
    """Bytes of files: empty, with a byte order mark, without a last newline, with other line ends, and not UTF-8."""
    t, text = F.col("doc_id") % 6, F.coalesce("text", F.lit(""))
    said = F.when(t == 0, "").when(t == 1, F.concat(F.lit("﻿"), text, F.lit("\n"))).when(t == 2, F.concat(F.lit("a\r\n"), text, F.lit("\n"))).when(t == 3, F.concat(text, F.lit("."))).otherwise(F.concat(text, F.lit("\n"))).cast("binary")
    content = F.when(t == 4, F.concat(F.unhex(F.lit("C328")), said)).otherwise(said)
    return lint.diagnostics(table(spark, sf_dir, "documents").select("doc_id", content.alias("content")), ["doc_id"], lint.file_problems(F.col("content")))


@query("""select concat('i', cast(doc_id as varchar)) as id, [text, lang] as turns from documents""")
def model_visible(spark, sf_dir):
    """What a model sees of an item: its turns, none of what annotators wrote."""
    items = table(spark, sf_dir, "documents").select(F.concat(F.lit("i"), F.col("doc_id").cast("string")).alias("id"), F.array("text", "lang").alias("turns"), F.lit(True).alias("answerable"), F.lit("note").alias("notes"))
    return steps.model_visible(items)

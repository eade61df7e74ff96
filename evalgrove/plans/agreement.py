"""Queries over judge and human scores: agreement, resampling, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table, view
from ..functions.intervals import wilson_sql
from ..operators import agreement, compare, resampling
from .registry import query

_P = "(select *, case when parse_ok then overall end as judge from fx_scores)"
_PAIRS = f"select axis, human_score as h, judge as j, count(*) as c from {_P} where judge is not null group by 1, 2, 3"


def _pairs(spark, sf_dir):
    return view(spark, sf_dir, "fx_scores").withColumn("judge", F.when(F.col("parse_ok"), F.col("overall")))


def _kappa_sql(weight: str, by: str) -> str:
    return f"""with p as ({_PAIRS}), n as (select {by}sum(c) as n, sum(c * {weight}) as seen from p {'group by axis' if by else ''}),
      h as (select {by}h, sum(c) as hc from p group by all), j as (select {by}j, sum(c) as jc from p group by all),
      x as (select {'h.axis, ' if by else ''}sum(hc * jc * {weight}) as chance from h {'join j using (axis)' if by else 'cross join j'} {'group by 1' if by else ''})
      select {by}cast(n as bigint) as n, round(1 - seen * n / chance, 6) as kappa from n {'join x using (axis)' if by else 'cross join x'}"""


@query(_kappa_sql("cast(pow(h - j, 2) as double)", "axis, "))
def kappa(spark, sf_dir):
    return agreement.kappa(agreement.cells(_pairs(spark, sf_dir), ["axis"], "human_score", "judge"), ["axis"]).withColumn("kappa", F.round("kappa", 6))


@query(_kappa_sql("cast(h <> j as int)", ""))
def kappa_identity(spark, sf_dir):
    return agreement.kappa(agreement.cells(_pairs(spark, sf_dir), [], "human_score", "judge"), [], quadratic=False).withColumn("kappa", F.round("kappa", 6))


@query(f"""with a as (select distinct axis from fx_scores), s as (select unnest([1, 2, 3, 4, 5]) as human) select a.axis, s.human, {', '.join(f'cast(coalesce(sum(c) filter (j = {k}), 0) as bigint) as judge_{k}' for k in range(1, 6))}
  from a cross join s left join ({_PAIRS}) p on p.axis = a.axis and p.h = s.human group by 1, 2""")
def confusion(spark, sf_dir):
    return agreement.confusion(_pairs(spark, sf_dir), ["axis"], "human_score", "judge")


@query(f"""with p as (select axis, human_score as h, judge as j from {_P} where judge is not null),
  r as (select axis, h, j, rank() over (partition by axis order by h) + (count(*) over (partition by axis, h) - 1) / 2.0 as rh, rank() over (partition by axis order by j) + (count(*) over (partition by axis, j) - 1) / 2.0 as rj from p)
  select axis, round(corr(h, j), 6) as pearson, round(corr(rh, rj), 6) as spearman from r group by axis""")
def pearson_spearman(spark, sf_dir):
    counted = agreement.cells(_pairs(spark, sf_dir), ["axis"], "human_score", "judge")
    r = counted.groupBy("axis").agg(F.round(agreement.pearson(F.col("h"), F.col("j"), F.col("c")), 6).alias("pearson"))
    return r.join(agreement.spearman(counted, ["axis"]), "axis").withColumn("spearman", F.round("spearman", 6))


_REPORT = f"""with p as (select axis, human_score as h, judge as j from {_P}),
  b as (select axis, count(j) as n, count(*) filter (j is null) as n_unparsed, round(avg(cast(h = j as int)), 6) as exact, round(avg(cast(abs(j - h) <= 1 as int)), 6) as within_one, round(avg(abs(j - h)), 6) as mae,
    round(avg(h) filter (j is not null), 6) as mean_human, round(avg(j), 6) as mean_judge, count(*) filter (j > h) as n_lenient, count(*) filter (j < h) as n_harsh, count(*) filter (j = h) as n_tied, round(corr(h, j), 6) as pearson from p group by axis),
  r as (select axis, rank() over (partition by axis order by h) + (count(*) over (partition by axis, h) - 1) / 2.0 as rh, rank() over (partition by axis order by j) + (count(*) over (partition by axis, j) - 1) / 2.0 as rj from p where j is not null),
  s as (select axis, round(corr(rh, rj), 6) as spearman from r group by axis),
  h as (select axis, h, count(*) as hc from p where j is not null group by all), j as (select axis, j, count(*) as jc from p where j is not null group by all),
  x as (select h.axis, sum(hc * jc * pow(h - j, 2)) as chance from h join j using (axis) group by 1), o as (select axis, count(*) as n, sum(pow(h - j, 2)) as seen from p where j is not null group by 1),
  k as (select axis, round(1 - seen * n / chance, 6) as kappa from o join x using (axis))"""


@query(_REPORT + " select b.*, kappa, spearman, cast(null as varchar) as kappa_note from b join k using (axis) join s using (axis)")
def agreement_by_axis(spark, sf_dir):
    return agreement.report(_pairs(spark, sf_dir), ["axis"], "human_score", "judge", resamples=0)


@query(_REPORT + """ select axis, n, kappa, kappa >= 0.6 and n >= 20 as accepted, case when kappa < 0.6 then 'kappa below the gate' else '' end || case when n < 20 then 'too few pairs' else '' end as reasons from b join k using (axis)""")
def gate(spark, sf_dir):
    r = agreement.gate(agreement.report(_pairs(spark, sf_dir), ["axis"], "human_score", "judge", resamples=0))
    return r.select("axis", "n", "kappa", "accepted", F.array_join("failures", "").alias("reasons"))


@query("""select axis, pair_id, human_score, overall, place, direction from (select *, row_number() over (partition by axis order by abs(overall - human_score) desc, pair_id) as place,
  case when overall > human_score then 'lenient' when overall < human_score then 'harsh' else 'tied' end as direction from fx_scores) where place <= 10""")
def worst_disagreements(spark, sf_dir):
    return agreement.worst(view(spark, sf_dir, "fx_scores"), "axis", "human_score", "overall", "pair_id", 10)


@query("""with q as (select unnest(['all_rules_pass', 'reached_an_answer']) as question, l.doc_id, l.quality = 1 as label, unnest([not contains(lower(text), '###'), not contains(lower(text), '!!')]) as rule, unnest([1 + d.doc_id % 5, 1 + d.doc_id % 4]) as score
    from documents d join labels l using (doc_id)), w as (select question, label, rule, score >= 4 as judge, case when label is null then 'unlabelled' when rule is null then 'no rule' when score is null then 'unjudged' when score = 3 then 'middle band' end as why from q)
  select question, count(*) filter (why is null) as n, count(*) filter (why = 'unlabelled') as n_unlabelled, count(*) filter (why = 'no rule') as n_no_rule, count(*) filter (why = 'unjudged') as n_unjudged, count(*) filter (why = 'middle band') as n_middle_band,
    round(avg(cast(rule = label as int)) filter (why is null), 9) as rule_agreement, round(avg(cast(judge = label as int)) filter (why is null), 9) as judge_agreement,
    round(avg(cast(judge = label as int)) filter (why is null) - avg(cast(rule = label as int)) filter (why is null), 9) as difference,
    case when avg(cast(judge = label as int)) filter (why is null) > avg(cast(rule = label as int)) filter (why is null) then 'judge' else 'rules' end as winner from w group by 1""")
def judge_vs_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id")
    text, i = F.lower("text"), F.col("doc_id")
    return agreement.judge_vs_rules(rows, {"all_rules_pass": (~F.contains(text, F.lit("###")), 1 + i % 5), "reached_an_answer": (~F.contains(text, F.lit("!!")), 1 + i % 4)}, F.col("quality") == 1)


@query("""with v as (select l_returnflag, l_orderkey, cast(l_linenumber % 3 as bigint) as v, count(*) as c from lineitem group by all), u as (select l_returnflag, l_orderkey, sum(c) as n, sum(c * (c - 1)) / nullif(sum(c) * (sum(c) - 1), 0) as agree,
  case when sum(c) > 1 then sum(c * v * v) / sum(c) - pow(sum(c * v) / sum(c), 2) end as variance from v group by 1, 2) select l_returnflag, count(agree) as n_units, round(avg(agree), 9) as agreement, round(avg(variance), 6) as variance from u group by 1""")
def self_consistency(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", (F.col("l_linenumber") % 3).cast("long").alias("v"))
    return agreement.self_consistency(rows, ["l_returnflag"], "l_orderkey", "v")


@query("""with a as (select item_id, axis, case when parse_ok then overall end as overall, case when parse_ok then safety end as safety from fx_scores where arm = 'left'), b as (select item_id, case when parse_ok then overall end as overall, case when parse_ok then safety end as safety from fx_scores where arm = 'right'),
  d as (select a.axis, unnest(['overall', 'safety']) as dimension, unnest([b.overall - a.overall, b.safety - a.safety]) as delta from a join b using (item_id))
  select axis, dimension, round(avg(delta), 9) as mean_delta, count(delta) as n, count(*) filter (delta is null) as n_unparsed from d group by 1, 2""")
def order_drift(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_scores")
    rows = rows.select("item_id", "axis", "arm", *[F.when(F.col("parse_ok"), F.col(c)).alias(c) for c in ("overall", "safety")])
    return agreement.drift(rows.where("arm = 'left'").drop("arm"), rows.where("arm = 'right'").drop("arm", "axis"), "item_id", ["overall", "safety"], ["axis"])


@query(f"""with w as (select arm, axis, b, sum(w * overall) / nullif(sum(w), 0) as m from (select arm, axis, overall, b, {resampling.poisson_sql('pair_id', 'b')} as w from (select *, unnest(range(1, 51)) as b from fx_scores)) group by 1, 2, 3),
  e as (select arm, axis, round(quantile_cont(m, 0.025), 9) as ci_low, round(quantile_cont(m, 0.975), 9) as ci_high from w group by 1, 2)
  select s.arm, s.axis, round(avg(overall), 9) as mean, count(overall) as n, any_value(ci_low) as ci_low, any_value(ci_high) as ci_high from fx_scores s join e on e.arm = s.arm and e.axis = s.axis group by 1, 2""")
def bootstrap_poisson(spark, sf_dir):
    return resampling.bootstrap_poisson(view(spark, sf_dir, "fx_scores"), ["arm", "axis"], "overall", "pair_id", 50)


@query()
def bootstrap_compressed(spark, sf_dir):
    return resampling.bootstrap_mean(view(spark, sf_dir, "fx_scores"), ["arm", "axis"], "overall")


_DIFF = "select l.item_id, cast(floor(l.item_id / 10.0) as bigint) as grp, l.axis, l.overall - r.overall as d from fx_scores l join fx_scores r on l.item_id = r.item_id and l.arm = 'left' and r.arm = 'right'"


def _differences(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_scores").select("item_id", "arm", "axis", "overall")
    left, right = rows.where("arm = 'left'"), rows.where("arm = 'right'").select("item_id", F.col("overall").alias("other"))
    return left.join(right, "item_id").select("item_id", F.floor(F.col("item_id") / 10.0).alias("grp"), "axis", (F.col("overall") - F.col("other")).alias("d"))


@query(f"""with d as (select grp, row_number() over (partition by grp order by item_id) - 1 as i, d from ({_DIFF})), g as (select grp, count(*) as n, abs(sum(d)) as seen from d group by 1),
  m as (select grp, n, seen, unnest(range(0, cast(pow(2, n) as bigint))) as mask from g), f as (select m.grp, m.mask, any_value(n) as n, any_value(seen) as seen, sum(case when (m.mask >> d.i) & 1 = 1 then -d.d else d.d end) as t from m join d using (grp) group by 1, 2)
  select grp, max(n) as n, round(avg(cast(abs(t) >= seen - 1e-9 as int)), 9) as p_value from f group by 1""")
def paired_permutation_exact(spark, sf_dir):
    return resampling.permutation_exact(_differences(spark, sf_dir), ["grp"], "d")


@query()
def paired_permutation_sampled(spark, sf_dir):
    return resampling.permutation_sampled(_differences(spark, sf_dir), ["axis"], "d")




def _sides(metric: str, dim: str, where: str) -> str:
    return f"select arm, '{metric}' as base, cut, {wilson_sql('count(*) filter (x < cut)', 'count(*)')} from (select arm, {dim} as x, unnest([2, 3, 4, 5]) as cut from fx_scores where parse_ok and {where}) group by 1, 3"


_COMPARE = f"""with m as ({_sides('attack_success_rate', 'safety', "axis = 'safety'")} union all {_sides('false_refusal_rate', 'helpfulness', "axis = 'bias'")}),
  c as (select coalesce(l.base, r.base) as base, coalesce(l.cut, r.cut) as cut, l.mean as left_mean, r.mean as right_mean, round(l.mean - r.mean, 6) as delta, l.ci_low > r.ci_high or r.ci_low > l.ci_high as significant
    from (select * from m where arm = 'left') l full join (select * from m where arm = 'right') r on l.base = r.base and l.cut = r.cut)"""


def _compared(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_scores").where("parse_ok")
    a = compare.curve_metrics(rows.where("axis = 'safety'"), "arm", "attack_success_rate", F.col("safety"))
    b = compare.curve_metrics(rows.where("axis = 'bias'"), "arm", "false_refusal_rate", F.col("helpfulness"))
    return compare.compare(a.unionByName(b), "arm", "left", "right")


@query(_COMPARE + ", s as (select base, count(distinct sign(delta)) filter (delta <> 0) <= 1 and count(delta) = count(*) as ok, count(delta) = count(*) as known from c group by 1) select c.*, case when known then ok end as stable from c join s using (base)")
def run_compare(spark, sf_dir):
    return _compared(spark, sf_dir)


@query(_COMPARE + """, p as (select a.cut, a.delta as attack, r.delta as refusal, -a.delta > r.delta and a.significant as win, r.delta > -a.delta and r.significant as loss from c a join c r using (cut) where a.base = 'attack_success_rate' and r.base = 'false_refusal_rate')
  select count(*) as n_cuts, count(*) filter (win) as n_wins, count(*) filter (loss and not win) as n_losses, case when count(*) filter (loss and not win) > 0 then 'regression' when count(*) filter (win) = count(*) then 'improvement' else 'inconclusive' end as verdict from p""")
def guardrail_verdict(spark, sf_dir):
    return compare.guardrail_verdict(_compared(spark, sf_dir))


# one axis without pairs, and pairs without an axis
_AXES = "(select *, case when axis <> 'bias' then axis end as own_axis, case when parse_ok then overall end as judge from fx_scores)"


def _axis_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("own_axis", F.when(F.col("axis") != "bias", F.col("axis")))


@query(f"""with p as (select coalesce(own_axis, '(no axis)') as axis, human_score as h, judge as j from {_AXES}), a as (select unnest(['hallucination', 'bias', 'safety']) as axis union select axis from p),
  b as (select axis, count(j) as n, count(*) filter (h is not null and j is null) as n_unparsed, round(avg(cast(h = j as int)), 6) as exact, round(avg(cast(abs(j - h) <= 1 as int)), 6) as within_one, round(avg(abs(j - h)), 6) as mae, round(avg(j), 6) as mean_judge, round(corr(h, j), 6) as pearson from p group by axis)
  select axis, coalesce(n, 0) as n, coalesce(n_unparsed, 0) as n_unparsed, exact, within_one, mae, mean_judge, pearson, case when n is null then 'too few pairs' end as kappa_note from a left join b using (axis)""")
def agreement_axes(spark, sf_dir):
    found = agreement.report_by_axis(_axis_pairs(spark, sf_dir), "own_axis", "human_score", "judge", resamples=0)
    return found.select(F.col("own_axis").alias("axis"), "n", "n_unparsed", "exact", "within_one", "mae", "mean_judge", "pearson", "kappa_note")


@query()
def agreement_intervals(spark, sf_dir):
    """Every figure of agreement with its joint bootstrap interval."""
    return agreement.report_by_axis(_axis_pairs(spark, sf_dir), "own_axis", "human_score", "judge")


@query()
def bootstrap_many_values(spark, sf_dir):
    """Prices hardly repeat: nearly as many distinct values as rows."""
    found = resampling.bootstrap_mean(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return found.select("l_returnflag", "n", *[F.round(c, 4).alias(c) for c in ("mean", "stdev", "ci_low", "ci_high")])


@query()
def paired_permutation_many_values(spark, sf_dir):
    """Differences between the first two lines of each order."""
    price = [F.max(F.when(F.col("l_linenumber") == i, F.col("l_extendedprice"))) for i in (1, 2)]
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("flag"), (price[0] - price[1]).alias("d"))
    return resampling.paired_permutation(rows, ["flag"], "d")


_SIZED = f"select *, cast(floor(item_id / 210.0) as bigint) as lot, cast(floor((sqrt(8 * (item_id % 210) + 1) - 1) / 2) as bigint) as size from ({_DIFF})"


@query(f"""with s as ({_SIZED}), d as (select lot, size, row_number() over (partition by lot, size order by item_id) - 1 as i, d from s), g as (select lot, size, count(*) as n, abs(sum(d)) as seen from d group by 1, 2),
  m as (select lot, size, seen, unnest(range(0, cast(pow(2, n) as bigint))) as mask from g where n <= 16), f as (select m.lot, m.size, m.mask, any_value(seen) as seen, sum(case when (m.mask >> d.i) & 1 = 1 then -d.d else d.d end) as t from m join d using (lot, size) group by 1, 2, 3),
  p as (select lot, size, round(avg(cast(abs(t) >= seen - 1e-9 as int)), 9) as p_value from f group by 1, 2) select lot, size, n, p_value from g left join p using (lot, size)""")
def paired_permutation_sizes(spark, sf_dir):
    """Groups of one to twenty pairs: exact up to sixteen."""
    place = F.floor((F.sqrt(8 * (F.col("item_id") % 210) + 1) - 1) / 2)
    rows = _differences(spark, sf_dir).select(F.floor(F.col("item_id") / 210.0).alias("lot"), place.alias("size"), "d")
    return resampling.permutation_exact(rows, ["lot", "size"], "d")


@query()
def order_drift_intervals(spark, sf_dir):
    """Two reorderings with intervals, and one that changes no rendering."""
    rows = view(spark, sf_dir, "fx_scores").select("item_id", "axis", "arm", *[F.when(F.col("parse_ok"), F.col(c)).alias(c) for c in ("overall", "safety", "accuracy")])
    left, right = rows.where("arm = 'left'").drop("arm"), rows.where("arm = 'right'").drop("arm", "axis")
    turned = right.withColumn("overall", F.col("accuracy"))
    return agreement.drift_of_orders(left, {"response first": (right, None), "reference first": (turned, None), "prompt last": (None, "no pair has a reference")}, "item_id", ["overall", "safety"], ["axis"])


@query()
def judge_vs_rules_tested(spark, sf_dir):
    """Four questions with all reasons to leave an item out, intervals and paired p."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    text, i = F.lower("text"), F.col("doc_id")
    score = F.when(i % 11 != 0, 1 + i % 5)
    return agreement.judge_vs_rules_tested(rows, {
        "all_rules_pass": (~F.contains(text, F.lit("###")), score), "reached_an_answer": (~F.contains(text, F.lit("!!")), 1 + i % 4),
        "citations_resolve": (F.when(i % 7 != 0, ~F.contains(text, F.lit("http"))), score), "quantitative_claims_supported": (F.lit(None).cast("boolean"), score),
    }, F.col("quality") == 1)

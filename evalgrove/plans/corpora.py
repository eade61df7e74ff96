"""Queries over labels, manifests, linting, retrieval and conversations."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..fixtures import table, view
from ..functions import replies, rules
from ..functions.intervals import wilson_sql
from ..operators import checks, compare, conversations, labels, lint, retrieval, runs, steps
from ..storage import new_folder
from .registry import query


@query("""select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as r from events) where r = 1""")
def latest_label(spark, sf_dir):
    return labels.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("""with r as (select doc_id as item_id, case when doc_id % 7 = 0 then 'old' else 'now' end as dataset_sha256, case when doc_id % 5 = 0 then 'x' else sha256(coalesce(text, '')) end as response_sha256 from documents union all select -1 - doc_id, 'now', 'x' from labels),
  i as (select doc_id as item_id from documents), s as (select doc_id as item_id, sha256(coalesce(text, '')) as said from documents where doc_id % 11 <> 0)
  select r.item_id, r.dataset_sha256, r.response_sha256, case when r.dataset_sha256 <> 'now' then 'other dataset' when i.item_id is null then 'unknown item' when s.said is null then 'no response' when r.response_sha256 <> s.said then 'other response' end as reject_reason
  from r left join i using (item_id) left join s using (item_id)""")
def label_provenance(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("response"))
    sha = F.sha2(F.col("response").cast("binary"), 256)
    records = docs.select(F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 7 == 0, "old").otherwise("now").alias("dataset_sha256"), F.when(F.col("doc_id") % 5 == 0, "x").otherwise(sha).alias("response_sha256"))
    records = records.unionByName(table(spark, sf_dir, "labels").select((-1 - F.col("doc_id")).alias("item_id"), F.lit("now").alias("dataset_sha256"), F.lit("x").alias("response_sha256")))
    items = docs.select(F.col("doc_id").alias("item_id"), "response")
    return labels.provenance(records, items, items.where("item_id % 11 <> 0"), "now")


@query("""select count(*) as n, count(distinct quality) as n_classes, count(distinct source) as n_runs, round(count(distinct l.doc_id) / (select count(*) from documents), 3) as coverage, max(c) = count(*) as degenerate
  from (select l.*, d.source, count(*) over (partition by quality) as c from labels l join documents d using (doc_id)) l""")
def label_balance(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    records = table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("item_id"), F.col("source").alias("run_id"), "quality")
    return labels.balance(records, docs, "quality")


_ORDER = """select doc_id, source, md5(concat('7|', cast(doc_id as varchar))) as deal, md5(concat('7|', source)) as group_deal, row_number() over (partition by source order by md5(concat('7|', cast(doc_id as varchar))), doc_id) as round from documents"""


def _ordered(spark, sf_dir):
    return labels.annotation_order(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 7)


@query(_ORDER)
def annotation_order(spark, sf_dir):
    return _ordered(spark, sf_dir)


@query(f"with o as ({_ORDER}), p as (select source, row_number() over (order by round, group_deal, doc_id) as pos from o), g as (select source, pos - lag(pos) over (partition by source order by pos) as gap from p) select source, min(gap) as min_gap from g group by source")
def min_gap(spark, sf_dir):
    return labels.smallest_gap(labels.positions(_ordered(spark, sf_dir), ["round", "group_deal", "doc_id"]), "source")


@query("""select sha256(coalesce(text, '')) as digest, count(*) as n, min(doc_id) as first from documents group by 1 having count(*) > 1""")
def duplicate_keys(spark, sf_dir):
    return labels.duplicate_keys(table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest")), ["digest"], "doc_id")


@query("""select d.doc_id, d.source from documents d where lang = 'en' and (d.doc_id not in (select doc_id from labels where doc_id is not null) or d.doc_id in (select doc_id from labels where toxic = 1))""")
def label_candidates(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "source", "lang")
    own = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "item_id")
    return labels.candidates(items, own, own.where("toxic = 1"), F.col("lang") == "en").select(F.col("item_id").alias("doc_id"), "source")


@query("""select d.doc_id, l.quality, l.toxic from (select * from documents where lang = 'en' and text is not null) d join (select doc_id, arg_max(quality, toxic) as quality, max(toxic) as toxic from labels group by 1) l using (doc_id) where l.quality is not null""")
def baseline_inputs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang = 'en' and text is not null").select("doc_id")
    own = labels.latest(table(spark, sf_dir, "labels"), ["doc_id"], "toxic").where("quality is not null")
    return docs.join(own, "doc_id").select("doc_id", "quality", "toxic")


@query("""select event_id, request_sha, event_id > min(event_id) over (partition by request_sha) as is_replay from (select event_id, sha256(concat('{"event_type":"', event_type, '","user_id":', user_id, '}')) as request_sha from events)""")
def replay_tags(spark, sf_dir):
    return labels.replays(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), [F.col("event_type"), F.col("user_id")], "event_id").select("event_id", "request_sha", "is_replay")


_DIGEST = "concat('dataset_sha256=', dataset_sha256, '|', coalesce('guardrails_sha256=' || guardrails_sha256, 'guardrails_sha256 null'))"


@query(f"select sha256({_DIGEST}) as conditions, count(*) as n_runs, min(run_id) as first_run from fx_manifests group by 1")
def comparable_runs(spark, sf_dir):
    return compare.comparable_sets(view(spark, sf_dir, "fx_manifests"))


@query("""with p as (select a.run_id as left_run, b.run_id as right_run, a as l, b as r from (select dataset_sha256, min(run_id) as run_id from fx_manifests group by 1) f join fx_manifests a using (run_id) join fx_manifests b on f.dataset_sha256 = b.dataset_sha256 and a.run_id < b.run_id),
  f as (select left_run, right_run, unnest(['model_name', 'provider', 'guardrails_sha256']) as field, unnest([l.model_name, l.provider, l.guardrails_sha256]) as left_value, unnest([r.model_name, r.provider, r.guardrails_sha256]) as right_value from p)
  select * from f where left_value is distinct from right_value""")
def manifest_diff(spark, sf_dir):
    m = view(spark, sf_dir, "fx_manifests")
    firsts = m.groupBy("dataset_sha256").agg(F.min("run_id").alias("left_run"))
    pairs = m.join(firsts, "dataset_sha256").where("left_run < run_id").select("left_run", F.col("run_id").alias("right_run"))
    return compare.manifest_diff(m, pairs, ["model_name", "provider", "guardrails_sha256"])


@query("""with e as (select dataset_sha256, provider, guardrails_sha256, min(run_id) as run_id from fx_manifests group by 1, 2, 3)
  select a.run_id as left_run, b.run_id as right_run, a.guardrails_sha256 as left_value, b.guardrails_sha256 as right_value from e a join e b on a.dataset_sha256 = b.dataset_sha256 and a.provider = b.provider and a.guardrails_sha256 is distinct from b.guardrails_sha256 and a.run_id < b.run_id""")
def ablation_pairs(spark, sf_dir):
    return compare.ablation_pairs(view(spark, sf_dir, "fx_manifests"), "guardrails_sha256", ["dataset_sha256", "provider"])


@query("""select run_id, model_name, case when guardrails_sha256 is null then 'unknown' when guardrails_sha256 = 'g0' then 'clean' else 'dirty' end as tree, sha256(concat(model_name, '|', provider)) as agent_sha, row_number() over (order by dataset_sha256 desc, run_id desc) as place from fx_manifests""")
def run_listing(spark, sf_dir):
    g = F.col("guardrails_sha256")
    tree = F.when(g.isNull(), "unknown").when(g == "g0", "clean").otherwise("dirty")
    listed = view(spark, sf_dir, "fx_manifests").select("run_id", "model_name", tree.alias("tree"), F.sha2(F.concat_ws("|", "model_name", "provider").cast("binary"), 256).alias("agent_sha"), "dataset_sha256")
    ordered = labels.positions(listed, [F.desc("dataset_sha256"), F.desc("run_id")])
    return ordered.select("run_id", "model_name", "tree", "agent_sha", F.col("pos").alias("place"))


@query("""select event_id, 'not_json' as code from events where event_id % 4 = 1""")
def lint_json(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.concat("props", F.when(F.col("event_id") % 4 == 1, "x").otherwise("")).alias("line"))
    return lint.diagnostics(rows, ["event_id"], lint.line_problems(F.col("line")))


@query("""with l as (select event_id, event_id % 7 as t from events) select event_id, unnest(case t when 1 then ['not_json'] when 2 then ['duplicate_key'] when 3 then ['duplicate_key', 'duplicate_key', 'duplicate_key'] when 4 then ['not_object'] when 5 then ['not_object'] when 6 then ['blank_line'] else cast([] as varchar[]) end) as code,
  unnest(case t when 2 then ['a'] when 3 then ['x', 'y', 'y'] when 0 then cast([] as varchar[]) else [null] end) as key from l""")
def lint_json_keys(spark, sf_dir):
    """Keys that are repeated at the top and further down, and lines that are no object."""
    props, t = F.col("props"), F.col("event_id") % 7
    line = (
        F.when(t == 1, F.concat(props, F.lit("}"))).when(t == 2, F.concat(F.lit('{"a": '), props, F.lit(', "b": {"a": 1}, "a": 2}'))).when(t == 3, F.concat(F.lit('{"o": {"x": 1, "z": "\\"x\\"", "x": '), props, F.lit('}, "l": [{"y": 0, "y": 1, "y": 2}]}')))
        .when(t == 4, F.concat(F.lit("["), props, F.lit("]"))).when(t == 5, F.lit('"{}"')).when(t == 6, F.lit(" \t")).otherwise(props)
    )
    return lint.json_problems(table(spark, sf_dir, "events").select("event_id", line.alias("line")), ["event_id"], F.col("line"))


@query("""with i as (select pair_id, axis, case when pair_id % 3 = 0 then 'gender' else 'false_premise' end as subcategory, case when pair_id % 4 = 0 then 'direct' end as attack_type, axis = 'bias' as b from fx_scores)
  select pair_id, 'subcategory_not_of_axis' as code from i where not ((axis = 'bias' and subcategory = 'gender') or (axis = 'hallucination' and subcategory = 'false_premise'))
  union all select pair_id, 'attack_outside_safety' from i where attack_type is not null and axis <> 'safety' union all select pair_id, 'safety_without_attack' from i where axis = 'safety' and attack_type is null
  union all select pair_id, 'unpaired_bias' from i where b""")
def lint_schema(spark, sf_dir):
    i = F.col("pair_id")
    items = view(spark, sf_dir, "fx_scores").select("pair_id", i.cast("string").alias("id"), "axis", F.when(i % 3 == 0, "gender").otherwise("false_premise").alias("subcategory"), F.when(i % 4 == 0, F.lit("direct")).alias("attack_type"), F.array(F.lit("a question")).alias("turns"), F.array(F.lit("id"), F.lit("axis")).alias("fields"), *[F.lit(None).cast("string").alias(c) for c in ("counterfactual_id", "counterfactual_variant", "counterfactual_attribute")])
    return lint.diagnostics(items, ["pair_id"], lint.item_problems(["id", "axis", "subcategory", "turns"]))


@query("""with p as (select item_id, count(*) as n, count(distinct arm) as v, count(distinct axis) as a, count(distinct o_orderstatus) as s from fx_scores group by 1)
  select item_id, 'pair_size' as code from p where n <> 2 union all select item_id, 'same_variant' from p where n = 2 and v < 2 union all select item_id, 'attribute_mismatch' from p where a > 1 union all select item_id, 'varies_o_orderstatus' from p where s > 1""")
def lint_pairs(spark, sf_dir):
    return lint.pair_problems(view(spark, sf_dir, "fx_scores"), "item_id", "arm", "axis", ["o_orderstatus"], F.lit(1))


@query()
def pair_text_diff(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_messages").where("role = 'user'").select("item_id", "turn_idx", "content")
    after = rows.select("item_id", (F.col("turn_idx") - 1).alias("turn_idx"), F.col("content").alias("other"))
    return rows.join(after, ["item_id", "turn_idx"]).select("item_id", "turn_idx", lint.differing_spans(F.col("content"), F.col("other")).alias("n_spans"))


@query("""select lang, source, count(*) as n, count(*) filter (n_chars > 1000) as n_long, count(*) filter (answerable) as n_answerable, cast(grouping(lang, source) as bigint) as level from (select *, doc_id % 2 = 0 as answerable from documents) group by grouping sets ((), (lang), (source))""")
def dataset_composition(spark, sf_dir):
    return lint.composition(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), ["lang", "source"], {"n_long": F.col("n_chars") > 1000, "n_answerable": F.col("doc_id") % 2 == 0})


def _searched(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return v.where("id % 100 = 0"), v


_COS = "list_dot_product(cast(q.embedding as double[]), cast(p.embedding as double[])) / sqrt(list_dot_product(cast(q.embedding as double[]), cast(q.embedding as double[]))) / sqrt(list_dot_product(cast(p.embedding as double[]), cast(p.embedding as double[])))"


@query(f"""select query_id, chunk_id, round(score, 9) as score, place from (select q.vec_id as query_id, p.vec_id as chunk_id, {_COS} as score, row_number() over (partition by q.vec_id order by round({_COS}, 12) desc, p.vec_id) as place
  from embeddings q cross join embeddings p where q.vec_id % 100 = 0) where place <= 5""")
def topk_cosine(spark, sf_dir):
    return retrieval.top_k(*_searched(spark, sf_dir), 5).withColumn("score", F.round("score", 9))


@query(f"""with s as (select q.vec_id, max({_COS}) as score from embeddings q cross join embeddings p where q.vec_id % 100 = 0 and p.vec_id <> q.vec_id group by 1)
  select floor(quantile_cont(score, 0.05) * 100) / 100 as floor, count(*) as n from s where vec_id % 200 = 0""")
def retrieval_floor(spark, sf_dir):
    asked, held = _searched(spark, sf_dir)
    return retrieval.floor_of(_best_other(spark, sf_dir), F.col("query_id") % 200 == 0)


def _best_other(spark, sf_dir):
    """The best score of each query among all other vectors: itself comes first or second, by ties."""
    asked, held = _searched(spark, sf_dir)
    best = retrieval.top_k(asked, held, 2).where("query_id <> chunk_id").groupBy("query_id").agg(F.max("score").alias("score"))
    return asked.select(F.col("id").alias("query_id")).join(best, "query_id", "left").select("query_id", F.coalesce("score", F.lit(0.0)).alias("score"))


@query(f"""with s as (select q.vec_id, max({_COS}) as score from embeddings q cross join embeddings p where q.vec_id % 100 = 0 and p.vec_id <> q.vec_id group by 1),
  f as (select floor(quantile_cont(score, 0.05) * 100) / 100 as floor from s where vec_id % 200 = 0)
  select vec_id % 200 = 0 as answerable, {wilson_sql('count(*) filter (score < floor)', 'count(*)')} from s cross join f group by 1""")
def below_floor(spark, sf_dir):
    scores = _best_other(spark, sf_dir).withColumn("answerable", F.col("query_id") % 200 == 0)
    return retrieval.below_floor(scores, ["answerable"], retrieval.floor_of(scores, F.col("answerable")))


_Q = ", ".join(f"round(quantile_cont(value, {p / 100}), 6) as p{p}" for p in (0, 5, 10, 25, 50, 75, 90, 100))


@query(f"select event_type, role, cast(grouping(event_type, role) as bigint) as level, count(value) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as sd, {_Q} from (select event_type, role, latency_ms as value from fx_calls) group by grouping sets ((), (event_type), (role))")
def group_percentiles(spark, sf_dir):
    return retrieval.distribution(view(spark, sf_dir, "fx_calls").withColumnRenamed("latency_ms", "value"), [[], ["event_type"], ["role"]], "value")


@query("""select vec_id, round(list_sum(list_transform(embedding, lambda x: cast(x as double) * x)), 6) as norm2, 1.0::double as unit_norm2 from embeddings where embedding is not null""")
def normalised_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "embedding")

    def square(c):
        return F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x), 6)

    return v.select("vec_id", square(F.col("embedding")).alias("norm2"), square(retrieval.normalised(F.col("embedding"))).alias("unit_norm2"))


def _headed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), F.concat(F.lit("# "), F.coalesce("source", F.lit("")), F.lit("\n\n"), F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "\n\n")).alias("text"))


@query()
def chunk_documents(spark, sf_dir):
    return retrieval.chunk_documents(_headed(spark, sf_dir), "name", "text")


@query()
def corpus_stats(spark, sf_dir):
    return retrieval.corpus_stats(retrieval.chunk_documents(_headed(spark, sf_dir), "name", "text"))


@query("""select url as name, 'second' as upkeep, case when page_id % 5 = 0 then 'added' when page_id % 6 = 0 then 'removed' when page_id % 7 = 0 then 'changed' when page_id % 11 = 0 then 'restamped' end as state from pages
    where not (page_id % 5 = 0 and page_id % 6 = 0) and (page_id % 5 = 0 or page_id % 6 = 0 or page_id % 7 = 0 or page_id % 11 = 0)
  union all select url, 'third', 'other settings' from pages where page_id % 6 <> 0 union all select url, 'first', 'added' from pages where page_id % 5 <> 0""")
def index_states(spark, sf_dir):
    """What three upkeeps of an index find: a new one, one after files were added, removed, changed and touched, and one with another embedder.

    A page is a file. Several may have one url, so files are named by page, and the url comes back at the end.
    """
    p, folder = table(spark, sf_dir, "pages"), new_folder(spark, "page-index")
    p = p.select("page_id", F.col("page_id").cast("string").alias("name"), "url", F.coalesce("html", F.lit("")).alias("html"))
    before = p.where("page_id % 5 <> 0").select("name", F.lit("1").alias("stamp"), F.col("html").alias("text"))
    moved, changed = F.col("page_id") % 11 == 0, F.col("page_id") % 7 == 0
    after = p.where("page_id % 6 <> 0").select("name", F.when(moved | changed, "2").otherwise("1").alias("stamp"), F.when(changed, F.concat("html", F.lit("!"))).otherwise(F.col("html")).alias("text"))
    found = [retrieval.index_upkeep(files, folder, embedder).withColumn("upkeep", F.lit(name)) for name, files, embedder in (("first", before, "a"), ("second", after, "a"), ("third", after, "b"))]
    of_pages = found[0].unionByName(found[1]).unionByName(found[2]).join(p.select("name", "url"), "name")
    return of_pages.select(F.col("url").alias("name"), "state", "upkeep")


@query("""with a as (select url, sha256(html) as old from pages where page_id % 5 <> 0), b as (select url, sha256(case when page_id % 7 = 0 then html || '!' else html end) as new from pages where page_id % 6 <> 0)
  select url, case when old is null then 'added' when new is null then 'removed' else 'changed' end as state from a full join b using (url) where old is distinct from new""")
def index_staleness(spark, sf_dir):
    p = table(spark, sf_dir, "pages")

    def side(rows, html):
        return rows.select("url", F.sha2(html.cast("binary"), 256).alias("digest"))

    return retrieval.staleness(side(p.where("page_id % 5 <> 0"), F.col("html")), side(p.where("page_id % 6 <> 0"), F.when(F.col("page_id") % 7 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html"))), "url", "digest")


_H = "sha256(concat(url, '|', sha256(html)))"


@query(f"""select count(*) as n_files, sha256(concat_ws('-', {', '.join(f"cast(sum(cast(('0x' || substr({_H}, {1 + 12 * i}, 12)) as bigint)) as varchar)" for i in range(4))})) as digest from pages""")
def corpus_digest(spark, sf_dir):
    return retrieval.corpus_digest(table(spark, sf_dir, "pages").select("url", "html"), "url", "html")


@query("select page_id, url from pages")
def compose_corpus(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return retrieval.composed(p.where("page_id % 3 <> 0"), p.where("page_id % 3 = 0"), "url")


@query("""with m as (select *, cast(ceil(length(coalesce(content, '')) / 4.0) as bigint) + 4 as tokens from fx_messages), w as (select *, max(turn_idx) over (partition by run_id, item_id) - turn_idx as back, sum(tokens) over (partition by run_id, item_id) as total, max(seq) over (partition by run_id, item_id) as newest from m),
  r as (select *, sum(case when back < 2 then tokens else 0 end) over (partition by run_id, item_id) as recent from w)
  select run_id, item_id, seq, tokens from r where case when total <= 120 then true when recent <= 120 then back < 2 else seq = newest end""")
def context_fit(spark, sf_dir):
    return conversations.context_fit(view(spark, sf_dir, "fx_messages"), ["run_id", "item_id"], 120, 2).select("run_id", "item_id", "seq", "tokens")


_SEG = "select conv_id as run_id, case when conv_id % 4 <> 0 then conv_id - 1 end as previous_run_id, count(*) filter (role = 'user') as n_turns from conversations group by conv_id"


def _segments(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy(F.col("conv_id").alias("run_id")).agg(F.count_if(F.col("role") == "user").alias("n_turns")).withColumn("previous_run_id", F.when(F.col("run_id") % 4 != 0, F.col("run_id") - 1))


@query(f"with s as ({_SEG}) select * from s where run_id not in (select previous_run_id from s where previous_run_id is not null)")
def conversation_tips(spark, sf_dir):
    return conversations.tips(_segments(spark, sf_dir))


@query(f"""with recursive s as ({_SEG}), c as (select run_id, run_id as member, previous_run_id as next from s where run_id not in (select previous_run_id from s where previous_run_id is not null)
  union all select c.run_id, s.run_id, s.previous_run_id from c join s on c.next = s.run_id) select c.run_id, count(*) as n_segments, cast(sum(s.n_turns) as bigint) as total_turns from c join s on s.run_id = c.member group by 1""")
def chain_turns(spark, sf_dir):
    return conversations.chain_turns(_segments(spark, sf_dir))


@query("""select run_id, item_id, seq, role from fx_dialog m where role = 'user' or (role = 'assistant' and content is not null)
  or (role = 'guardrail' and not exists (select 1 from fx_dialog a where a.role = 'assistant' and a.run_id = m.run_id and a.item_id = m.item_id and a.turn_idx = m.turn_idx))""")
def memory_replay(spark, sf_dir):
    return conversations.memory_replay(view(spark, sf_dir, "fx_dialog")).select("run_id", "item_id", "seq", "role")


@query(f"""with recursive s as ({_SEG}), c as (select run_id, run_id as member, previous_run_id as next, 0 as depth from s where run_id not in (select previous_run_id from s where previous_run_id is not null)
  union all select c.run_id, s.run_id, s.previous_run_id, c.depth + 1 from c join s on c.next = s.run_id)
  select c.run_id, c.depth, t.turn, t.role from c join conversations t on t.conv_id = c.member where t.role = 'user' or (t.role = 'assistant' and t.text is not null)""")
def chain_memory(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    messages = c.select(F.col("conv_id").alias("run_id"), F.col("conv_id").alias("item_id"), F.lit(0).alias("turn_idx"), "role", F.col("text").alias("content"), "turn")
    return conversations.memory_replay(messages, conversations.chains(_segments(spark, sf_dir))).select("run_id", "depth", "turn", "role")


_BROKEN = "select run_id, case when run_id % 12 = 4 then -1 when run_id % 12 = 8 then run_id + 1 else previous_run_id end as previous_run_id, n_turns from s0"


@query(f"""with recursive s0 as ({_SEG}), s as ({_BROKEN}), w as (select run_id, previous_run_id as back, 0 as steps from s union all select w.run_id, s.previous_run_id, w.steps + 1 from w join s on w.back = s.run_id where w.steps < 40),
  e as (select run_id, bool_or(back is null) as begins, max(steps) as steps from w group by 1) select run_id, case when steps >= 40 then 'loop' else 'missing segment' end as reason from e where not begins""")
def broken_chains(spark, sf_dir):
    i = F.col("run_id") % 12
    s = _segments(spark, sf_dir).withColumn("previous_run_id", F.when(i == 4, F.lit(-1)).when(i == 8, F.col("run_id") + 1).otherwise(F.col("previous_run_id")))
    return conversations.broken_chains(s)


@query(f"""with recursive s0 as ({_SEG}), s as ({_BROKEN}), c as (select run_id, run_id as member, previous_run_id as next, 0 as depth from s where run_id not in (select previous_run_id from s where previous_run_id is not null)
  union all select c.run_id, s.run_id, s.previous_run_id, c.depth + 1 from c join s on c.next = s.run_id where c.depth < 40), whole as (select run_id from c group by 1 having bool_or(next is null))
  select c.run_id, count(*) as n_segments, cast(sum(s.n_turns) as bigint) as total_turns, arg_max(member, depth) as first_segment from c join s on s.run_id = c.member where c.run_id in (select run_id from whole) group by 1""")
def resumable(spark, sf_dir):
    i = F.col("run_id") % 12
    s = _segments(spark, sf_dir).withColumn("previous_run_id", F.when(i == 4, F.lit(-1)).when(i == 8, F.col("run_id") + 1).otherwise(F.col("previous_run_id")))
    return conversations.resumable(s)


@query("select run_id, item_id, count(*) as n_rows, min(seq) as first_seq from fx_dialog where item_id is not null group by 1, 2")
def conversation_groups(spark, sf_dir):
    return conversations.conversations(view(spark, sf_dir, "fx_dialog"))


@query()
def parse_replies(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_messages").where("role = 'assistant'")
    said = F.to_json(F.struct(F.col("content").alias("final"), F.array(F.lit("a.md#1")).alias("citations")))
    text = F.when(F.col("seq") % 3 == 0, said).when(F.col("seq") % 3 == 1, F.concat(F.lit("```json\n"), said, F.lit("\n```"))).otherwise(F.col("content"))
    return rows.select("item_id", "seq", replies.parse_reply(text).alias("r")).select("item_id", "seq", "r.kind", "r.violation", F.length("r.text").alias("chars"))


#: Replies with what they are: kind, tool's name, violation. $ stands for a digest of the message.
_REPLIES = [
    ('{"final": "$", "citations": ["a.md#1"]}', "final", None, None), ('```json\n{"final": "$", "citations": []}\n```', "final", None, None), ('prose {oops} {"tool": "kb", "args": {"q": "$"}}', "tool", "kb", None),
    ('{"tool": "  ", "args": {}}', "violation", None, "wrong_value_type"), (' {"tool": " kb ", "args": {"q": "$"}} ', "tool", "kb", None), ("no object in $", "violation", None, "unparseable_json"),
    ('{"broken": {"tool": "kb"},, } then {"final": "$", "citations": []}', "final", None, None), ('say "{" first: {"final": "$", "citations": []}', "violation", None, "unparseable_json"), ('so: {"final": "a } and a \\" in $", "citations": []} {', "final", None, None),
    ('{"final": "$", "tool": "kb", "citations": []}', "violation", None, "wrong_value_type"), ('{"answer": "$"}', "violation", None, "unknown_top_level_key"), ('{"final": "$"}', "violation", None, "missing_citations_key"),
    ('{"final": "$", "citations": [1]}', "violation", None, "citations_wrong_type"), ('[{"final": "$", "citations": []}]', "violation", None, "unparseable_json"), ('{"tool": "kb", "args": []}', "violation", None, "wrong_value_type"),
    ('text {"final": "$", "citations": []} more {"tool": "kb"}', "final", None, None), ('{"final": {"a": "$"}, "citations": []}', "violation", None, "wrong_value_type"), ('{"tool": "kb"}', "tool", "kb", None), ('{"open": "$', "violation", None, "unparseable_json"),
]


def _reply_sql(i: int) -> str:
    return "[" + ", ".join("null" if r[i] is None else f"'{r[i]}'" for r in _REPLIES) + f"][1 + t]"


@query(f"""with r as (select run_id, item_id, seq, (cast(item_id as bigint) * 7 + seq) % {len(_REPLIES)} as t from fx_messages where role = 'assistant')
  select run_id, item_id, seq, {_reply_sql(1)} as kind, {_reply_sql(2)} as name, {_reply_sql(3)} as violation from r""")
def replies_planted(spark, sf_dir):
    """Every way in which a reply can be read or refused."""
    rows = view(spark, sf_dir, "fx_messages").where("role = 'assistant'")
    template = F.get(F.array(*[F.lit(r[0]) for r in _REPLIES]), ((F.col("item_id").cast("bigint") * 7 + F.col("seq")) % len(_REPLIES)).cast("int"))
    text = F.replace(template, F.lit("$"), F.md5(F.col("content").cast("binary")))
    return rows.select("run_id", "item_id", "seq", replies.parse_reply(text).alias("r")).select("run_id", "item_id", "seq", "r.kind", "r.name", "r.violation")


@query("""select pair_id, case when pair_id % 4 = 1 then 'not JSON' when pair_id % 4 = 2 then 'wrong keys' when pair_id % 4 = 3 then 'score out of range' end as defect from fx_scores""")
def parse_verdicts(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_scores")
    i = F.col("pair_id")
    base = [F.when((i % 4 == 3) & F.lit(c == "safety"), 7).otherwise(F.col(c)).alias(c) for c in ("helpfulness", "accuracy", "safety", "communication", "overall")]
    whole = F.to_json(F.struct(*base, F.array(F.lit("a span")).alias("evidence"), F.lit("why").alias("rationale")))
    text = F.when(i % 4 == 1, F.concat(whole, F.lit("}"))).when(i % 4 == 2, F.to_json(F.struct(*base))).otherwise(whole)
    return rows.select("pair_id", replies.verdict_defect(text).alias("defect"))


@query("""select event_id, case when event_id % 4 = 1 then 'missing_arg' when event_id % 4 = 2 then 'bad_arg_type' when event_id % 4 = 3 then 'schema_invalid' end as error from events""")
def validate_args(spark, sf_dir):
    i = F.col("event_id")
    text = F.when(i % 4 == 1, "{}").when(i % 4 == 2, '{"k": true}').when(i % 4 == 3, "[1]").otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", replies.argument_error(text, {"k": "bigint"}).alias("error"))


@query("""select doc_id, cast(len(list_filter([substr(text, 5 + doc_id % 90, 60), substr(text, 1 + cast(length(text) / 2 as bigint), 90), concat(substr(text, 1, 30), 'not there'), 'licensed under'],
  lambda q: contains(n, lower(trim(regexp_replace(q, '[\\s\\p{Z}]+', ' ', 'g')))))) as bigint) as n_verified from (select doc_id, text, lower(trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g'))) as n from documents where text is not null)""")
def verify_evidence(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text is not null")
    text = F.col("text")
    half = F.round(F.length(text) / 2).cast("int")
    quotes = F.array(F.substring(text, (5 + F.col("doc_id") % 90).cast("int"), F.lit(60)), F.substring(text, 1 + half, F.lit(90)), F.concat(F.left(text, F.lit(30)), F.lit("not there")), F.lit("Licensed\n under"))
    return rows.select("doc_id", F.size(rules.verbatim(quotes, F.col("text"))).cast("long").alias("n_verified"))


_NAMED = "regexp_replace(r, '(?i)(" + "|".join(sorted(rules.VENDOR_NAMES, key=lambda x: (-len(x), x))) + ")[\\p{L}\\p{M}\\p{N}_.-]*', '[model]', 'g')"


@query(f"""with p as (select run_id, item_id, trim(arg_max(content, seq) filter (role = 'user')) as q, arg_max(content, seq) filter (role = 'turn') || ' Claude-3 and  GPT' as r from fx_dialog group by 1, 2 having count(*) filter (role = 'turn') > 0)
  select run_id, item_id, md5(concat('## Prompt', chr(10), q, chr(10), chr(10), '## Response', chr(10), trim({_NAMED}), chr(10), chr(10), '## Reference', chr(10), 'the reference')) as request, cast((length({_NAMED}) - length(replace({_NAMED}, '[model]', ''))) / 7 as bigint) as n_redacted from p""")
def judge_requests(spark, sf_dir):
    pairs = steps.scored_pairs(view(spark, sf_dir, "fx_dialog")).withColumns({"response": F.concat("response", F.lit(" Claude-3 and  GPT")), "reference": F.lit(" the reference ")})
    return steps.judge_requests(pairs).withColumn("request", F.md5(F.col("request").cast("binary")))


@query("""select run_id, item_id, md5(arg_max(content, seq) filter (role = 'user')) as prompt, md5(arg_max(content, seq) filter (role = 'turn')) as response, arg_max(turn_idx, seq) filter (role = 'turn') as turn_idx from fx_dialog group by 1, 2 having count(*) filter (role = 'turn') > 0""")
def scored_pairs(spark, sf_dir):
    return steps.scored_pairs(view(spark, sf_dir, "fx_dialog")).withColumns({c: F.md5(F.col(c).cast("binary")) for c in ("prompt", "response")})


@query("select run_id, item_id, md5(arg_max(content, seq)) as response from fx_dialog where role = 'assistant' and content is not null group by 1, 2")
def final_responses(spark, sf_dir):
    return steps.final_responses(view(spark, sf_dir, "fx_dialog")).withColumn("response", F.md5(F.col("response").cast("binary")))


@query("""with i as (select distinct cast(conv_id as varchar) as item_id from conversations where conv_id % 11 <> 5), r as (select run_id, item_id, arg_max(content, seq) as response from fx_dialog where role = 'assistant' and content is not null group by 1, 2)
  select 'asked' as side, run_id, item_id from r join i using (item_id) union all select 'missing', x.run_id, i.item_id from i cross join (select distinct run_id from r) x where not exists (select 1 from r where r.run_id = x.run_id and r.item_id = i.item_id)""")
def labelling_pairs(spark, sf_dir):
    items = table(spark, sf_dir, "conversations").where("conv_id % 11 <> 5").select(F.col("conv_id").cast("string").alias("item_id"))
    said = steps.final_responses(view(spark, sf_dir, "fx_dialog"))
    asked, missing = labels.labelling_pairs(items, said), labels.unanswered(items, said)
    return asked.select(F.lit("asked").alias("side"), "run_id", "item_id").unionByName(missing.select(F.lit("missing").alias("side"), "run_id", "item_id"))


@query("select doc_id from documents intersect select doc_id from labels")
def shared_ids(spark, sf_dir):
    return labels.shared_ids(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""with l as (select doc_id, case when doc_id % 4 = 0 then '{broken' else 'ok' end as kind, doc_id % 3 = 0 as stale, quality from labels where quality is not null and doc_id is not null)
  select doc_id, code from (select doc_id, unnest([case when kind <> 'ok' then 'malformed' end, case when kind = 'ok' and stale then 'stale_dataset' end, case when kind = 'ok' and doc_id % 5 = 1 then 'unknown_item' end]) as code from l) where code is not null
  union all select -1, 'degenerate' from (select case when doc_id % 10 < 5 then 'labels' else 'scores' end as space, case when doc_id % 10 < 5 then cast(quality as varchar) else '3' end as v from (select distinct doc_id, max(quality) as quality from l where kind = 'ok' group by 1)) group by space having count(distinct v) = 1""")
def lint_labels(spark, sf_dir):
    i, rows = F.col("doc_id"), table(spark, sf_dir, "labels").where("quality is not null and doc_id is not null")
    kept = F.struct(
        i.cast("string").alias("item_id"), F.lit("r").alias("run_id"), F.when(i % 3 == 0, "old").otherwise("now").alias("dataset_sha256"), F.lit(1.0).alias("seconds_spent"),
        F.when(i % 10 < 5, F.when(F.col("quality") == 1, "pass").otherwise("fail")).alias("label"), F.when(i % 10 >= 5, F.lit(3)).alias("score"),
    )
    lines = rows.select(F.lit("f").alias("file"), i.alias("seq"), F.when(i % 4 == 0, "{broken").otherwise(F.to_json(kept)).alias("value"))
    items = rows.where("doc_id % 5 <> 1").select(i.cast("string").alias("item_id"))
    return lint.label_sidecar_problems(lines, items, "now").select(F.coalesce("seq", F.lit(-1)).alias("doc_id"), "code")


@query(f"select run_id, sha256(concat('model_name=', model_name, '|provider=', provider, '|', coalesce('guardrails_sha256=' || guardrails_sha256, 'guardrails_sha256 null'))) as agent_sha from fx_manifests")
def agent_digests(spark, sf_dir):
    return compare.agent_digest(view(spark, sf_dir, "fx_manifests").select("run_id", "model_name", "provider", F.col("dataset_sha256"), "guardrails_sha256"))


@query("""select run_id, f.ord, f.field, f.value from (select run_id, unnest([{'ord': 1, 'field': 'judge_run_id', 'value': case when cast(run_id as bigint) % 2 = 0 then 'j' || run_id end}, {'ord': 2, 'field': 'model_name', 'value': model_name}, {'ord': 3, 'field': 'provider', 'value': provider},
  {'ord': 4, 'field': 'config_sha', 'value': substr(sha256(model_name), 1, 12)}]) as f from fx_manifests)""")
def run_conditions(spark, sf_dir):
    m = view(spark, sf_dir, "fx_manifests").withColumn("config_sha", F.sha2(F.col("model_name").cast("binary"), 256))
    judges = m.where(F.col("run_id").cast("long") % 2 == 0).select("run_id", F.concat(F.lit("j"), "run_id").alias("judge_run_id"))
    return runs.conditions(m, ["model_name", "provider", "config_sha"], judges)


@query()
def hedging_count(spark, sf_dir):
    return view(spark, sf_dir, "fx_said").select("doc_id", rules.hedging_count(F.col("response")).alias("n_hedges"))


@query("""with s as (select doc_id, concat(coalesce(text, ''), ' ', chr(160), 'end') as t from documents) select doc_id, cast(len(list_filter(regexp_split_to_array(t, '[\\s\\p{Z}]+'), lambda w: w <> '')) as bigint) as n_words,
  case when length(t) > 400 then left(t, 400) || ' [...]' else t end as excerpt from s""")
def word_counts(spark, sf_dir):
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" \u00a0end"))
    return table(spark, sf_dir, "documents").select("doc_id", rules.word_count(text).cast("long").alias("n_words"), rules.excerpt(text).alias("excerpt"))


@query("""select doc_id, case when doc_id % 4 < 2 and trim(case when doc_id % 3 = 0 then ' ' else 'an answer' end) <> '' then 'grounding_abstained' else 'none' end as action, case when doc_id % 4 < 2 and doc_id % 3 <> 0 then 'grounding' end as stage from documents""")
def grounding(spark, sf_dir):
    i = F.col("doc_id")
    ids = F.when(i % 4 == 0, F.lit(None).cast("array<string>")).when(i % 4 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("a.md#1")))
    made = rules.grounding(ids, F.when(i % 3 == 0, " ").otherwise("an answer"))
    return table(spark, sf_dir, "documents").select("doc_id", made["action"].alias("action"), made["stage"].alias("stage"))


@query("""select doc_id, case doc_id % 9 when 2 then doc_id % 2 = 0 when 4 then true end as passed from documents where doc_id % 9 in (2, 4)""")
def kb_grounded(spark, sf_dir):
    """Planted claims alone: 200 mg and 30 minutes, of which the retrieved text holds both or one; 5 %, which it holds."""
    i = F.col("doc_id")
    held = F.when(i % 2 == 0, "Up to 200  MG and 30 minutes; 5 % of it").otherwise("Up to 200 mg, 5 %")
    said = F.when(i % 9 == 2, "Take 200 mg, then rest 30 minutes a day.").when(i % 9 == 4, "Some said 5 % more.").otherwise("Nothing else.")
    none = F.array().cast("array<string>")
    views = table(spark, sf_dir, "documents").select("doc_id", said.alias("response"), held.alias("retrieved_text"), none.alias("retrieved_ids"), none.alias("must_include"), F.lit(None).cast("string").alias("expected_tool"), none.alias("tools"), F.lit(1).alias("n_calls"), F.lit(0).alias("n_violations"), F.lit(0).alias("n_tool_errors"), F.lit(None).cast("string").alias("stopped_reason"))
    return checks.check_rows(views, ["doc_id"], checks.standard_checks([])).where("check = 'kb_grounded'").select("doc_id", "passed")


@query("select page_id, sha256(concat('{\"query\":\"', lower(trim(regexp_replace(url, '\\s+', ' ', 'g'))), '\",\"p0\":5}')) as query_key from pages where url is not null")
def query_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").where("url is not null").select("page_id", rules.query_key(F.col("url"), F.lit(5)).alias("query_key"))


def _canonical(patterns: dict) -> str:
    return json.dumps(patterns, sort_keys=True)


@query("select lang, count(*) as n, sha256('" + _canonical(rules.RULES).replace("'", "''") + "') as rules_sha256, sha256('" + _canonical(rules.GUARDRAILS).replace("'", "''") + "') as guardrails_sha256 from documents group by lang")
def rule_digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.lit(rules.digest_of(rules.RULES)).alias("rules_sha256"), F.lit(rules.digest_of(rules.GUARDRAILS)).alias("guardrails_sha256"))


@query("select event_id, row_number() over (order by ts desc, event_id desc) as place from events")
def runs_newest_first(spark, sf_dir):
    return labels.positions(table(spark, sf_dir, "events").select("event_id", "ts"), [F.desc("ts"), F.desc("event_id")]).select("event_id", F.col("pos").alias("place"))


@query("select o_orderkey, md5(concat('3|', cast(o_orderkey as varchar))) as draw from orders order by draw, o_orderkey limit 100")
def stability_subsample(spark, sf_dir):
    draw = F.md5(F.concat_ws("|", F.lit("3"), F.col("o_orderkey").cast("string")).cast("binary"))
    return table(spark, sf_dir, "orders").select("o_orderkey", draw.alias("draw")).orderBy("draw", "o_orderkey").limit(100)


@query("select 'documents' as dataset, doc_id as id, length(text) as chars from documents union all select 'benchmark', item_id, length(text) from benchmark")
def tagged_union(spark, sf_dir):
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return d.select(F.lit("documents").alias("dataset"), F.col("doc_id").alias("id"), F.length("text").cast("long").alias("chars")).unionByName(b.select(F.lit("benchmark").alias("dataset"), F.col("item_id").alias("id"), F.length("text").cast("long").alias("chars")))


@query("""select pair_id, axis, case when parse_ok then overall end as overall, case when not parse_ok then 'not parsed' when human_score is null then 'no judgement' end as reason from fx_scores""")
def judgement_rows(spark, sf_dir):
    ok = F.col("parse_ok")
    return view(spark, sf_dir, "fx_scores").select("pair_id", "axis", F.when(ok, F.col("overall")).alias("overall"), F.when(~ok, "not parsed").when(F.col("human_score").isNull(), "no judgement").alias("reason"))

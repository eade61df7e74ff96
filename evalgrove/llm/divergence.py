"""How the sources of a language differ in their words: distances of all pairs of sources, and each source's own terms.

A term's row is its nonzero counts in the sources of a language, in an order of the sources. Rows go into a
frequent-pattern tree: rows that begin alike share a path, and a node stands for one source's count with
the number of terms that pass through it. A pair's distance is what it would be if no term occurred, plus
what each source's own counts change, plus a correction for terms that occur in both; these corrections are
added up once for each node and ancestor, times the node's terms, instead of once a term. Rows are sorted
(as ranges), so a task knows a node's path and terms from neighbouring rows; where a range cuts a path, both
parts count their own terms, and the sum is the same.

All arithmetic is in whole numbers: a share is 1 + floor(SCALE * (count + 2) / (N + 2 V)), a distance
floor((p - q)^2 / (p + q)). The pairs of a language's sources are the result itself, so they are made; terms are
never paired.

Rows: null text, language and source are empty strings; a document without terms counts for its group's being
there; repeated rows count each; an empty table gives an empty result; other columns aren't read, whatever
their names. A group's `term` ranks are cut at `most` by Spark before anything is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import over_texts, stored

SCALE = 1_000_000_000
#: Distinct (group, term) pairs that a task adds up before it passes them on.
HELD = 1_000_000
#: Pairs of nodes and ancestors that are looked at together.
COMBINATIONS = 2_000_000
#: Bytes of terms: ASCII letters, lower-cased, and all bytes of other characters; the rest are gaps.
_LETTERS = bytes(ord(chr(b).lower()) if chr(b).isalpha() and b < 128 else b if b >= 128 else 32 for b in range(256))
_COUNTS = "lang string, source string, term binary, n long, docs long"


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it), added up for each group."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in counts.items():
                if n:
                    own = [pa.array([lang] * len(n)), pa.array([source] * len(n)), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
                    yield pa.record_batch(own, names=[x.split()[0] for x in _COUNTS.split(", ")])
            counts.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                terms = Counter(text.as_py().translate(_LETTERS).split())
                n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                n.update(terms)
                docs.update(terms.keys())
                size += len(n)
                if size >= held:
                    yield from out()
                    size = 0
        yield from out()

    made = over_texts(named, ["lang", "source", "text"], _COUNTS, rows)
    return made.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / total), exactly; null for a total of 0."""
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)"), F.nullif(total, F.lit(0)).cast("decimal(20,0)"))


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _corrections(depth: np.ndarray, shared: np.ndarray, terms: np.ndarray, starts: np.ndarray, place: np.ndarray, p: np.ndarray, p0: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(later place, earlier place, sum) of the tree of sorted rows: row i has `depth` nodes from starts[i] on, of which the first `shared` are those of the row before."""
    # the terms of a node: those of its row and of the rows after it, as long as they share it
    row = np.repeat(np.arange(len(depth)), depth)
    level = np.arange(len(row)) - np.repeat(starts, depth)
    new = level >= shared[row]
    # each entry's node is that of the nearest row before (or its own) that made its level: a running maximum, level by level
    order = np.lexsort((row, level))
    made = np.where(new[order], np.arange(len(order)), 0)
    node = np.empty(len(order), np.int64)
    node[order] = order[np.maximum.accumulate(made)]
    through = np.zeros(len(row), np.int64)
    np.add.at(through, node, terms[row])
    nodes = np.flatnonzero(new & (level > 0))
    ends = np.cumsum(level[nodes])
    begin = 0
    while begin < len(nodes):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + COMBINATIONS, "right")))
        own = nodes[begin:end]
        at = np.repeat(own, level[own])
        above = np.arange(len(at)) - np.repeat(ends[begin:end] - level[own] - done, level[own]) + starts[row[at]]
        met = _distances(p[at], p[above]) - _distances(p[at], p0[above]) - _distances(p0[at], p[above]) + _distances(p0[at], p0[above])
        yield place[at], place[above], met * through[at]
        begin = end


def _summed(a: np.ndarray, b: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b, v = a[order], b[order], v[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return a[first], b[first], np.add.reduceat(v, first) if len(first) else v


def pair_corrections(paths: DataFrame) -> DataFrame:
    """lang, a, b and correction (a sum), b before a in the order of sources, from paths: lang, path (array of place, p, p0, in order) and terms."""
    kind = "lang string, a int, b int, correction long"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path = batch.column(1)
            depth = np.diff(path.offsets.to_numpy())
            place, p, p0 = (path.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            starts = np.concatenate([[0], np.cumsum(depth)[:-1]]).astype(np.int64)
            # nodes that a row shares with the row before it: places and shares alike from the beginning on
            lang = np.array(batch.column(0).to_pylist(), dtype=object)
            most = np.minimum(depth[1:], depth[:-1])
            shared = np.zeros(len(depth), np.int64)
            alive = np.flatnonzero((lang[1:] == lang[:-1]) & (most > 0))
            step = 0
            while len(alive):
                x, y = starts[alive] + step, starts[alive + 1] + step
                alive = alive[(place[x] == place[y]) & (p[x] == p[y])]
                step += 1
                shared[alive + 1] = step
                alive = alive[most[alive] > step]
            terms = batch.column(2).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], lang[1:] != lang[:-1], [True]])) if len(lang) else []
            for i, j in zip(cuts[:-1], cuts[1:]):
                at = slice(int(starts[i]), int(starts[j - 1] + depth[j - 1]))
                for a, b, v in _corrections(depth[i:j], shared[i:j], terms[i:j], starts[i:j] - starts[i], place[at], p[at], p0[at]):
                    a, b, v = _summed(a, b, v)
                    yield pa.record_batch([pa.array([lang[i]] * len(a)), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(v, pa.int64())], names=["lang", "a", "b", "correction"])

    made = paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path").select("lang", "path", "terms").mapInArrow(rows, kind)
    return made.groupBy("lang", "a", "b").agg(F.sum("correction").alias("correction"))


def divergence(docs: DataFrame, least_docs: int = 10, most: int = 10) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value and rank: distances from each source to the others of its language,
    and the `most` terms that it has more of than its language, among terms in at least least_docs documents of the language."""
    group = ["lang", "source"]
    per_term = Window.partitionBy("lang", "term")  # a row a source at most
    counts = term_counts(docs).withColumns({"all_n": F.sum("n").over(per_term), "all_docs": F.sum("docs").over(per_term)})
    kept = stored(counts.where(F.col("all_docs") >= least_docs).select(*group, "term", "n", "all_n"), "term-counts")
    there = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in group]).distinct()
    totals = kept.groupBy(*group).agg(F.sum("n").alias("total"))
    words = kept.select("lang", "term", "all_n").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_total"))
    order = Window.partitionBy("lang").orderBy(F.desc("total"), "source")  # a row a source
    groups = there.join(totals, group, "left").join(words, "lang", "left").na.fill(0, ["total", "v", "lang_total"]).select(
        *group, "v", (F.col("total") + 2 * F.col("v")).alias("of"), (F.col("lang_total") + 2 * F.col("v")).alias("lang_of"), F.row_number().over(order).alias("place")
    ).withColumn("p0", share(F.lit(0), F.col("of")))
    groups = stored(groups, "sources")
    own = stored(kept.join(groups, group).select("lang", "source", "term", "place", share(F.col("n"), F.col("of")).alias("p"), "p0", share(F.col("all_n"), F.col("lang_of")).alias("q")), "term-shares")

    paths = own.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("place", "p", "p0"))).alias("path")).groupBy("lang", "path").agg(F.count("*").alias("terms"))
    met = pair_corrections(paths)
    both = met.select("lang", F.col("a").alias("place"), F.col("b").alias("other"), "correction").unionByName(met.select("lang", F.col("b").alias("place"), F.col("a").alias("other"), "correction"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("other"), F.col("p0").alias("q0"))
    # what a source's own counts change in its distance to each other source: each distinct share once
    alone = own.groupBy("lang", "place", "p", "p0").agg(F.count("*").alias("terms")).join(others, "lang").where("place <> other")
    changed = alone.groupBy("lang", "place", "other").agg(F.sum(F.col("terms") * (distance(F.col("p"), F.col("q0")) - distance(F.col("p0"), F.col("q0")))).alias("correction"))
    turned = changed.select("lang", F.col("other").alias("place"), F.col("place").alias("other"), "correction")
    corrections = both.unionByName(changed).unionByName(turned).groupBy("lang", "place", "other").agg(F.sum("correction").alias("correction"))
    base = groups.join(others, "lang").where("place <> other")
    value = F.when(F.col("v") == 0, 0).otherwise(F.col("v") * distance(F.col("p0"), F.col("q0")) + F.coalesce("correction", F.lit(0)))
    pairs = base.join(corrections, ["lang", "place", "other"], "left").select(*group, F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    terms = own.where("p > q").select(*group, F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= most))


ORACLE_SQL = r"""
with d as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
), per_doc as (
  select doc_id, lang, source, term, count(*) as n from (select doc_id, lang, source, unnest(terms) as term from d) group by all
), kept as (
  select lang, term, sum(n) as all_n from per_doc group by all having count(*) >= 10
), c as (
  select lang, source, term, sum(n) as n from per_doc join kept using (lang, term) group by all
), words as (
  select lang, count(*) as v, sum(all_n) as lang_total from kept group by all
), groups as (
  select g.lang, g.source, w.v, coalesce(t.total, 0) + 2 * w.v as total, w.lang_total + 2 * w.v as lang_of
  from (select distinct lang, source from d) g left join words w using (lang) left join (select lang, source, sum(n) as total from c group by all) t using (lang, source)
), shares as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
         cast(1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // g.total::hugeint as bigint) as p,
         cast(1 + (1000000000::hugeint * (k.all_n + 2)) // g.lang_of::hugeint as bigint) as q
  from groups g join kept k using (lang) left join c using (lang, source, term)
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item,
         coalesce((select sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) from shares x join shares y using (lang, term) where x.lang = a.lang and x.source = a.source and y.source = b.source), 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
), terms as (
  select lang, source, 'term' as part, term as item, ((p - q) * (p - q)) // (p + q) as value from shares where n > 0 and p > q
), ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms)
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from ranked where part = 'pair' or rank <= 10
"""

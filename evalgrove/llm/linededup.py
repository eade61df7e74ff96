"""Removal of lines that an earlier document has, by sharded minimal perfect hashes.

Distinct hashes of lines that two or more documents hold are dealt to shards. A shard is one row: a
minimal perfect hash whose numbers index arrays of fingerprints, counts of copies and first documents.
Lines probe the shard that answers for them as hashes, row keys and positions; texts are joined by
row key only with the positions that go. A line's slot comes from one 64-bit hash and its fingerprint
is another one, so a wrong answer needs a collision of 128 bits.

A shard that far more lines than others ask, as it holds a very common one, is asked in parts: its arrays are copied
for each part, so that no task gets more than about PROBES lines, whatever the number of copies. The list of such shards is broadcast and has
MOST_SPLIT entries at most; beyond PROBES * MOST_SPLIT lines (6.5 * 10^10) a task's lines grow with the table, to one in MOST_SPLIT of all.

Rows: a null or empty text is one empty line. Keys shorter than min_chars stay. A document is a doc_id
and its text, by a 64-bit hash of both: rows that repeat both count as one and lose the same lines;
different texts of one doc_id, or of none, are documents of their own, in the order of their hashes. Those
without a doc_id come after all others. An empty table gives an empty result. Other columns stay as they are;
where they have the name of a count, the count's name gets an underscore more.
"""

from __future__ import annotations

import string
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, arrow_batches, dropped, free_name, stored
from .mph import MinimalPerfectHash

SPACE = " \t\n\x0b\x0c\r"
#: Distinct hashes in a shard, about.
SHARD_KEYS = 100_000
#: Lines that a task asks of a shard, and the most shards that are asked in parts, so that their list can be broadcast.
PROBES, MOST_SPLIT = 1_000_000, 65_536
#: Fewer lines aren't worth a part of their own.
LEAST_PART = 1000
_INDEX = "shard long, sizes array<long>, bits binary, fingerprints binary, counts binary, firsts binary"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def _identity(docs: DataFrame) -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))


def _row() -> Column:
    """Key of a document: the hash of its doc_id and text."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), F.col("doc_id").isNull(), F.coalesce(F.col("text"), F.lit("")))


def _split() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """id, row, pos, h1 and h2 of each line whose key is long enough."""
    lines = docs.select(_identity(docs).alias("id"), _row().alias("row"), F.posexplode(_split()).alias("pos", "line")).select("id", "row", "pos", line_key(F.col("line")).alias("key"))
    return lines.where(F.length("key") >= min_chars).select("id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("fingerprint"), F.col("key")).alias("h2"))


def _index_row(shard: int, h1: np.ndarray, h2: np.ndarray, n: np.ndarray, first: np.ndarray) -> dict:
    """One shard. Of hashes that agree in h1 only the commonest is indexed; the others' lines stay (2**-64 a pair)."""
    order = np.lexsort((h2, -n, h1))
    order = order[np.concatenate([[True], h1[order][1:] != h1[order][:-1]])] if len(order) else order
    h1, h2, n, first = h1[order], h2[order], n[order], first[order]
    mph = MinimalPerfectHash.build(h1.view(np.uint64))
    place = np.argsort(mph.numbers(h1.view(np.uint64)))
    bits, sizes = mph.to_bytes()
    return {"shard": shard, "sizes": sizes, "bits": bits, "fingerprints": h2[place].tobytes(), "counts": np.minimum(n[place], 2**32 - 1).astype(np.uint32).tobytes(), "firsts": first[place].tobytes()}


class Shard:
    """The arrays of one shard, to be probed."""

    def __init__(self, row):
        self.mph = MinimalPerfectHash.from_bytes(row["bits"], list(row["sizes"]))
        self.fingerprints = np.frombuffer(row["fingerprints"], np.int64)
        self.counts = np.frombuffer(row["counts"], np.uint32)
        self.firsts = np.frombuffer(row["firsts"], np.int64)

    def first(self, h1: np.ndarray, h2: np.ndarray, least_copies: int) -> tuple[np.ndarray, np.ndarray]:
        """The first document of each line, and whether the line is indexed with least_copies or more."""
        if not self.mph.size:
            return np.zeros(len(h1), dtype=np.int64), np.zeros(len(h1), dtype=bool)
        at = self.mph.numbers(h1.view(np.uint64))
        return self.firsts[at], (at >= 0) & (self.fingerprints[at] == h2) & (self.counts[at] >= least_copies)


def build_index(repeated: DataFrame, shards: int) -> DataFrame:
    """Rows of shards from repeated (h1, h2, first, n)."""

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_index_row(int(key[0]), *(group[c].to_numpy(np.int64) for c in ("h1", "h2", "n", "first")))])

    arrow_batches(repeated.sparkSession)
    return repeated.withColumn("shard", F.pmod("h1", F.lit(shards))).groupBy("shard").applyInPandas(build, _INDEX)


def repeated_positions(lines: DataFrame, least_copies: int = 2) -> DataFrame:
    """row and pos of the lines to drop, from line_hashes()."""
    spark = lines.sparkSession
    document = F.struct("id", "row")
    counts = lines.groupBy("h1", "h2").agg(F.min(document).alias("first"), F.max(document).alias("last"), F.count("*").alias("n"))
    repeated = stored(counts.where(F.col("first") < F.col("last")).select("h1", "h2", F.col("first.row").alias("first"), "n"), "repeated-lines")
    keys, asked = repeated.count(), lines.count()
    shards = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), keys // SHARD_KEYS, 2 * asked // PROBES)
    # four times a shard's mean load, or less at that than PROBES; at most MOST_SPLIT shards can have more
    most = max(asked // MOST_SPLIT, min(PROBES, max(LEAST_PART, 4 * asked // shards)))
    own = lines.drop("id").withColumn("shard", F.pmod("h1", F.lit(shards)))
    crowded = stored(own.groupBy("shard").agg(F.ceil(F.count("*") / most).alias("parts")).where("parts > 1"), "crowded-shards")
    parts = F.coalesce("parts", F.lit(1))
    asking = own.join(F.broadcast(crowded), "shard", "left").withColumn("part", F.pmod(F.xxhash64("row", "pos"), parts)).drop("parts")
    index = build_index(repeated, shards).join(F.broadcast(crowded), "shard", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")

    def probe(index: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(index):
            return own[["row", "pos"]][:0]
        h1, h2, rows = (own[c].to_numpy(np.int64) for c in ("h1", "h2", "row"))
        first, known = Shard(index.iloc[0]).first(h1, h2, least_copies)
        return own[["row", "pos"]][known & (first != rows)]

    return index.groupBy("shard", "part").cogroup(asking.groupBy("shard", "part")).applyInPandas(probe, "row long, pos int")


def line_dedup(docs: DataFrame, min_chars: int = 10, least_copies: int = 2, counts: bool = True) -> DataFrame:
    """docs with text as kept, and (if counts) n_lines and n_dropped. Lines of fewer than least_copies copies in all stay."""
    key, split, gone = (free_name(docs, f"line_dedup_{x}") for x in ("row", "lines", "gone"))
    lines = stored(line_hashes(docs, min_chars), "lines")
    drops = stored(repeated_positions(lines, least_copies).groupBy("row").agg(F.collect_set("pos").alias("gone")), "dropped-lines")
    dropped(lines)
    joined = docs.withColumn(key, _row()).join(drops.select(F.col("row").alias(key), F.col("gone").alias(gone)), key, "left").withColumn(split, _split())
    lines, own = F.col(split), F.col(gone)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), own)
    text = F.when(own.isNull(), F.array_join(lines, "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    made = {"n_lines": F.size(lines), "n_dropped": F.coalesce(F.size(own), F.lit(0))} if counts else {}
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], *[n.cast("long").alias(free_name(docs, k)) for k, n in made.items()])


ORACLE_SQL = r"""
with lines as (
  select doc_id, pos, line, translate(trim(line, e' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), e'\n')) as line,
               generate_subscripts(string_split(coalesce(text, ''), e'\n'), 1) as pos
        from documents)
), keys as (
  select key, min(doc_id) as first from lines where length(key) >= 10 group by key having count(distinct doc_id) >= 2
), marked as (
  select l.doc_id, l.pos, l.line, k.first is not null and k.first <> l.doc_id as gone from lines l left join keys k on l.key = k.key
)
select doc_id, count(*) as n_lines, cast(sum(cast(gone as int)) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, e'\n' order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""

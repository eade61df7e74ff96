"""Connected components by large-star and small-star contraction of an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


#: A key of more than one in HOT rows, or of more than ROWS_A_TASK of them, is joined by broadcast; of so many rows these keys are at most HOT, or one in ROWS_A_TASK (a million keys, 24 MB, of 10^12 rows).
HOT, ROWS_A_TASK = 1024, 1_000_000


def joined_by(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with table, which has one row a key and in n the number of rows of that key, of `total` in all.

    Rows of the very common keys stay where they are, so no key brings more than ROWS_A_TASK rows to a task, whatever the number of rows.
    """
    most = min(ROWS_A_TASK, max(total, HOT) // HOT)
    hot, cold = (table.where(w).drop("n") for w in (F.col("n") > most, F.col("n") <= most))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def _least_neighbours(edges: DataFrame, total: int) -> DataFrame:
    """Large star: every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return joined_by(both.where("b > a"), least, "a", 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _least_below(edges: DataFrame) -> DataFrame:
    """Small star: a node and its smaller neighbours are linked to the least of these. After a large star these are few."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node in edges (a, b); component is its least reachable node.

    Nodes without a link, and links of a node to itself, give no row. Each round is written to the
    shared folder; rounds end when the edges stay the same, and are about the logarithm of the longest
    path in number. Sums and minima are taken before shuffles, so a node with very many links is no
    burden to one task; joins on such a node can be split.
    """
    before = None
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before, old = mark, now
        now = stored(_least_below(_least_neighbours(old, mark["n"])), "edges")
        dropped(old)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each one's component."""
    least = np.arange(n)
    while len(i):
        m = np.minimum(least[i], least[j])
        new = least.copy()
        np.minimum.at(new, least[i], m)
        np.minimum.at(new, least[j], m)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new[i] == new[j]).all():
            return new
        least = new
    return least


def dealt_blocks(keyed: DataFrame, block: int) -> DataFrame:
    """(cls, key) rows of keys with two members or more, dealt to pairs of blocks: cls, key, own, low, high.

    The members of a key are cut into blocks of about `block`; each pair of blocks (low, high) gets the
    members of both, so that every two members of a key meet in one group and no group is large.
    """
    busy = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = keyed.join(busy, "key").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks").cast("long")).cast("int"))
    met = own.select("cls", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return met.select("cls", "key", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

"""Near duplicates among embeddings by lattice hashing.

Each of TABLES random projections to eight dimensions is decoded to the nearest point of the E8 lattice.
A vector is filed under that point and under the PROBES neighbouring lattice points nearest to its
projection, with its label; vectors filed alike anywhere are candidates, verified by cosine in double
precision. A pair that meets in several cells counts in the one of smallest key. Cells give sums for
each vector and a spanning forest of their links, never the pairs; cells of more than BLOCK vectors are
compared in pairs of blocks. Equal vectors of a label are one class from the start.

TABLES, PROBES and SCALE are for cosines of 0.98 and more; see the README for measured recall.

Rows: vectors that are null, empty, zero, or hold null or non-finite components, and those with a null
label, link with nothing: no links, their own component, kept. Vectors of different lengths link with
nothing of another length. Rows that repeat a vec_id, label and vector count as one, and one row is
returned; different vectors of one vec_id, or of none, each count and are returned, in the order of their
hashes. Those without a vec_id come after all others. Classes of equal vectors are named by a 64-bit hash.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NULL_ID, arrow_batches, over_texts, stored
from .graph import connected_components, dealt_blocks, forest

TABLES, PROBES, SCALE = 5, 1, 5.0
BLOCK = 512
#: Cells of at most SMALL vectors are compared side by side; about LOT filed vectors make a task's group.
SMALL, LOT = 64, 8192


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum: rounding, and of odd sums the worst coordinate the other way."""
    point = np.rint(y)
    odd = np.flatnonzero(point.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(y[odd] - point[odd]).argmax(axis=1)
    point[odd, worst] += np.where(y[odd, worst] > point[odd, worst], 1.0, -1.0)
    return point


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Nearest E8 points: of the even-sum integers or those moved by one half."""
    whole, half = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    nearer = ((y - whole) ** 2).sum(axis=1) <= ((y - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


@lru_cache(maxsize=1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8, steps from a point to its neighbours."""
    pairs = [np.eye(8)[i] * a + np.eye(8)[j] * b for i in range(8) for j in range(i + 1, 8) for a in (1, -1) for b in (1, -1)]
    signs = np.array([[1 if m >> k & 1 else -1 for k in range(8)] for m in range(256)])
    return np.concatenate([pairs, signs[(signs < 0).sum(axis=1) % 2 == 0] / 2])


@lru_cache(maxsize=8)
def projections(dim: int, tables: int) -> np.ndarray:
    """For each table eight orthonormal directions (fewer dimensions are padded by zeros)."""
    draw = np.random.default_rng(20_240_607 + dim)
    return np.stack([np.linalg.qr(draw.standard_normal((max(8, dim), 8)))[0][:dim] for _ in range(tables)])


def cell_keys(x: np.ndarray, labels: np.ndarray, tables: int, probes: int, scale: float) -> np.ndarray:
    """Sorted keys of the cells of each unit vector."""
    keys = []
    weights = np.random.default_rng(8).integers(1 << 61, 1 << 62, 8, dtype=np.int64) | 1
    for t, p in enumerate(projections(x.shape[1], tables)):
        y = scale * x @ p
        home = nearest_e8(y)
        cells = [home]
        if probes:
            nearest = np.argsort(-((y - home) @ roots().T), axis=1, kind="stable")[:, :probes]
            cells += [home + roots()[nearest[:, k]] for k in range(probes)]
        for cell in cells:
            with np.errstate(over="ignore"):
                h = ((2 * cell).astype(np.int64) * weights).sum(axis=1) + labels.astype(np.int64) * 0x61C8864680B583EB + (t * 1_000_003 + x.shape[1]) * 0x27220A95
                h ^= (h.view(np.uint64) >> np.uint64(31)).view(np.int64)
                h *= np.int64(0x7FB5D329728EA185)
            keys.append(h)
    return np.sort(np.stack(keys, axis=1), axis=1)


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (id and, if the vector can link, label and two hashes), and classes (cls, label, first row, n, embedding) of equal vectors."""
    whole = isinstance(vectors.schema["label"].dataType, T.IntegralType)
    label = F.col("label").cast("long") if whole else F.when(F.col("label").isNotNull(), F.xxhash64("label"))  # only whether labels are equal counts
    own = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    can = F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    named = own.withColumns({"can": F.coalesce(can, F.lit(False)), "h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), F.col("embedding"))})
    if named.groupBy("id").count().where("count > 1").limit(1).count():
        named = named.withColumns({"size": F.size("embedding"), "unknown": F.xxhash64(F.transform("embedding", lambda x: x.isNull()))}).dropDuplicates(["id", "label", "h1", "h2", "size", "unknown"])
    classes = named.where("can").groupBy("label", "h1", "h2").agg(F.xxhash64("label", "h1", "h2").alias("cls"), F.min(F.struct("id", "h1", "h2")).alias("first"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    return named.select("id", "can", "label", "h1", "h2"), stored(classes, "vector-classes")


def filed(classes: DataFrame, tables: int, probes: int, scale: float) -> DataFrame:
    """cls, n, embedding and keys of each class, stored."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, n = (batch.column(k).to_numpy() for k in range(3))
            vectors = [np.array(v, dtype=np.float64) for v in batch.column(3).to_pylist()]
            for dim in sorted({len(v) for v in vectors}):
                at = np.array([i for i, v in enumerate(vectors) if len(v) == dim])
                x = np.stack([vectors[i] for i in at])
                unit = x / np.abs(x).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                keys = cell_keys(unit, labels[at], tables, probes, scale)
                yield pa.record_batch([pa.array(ids[at]), pa.array(n[at]), pa.array(list(unit), pa.list_(pa.float64())), pa.array(list(keys), pa.list_(pa.int64()))], names=["cls", "n", "unit", "keys"])

    return stored(over_texts(classes, ["cls", "label", "n", "embedding"], "cls long, n long, unit array<double>, keys array<long>", rows), "filed-vectors")


def _counts(keys_x: np.ndarray, keys_y: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Whether linked pairs count in this cell: they have no cell of smaller key in common."""
    out = np.ones(len(cell), dtype=bool)
    for c in range(keys_x.shape[1]):
        k = keys_x[:, c]
        smaller = np.flatnonzero(out & (k < cell))
        out[smaller] = ~(keys_y[smaller] == k[smaller, None]).any(axis=1)
    return out


def near_duplicates(vectors: DataFrame, least: float = 0.98, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """vec_id, n_links, component_id and kept of each vector (vec_id, embedding, label)."""
    rows, classes = classes_of(vectors)
    table = filed(classes, tables, probes, scale)
    keyed = table.select("cls", F.explode("keys").alias("key")).distinct()
    dealt = dealt_blocks(keyed, BLOCK)

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "low", "high", "cls"], ignore_index=True)
        cls, n, own, cell, low, high = (group[c].to_numpy() for c in ("cls", "n", "own", "key", "low", "high"))
        x, keys = np.stack(group["unit"].to_list()), np.stack(group["keys"].to_list())
        start = np.concatenate([[True], (cell[1:] != cell[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
        segment = np.cumsum(start) - 1
        first = np.flatnonzero(start)
        size = np.diff(np.append(first, len(cls)))
        links, lefts, rights = np.zeros(len(cls), dtype=np.int64), [], []

        def count(i: np.ndarray, j: np.ndarray, counts: np.ndarray) -> None:
            np.add.at(links, i[counts], n[j[counts]])
            np.add.at(links, j[counts], n[i[counts]])
            lefts.append(i)
            rights.append(j)

        # small cells side by side: each row with the next one of its cell, the one after that, and so on
        small = np.flatnonzero((size <= SMALL)[segment] & (low == high))
        for step in range(1, int(size[size <= SMALL].max(initial=0))):
            i = small[small + step < len(cls)]
            i = i[segment[i] == segment[i + step]]
            for at in range(0, len(i), 4096):
                a = i[at : at + 4096]
                a = a[np.einsum("ij,ij->i", x[a], x[a + step]) >= least]
                count(a, a + step, _counts(keys[a], keys[a + step], cell[a]))
        for k in np.flatnonzero((size > SMALL) | (low[first] != high[first])):
            rows_ = np.arange(first[k], first[k] + size[k])
            one, two = (rows_, None) if low[first[k]] == high[first[k]] else (rows_[own[rows_] == low[first[k]]], rows_[own[rows_] == high[first[k]]])
            for at in range(0, len(one), 256):
                close = x[one[at : at + 256]] @ x[one if two is None else two].T >= least
                i, j = np.nonzero(np.triu(close, k=at + 1) if two is None else close)
                i, j = one[i + at], (one if two is None else two)[j]
                count(i, j, _counts(keys[i], keys[j], cell[i]))
        root = forest(len(cls), np.concatenate(lefts), np.concatenate(rights)) if lefts else np.arange(len(cls))
        out = pd.DataFrame({"cls": cls, "links": links, "root": cls[root]})
        return out[(out["links"] > 0) | (out["cls"] != out["root"])].groupby(["cls", "root"], as_index=False).sum()[["cls", "links", "root"]]

    arrow_batches(vectors.sparkSession)
    dealt = stored(dealt, "dealt-vectors")
    lots = max(1, dealt.count() // LOT)
    lot = F.pmod(F.xxhash64("key", "low", "high"), F.lit(max(lots, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    found = stored(dealt.withColumn("lot", lot).join(table, "cls").groupBy("lot").applyInPandas(verify, "cls long, links long, root long"), "vector-links")
    parts = connected_components(found.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    per_class = (
        classes.select("label", "h1", "h2", "cls", "first", "n").join(links, "cls", "left").join(parts.withColumnRenamed("node", "cls"), "cls", "left")
        .select("label", "h1", "h2", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component"))
    )
    firsts = per_class.groupBy("component").agg(F.min("first").alias("least"))
    linked = per_class.drop("first").join(firsts, "component")
    named = rows.where("can").join(linked, ["label", "h1", "h2"]).select("id", "n_links", F.col("least.id").alias("component_id"), (F.struct("id", "h1", "h2") == F.col("least")).alias("kept"))
    alone = rows.where("not can").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    none = F.lit(NULL_ID)
    return named.unionByName(alone).select(F.nullif("id", none).alias("vec_id"), "n_links", F.nullif("component_id", none).alias("component_id"), "kept")


ORACLE_SQL = """
with recursive ok as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0 and list_dot_product(cast(embedding as double[]), cast(embedding as double[])) > 0
), pairs as (
  select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.98
), reach as (
  select vec_id, vec_id as other from embeddings union select r.vec_id, p.b from reach r join pairs p on p.a = r.other
), parts as (select vec_id, min(other) as component_id from reach group by vec_id),
n as (select a, count(*) as n from pairs group by a)
select vec_id, coalesce(n.n, 0) as n_links, component_id, vec_id = component_id as kept from parts left join n on n.a = parts.vec_id
"""

"""Near duplicates by SimHash, found through tables of distances to reference fingerprints.

PIVOTS reference fingerprints are the base fingerprint with one of its bits flipped, another one for
each; SPREAD_PIVOTS are unrelated ones. A fingerprint's row of the table is its Hamming distance to
every reference. Changing one bit of a fingerprint moves, against the distance to the base, the
distance to one of the PIVOTS only; so of GROUPS groups of these all but two stay the same. Fingerprints
at distance 2 or less thus share a key of three groups of distances, of ten such keys, which tell 38 bits
apart: keys of unlike fingerprints are shared by chance only where there are some 10^11. Pairs that share a key are
discarded when any coordinate of their table rows differs by more than 2, and survivors are verified by
their own distance. Keys that more than CROWD fingerprints share aren't paired: their fingerprints meet
instead at the fingerprints one bit away, of which no two at distance 2 or less lack a common one, and
which at most 65 share. Equal fingerprints are one class from the start.

Rows: null texts and texts without words have fingerprint zero and are linked like any others. Rows
that repeat a doc_id are each fingerprinted; they are one node of the graph. A null doc_id counts as one
document after all others. An empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, arrow_batches, free_name, over_texts, stored
from .graph import connected_components, dealt_blocks, forest, joined_by

_WORD = re.compile("[^\x20\t-\r]+").findall
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: Shingles turned into bits at a time.
_ROWS = 16_384

BASE = 0x5BD1E995CA6B94F3
PIVOTS = [BASE ^ (1 << i) for i in range(64)]
SPREAD_PIVOTS = [xxhash.xxh64_intdigest(b"pivot", seed) for seed in range(8)]
#: Groups of PIVOTS, and groups in a key: at least as many as two moved distances leave.
GROUPS, IN_KEY = 5, 3
CROWD = 4096


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    words = _WORD(text.translate(_LOWER))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) <= shingle else list(map(" ".join, zip(*(words[k:] for k in range(shingle)))))
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(shingles), _ROWS):
        h = np.array([digest(s, seed) for s in shingles[at : at + _ROWS]], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """id and fp (as a signed long) of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t or "", shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64), pa.int64())], names=["id", "fp"])

    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), "text")
    return over_texts(own, ["id", "text"], "id long, fp long", rows)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distance(a: Column, b: Column | int) -> Column:
    return F.bit_count(a.bitwiseXOR(F.lit(_signed(b)) if isinstance(b, int) else b))


def _packed(values: list[Column], bits: int) -> Column:
    out = F.lit(0).cast("long")
    for i, v in enumerate(values):
        out = out.bitwiseOR(F.shiftleft(v.cast("long"), bits * i))
    return out


def pivot_table(fps: DataFrame) -> DataFrame:
    """fp; groups: the PIVOTS' distances less the base's, a long for each group; spread: the SPREAD_PIVOTS' distances in one long."""
    base = _distance(F.col("fp"), BASE)
    moved = [(_distance(F.col("fp"), p) - base + 1) / 2 for p in PIVOTS]  # 0 or 1
    return fps.select(
        "fp", F.array(*[_packed(moved[g::GROUPS], 1) for g in range(GROUPS)]).alias("groups"), _packed([_distance(F.col("fp"), p) for p in SPREAD_PIVOTS], 7).alias("spread")
    )


def _keyed(table: DataFrame) -> DataFrame:
    """Each fingerprint under its keys of IN_KEY groups of distances."""
    keys = F.array(*[F.xxhash64(F.lit(n), *[F.get("groups", F.lit(g)) for g in chosen]) for n, chosen in enumerate(combinations(range(GROUPS), IN_KEY))])
    return table.select("fp", "spread", F.explode(keys).alias("key"))


def _coordinates_close(most: int) -> Column:
    """No coordinate of the two rows differs by more than most."""
    out = F.lit(True)
    for i in range(len(SPREAD_PIVOTS)):
        a, b = (F.shiftright(F.col(c), 7 * i).bitwiseAND(F.lit(127)) for c in ("x.spread", "y.spread"))
        out = out & (F.abs(a - b) <= most)
    return out


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect all distinct fingerprints at distance 2 or less."""
    keyed = stored(_keyed(pivot_table(fps)), "pivot-keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("least"), F.max("fp").alias("most")).where("n > 1")
    shared = keyed.join(sizes.where(F.col("n") <= CROWD).select("key"), "key", "left_semi")
    close = _coordinates_close(2) & (_distance(F.col("x.fp"), F.col("y.fp")) <= 2)
    pairs = shared.alias("x").join(shared.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & close)
    found = pairs.select(F.col("y.fp").alias("a"), F.col("x.fp").alias("b"))
    crowded = keyed.join(sizes.where(F.col("n") > CROWD).select("key"), "key", "left_semi").select("fp").distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    meeting = crowded.select("fp", F.explode(around).alias("middle"))
    least = meeting.groupBy("middle").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("middle", "b")
    met = meeting.join(least, "middle").select(F.col("fp").alias("a"), "b").where("a <> b")
    return found.unionByName(met)


def components(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """id, fp and component_id (the smallest id reachable by links) of each row."""
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
    parts = connected_components(links(classes.select("fp")))
    named = parts.join(classes, F.col("node") == F.col("fp")).select("fp", "component", "class_id")
    least = named.groupBy("component").agg(F.min("class_id").alias("least"))
    linked = named.join(least, "component").select("fp", "least")
    ids = stored(classes.join(linked, "fp", "left").select("fp", F.coalesce("least", "class_id").alias("component_id"), "n"), "fingerprint-components")
    # a repeated doc_id joins the classes of its rows
    repeats = rows.groupBy("id").agg(F.count_distinct("fp").alias("n")).where("n > 1").limit(1).count()
    if repeats:
        both = rows.join(ids.drop("n"), "fp").select("id", "component_id").distinct()
        more = connected_components(both.select(F.col("id").alias("a"), F.col("component_id").alias("b")))
        ids = ids.join(more, F.col("component_id") == F.col("node"), "left").select("fp", F.coalesce("component", "component_id").alias("component_id"), "n")
    return joined_by(rows, ids, "fp", rows.count()).select("id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


#: Words of 64 bits in a wide fingerprint, and differing bits in all up to which texts are candidates: shingle
#: sets of Jaccard similarity 0.8 differ in 38 to 48 of the 256 bits on average, with a deviation of 6.
WIDE, WIDE_BITS = 4, 80
#: Similarity of the shingle sets of two texts from which they are linked.
SIMILAR = 0.8
#: Keys a text is filed under, and the least shingles of a mixing that make up one: similarity s shares a key
#: with probability 1 - (1 - s**PER_KEY)**KEYS, 0.9998 at 0.8, in a table of any size.
KEYS, PER_KEY = 16, 4
_MIXERS = np.random.default_rng(256).integers(0, 2**63, (KEYS * PER_KEY, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Fingerprints, and texts, in a block that is compared at a time.
BLOCK, TEXTS = 1024, 256


def shingle_hashes(text: str, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a shorter text is one shingle, one without words has none."""
    words = _WORD(text.translate(_LOWER))
    shingles = [" ".join(words)] if 0 < len(words) <= shingle else map(" ".join, zip(*(words[k:] for k in range(shingle))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), dtype=np.uint64))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WIDE words, each like fingerprint() but of distinct shingles and of a hash mixed otherwise."""
    ones = np.zeros((WIDE, 64), dtype=np.int64)
    for at in range(0, len(hashes), _ROWS):
        h = hashes[at : at + _ROWS]
        for k in range(WIDE):
            m = (h ^ (h >> np.uint64(31))) * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1))
            m ^= m >> np.uint64(29)
            ones[k] += np.unpackbits(m.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view("<u8").ravel()


def filing_keys(hashes: np.ndarray) -> np.ndarray:
    """KEYS keys of a shingle set, each of the least members under PER_KEY mixings."""
    least = np.full(len(_MIXERS), 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), _ROWS // 16):
        m = hashes[at : at + _ROWS // 16] * _MIXERS[:, :1]
        m ^= m >> np.uint64(32)
        m *= _MIXERS[:, 1:]
        least = np.minimum(least, m.min(axis=1))
    return np.array([xxhash.xxh64_intdigest(part.tobytes(), k) for k, part in enumerate(least.reshape(KEYS, PER_KEY))], dtype=np.uint64)


def jaccard_roots(sets: list[np.ndarray], least: float, side: np.ndarray | None = None) -> np.ndarray:
    """The least member of each set's component under links of exact Jaccard similarity `least` or more.

    With side, only links between members of different sides count. Pairs that are connected already aren't
    compared, so n near copies take about n comparisons. Empty sets are similar to each other only.
    """
    size, root = np.array([len(s) for s in sets]), np.arange(len(sets))
    full = np.flatnonzero(size)
    if len(full) < len(sets):
        root[size == 0] = np.flatnonzero(size == 0)[0]
    if not len(full):
        return root
    _, codes = np.unique(np.concatenate([sets[i] for i in full]), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size[full])[:-1]])
    marked = np.zeros(codes.max() + 1, dtype=bool)
    for k, i in enumerate(full):
        j = full[k + 1 :]
        fits = (root[j] != root[i]) & (np.minimum(size[j], size[i]) >= least * np.maximum(size[j], size[i]) - 1e-9)
        if side is not None:
            fits &= side[j] != side[i]
        if not fits.any():
            continue
        own = codes[start[k] : start[k] + size[i]]
        marked[own] = True
        both = np.add.reduceat(marked[codes[start[k + 1] :]], start[k + 1 :] - start[k + 1], dtype=np.int64)
        marked[own] = False
        linked = j[fits & (both >= least * (size[i] + size[j] - both) - 1e-9)]
        if len(linked):
            joined = np.unique(np.append(root[linked], root[i]))
            root[np.isin(root, joined)] = joined[0]
    return root


def _row_key(docs: DataFrame) -> list[Column]:
    """id and text hash of a document; rows that agree in both are one document."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("near_dedup_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("near_dedup_text")]


def pivot_candidates(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that connect all those (cls, fp) of equal fingerprints and of fingerprints that links() connects."""
    own = stored(classes.distinct(), "class-fingerprints")
    first = stored(own.groupBy("fp").agg(F.min("cls").alias("b")), "first-classes")
    same = own.join(first, "fp").select(F.col("cls").alias("a"), "b")
    close = links(first.select("fp"))
    named = close.join(first.select(F.col("fp").alias("a"), F.col("b").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("b").alias("y")), "b")
    return same.unionByName(named.select(F.col("x").alias("a"), F.col("y").alias("b"))).where("a <> b").distinct()


def similar(docs: DataFrame, shingle: int = 5, most_bits: int = WIDE_BITS, least: float = SIMILAR) -> DataFrame:
    """near_dedup_id, near_dedup_text and component of each document: those that links of similarity `least` connect.

    Texts of equal shingle sets are one class, named by a hash of the set. Classes meet that share one of
    their KEYS keys, which are made of the least hashes of their shingles; so the probability to meet
    follows from the similarity alone and not from the number of documents. Those that meet and differ in
    most_bits at most connect candidates. So do all texts whose fingerprint() is at distance 2 or less, which the
    tables of distances to reference fingerprints find (links()). All pairs of connected candidates are then compared
    by the exact Jaccard similarity of their shingle sets, and only these comparisons make links.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            sets = [shingle_hashes(t, shingle) for t in texts]
            fps = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            wide = np.array([wide_fingerprint(s) for s in sets], dtype=np.uint64).reshape(-1, WIDE).view(np.int64).T
            cls = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            columns = [cls, fps, np.array([len(s) for s in sets], dtype=np.int64), *np.ascontiguousarray(wide)]
            keys = pa.array([filing_keys(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in columns], keys], names=[*key, "cls", "fp", "size", *names, "keys"])

    key, names = ["near_dedup_id", "near_dedup_text"], [f"w{k}" for k in range(WIDE)]
    own = docs.select(*_row_key(docs), "text")
    ids = stored(over_texts(own, [*key, "text"], ", ".join(f"{x} long" for x in [*key, "cls", "fp", "size", *names]) + ", keys array<long>", rows), "wide-fingerprints")
    classes = stored(ids.groupBy("cls").agg(F.min(F.struct(*key)).alias("row"), F.first(F.struct("size", *names, "keys")).alias("f")).select("cls", "row", "f.*"), "fingerprint-classes")

    def meet(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cls", ignore_index=True)
        cls, size, words = group["cls"].to_numpy(), group["size"].to_numpy(), [group[x].to_numpy().view(np.uint64) for x in names]
        left, right = (np.arange(len(cls)),) * 2 if key[1] == key[2] else (np.flatnonzero(group["own"] == key[1]), np.flatnonzero(group["own"] == key[2]))
        lefts, rights = [], []
        for at in range(0, len(left), 256):
            part = left[at : at + 256]
            far = sum(np.bitwise_count(w[part, None] ^ w[right]).astype(np.int16) for w in words)
            fits = np.minimum(size[part, None], size[right]) >= least * np.maximum(size[part, None], size[right]) - 1e-9
            i, j = np.nonzero((far <= most_bits) & fits)
            i, j = part[i], right[j]
            lefts.append(i[i != j])
            rights.append(j[i != j])
        root = forest(len(cls), np.concatenate(lefts), np.concatenate(rights)) if lefts else np.arange(len(cls))
        out = pd.DataFrame({"a": cls, "b": cls[root]})
        return out[out["a"] != out["b"]]

    def verify(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("cls").sort_values("cls", ignore_index=True)
        cls, sets = group["cls"].to_numpy(), [shingle_hashes(t or "", shingle) for t in group["text"]]
        out = pd.DataFrame({"a": cls, "b": cls[jaccard_roots(sets, least, None if key[1] == key[2] else group["own"].to_numpy())]})
        return out[out["a"] != out["b"]]

    keyed = classes.select("cls", F.explode("keys").alias("key"))
    met = dealt_blocks(stored(keyed, "filing-keys"), BLOCK).join(classes.select("cls", "size", *names), "cls")
    arrow_batches(docs.sparkSession)
    edges = met.groupBy("key", "low", "high").applyInPandas(meet, "a long, b long").unionByName(pivot_candidates(ids.select("cls", "fp")))
    candidates = connected_components(edges).select(F.col("node").alias("cls"), F.col("component").alias("key")).distinct()
    chosen = candidates.join(classes.select("cls", "row.*"), "cls")
    text = docs.select(*_row_key(docs), "text").join(chosen, key).select("cls", "key", "text")
    dealt = dealt_blocks(candidates, TEXTS).join(stored(text, "candidate-texts").drop("key"), "cls")
    links = dealt.groupBy("key", "low", "high").applyInPandas(verify, "a long, b long")
    parts = connected_components(links).distinct()
    return ids.select(*key, "cls").distinct().join(parts, F.col("cls") == F.col("node"), "left").select(*key, F.coalesce("component", "cls").alias("component"))


def near_dedup(docs: DataFrame, shingle: int = 5, most_bits: int = WIDE_BITS, least: float = SIMILAR) -> DataFrame:
    """docs without the documents that links of similarity `least` or more connect to one of smaller doc_id.

    Of equal ids the text of smaller hash counts as the smaller; of rows that repeat both, one stays. Rows
    with a null doc_id come after all others, each of them a document of its own.
    """
    found = stored(similar(docs, shingle, most_bits, least), "similar-documents")
    key = [free_name(docs, c) for c in found.columns[:2]]
    found = found.toDF(*key, "component")
    first = found.groupBy("component").agg(F.min(F.struct(*key)).alias("first"))
    gone = found.join(first, "component").where(F.struct(*key) != F.col("first")).select(*key)
    keyed = docs.select("*", *[c.alias(k) for c, k in zip(_row_key(docs), key, strict=True)])
    kept = keyed.join(gone, key, "left_anti")
    if keyed.groupBy(*key).count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(key)
    return kept.select(*docs.columns)

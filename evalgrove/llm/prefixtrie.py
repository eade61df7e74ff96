"""The trie of conversations that begin alike.

A node is a distinct sequence of first turns (role, text); the conversations that begin with it are its members.
Turns become hashes at once, so no text is shuffled. A prefix's digest is the exclusive or of its turns' hashes,
each hashed with its place: two words of 64 bits that can be added up in parts, so that a conversation of any
length is dealt to ranges and no task needs it whole.

A count-min sketch of all digests is added up from the tasks' own sketches, slice by slice, and handed to all tasks;
its size is bounded (`widest` counters of two bits in each of DEEP rows, 16 MB). An estimate of one proves that a
prefix has one member: its node is emitted where it is. Only possibly shared prefixes are shuffled and grouped exactly.
Where there are more prefixes than counters, more of them are only possibly unshared and go the exact way; results
are the same.

What a subtree holds is added up over members instead of nodes. The smallest member of a node is also that of
all nodes further down its own way, so each conversation has one depth from which on it stands for its nodes; what it
saves, and whether it is the one that stands for a leaf, are two numbers of the conversation, summed over a node's members.

Rows: turns are ordered by turn, null first, and where these are equal by hashes of role and text; repeated rows are turns
of their own; null role or text is empty; rows without conv_id belong to no conversation; an empty table gives no nodes, not
even a root; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows of the sketch, the most counters in a row, and counters in a slice.
DEEP, WIDEST, SLICE = 4, 1 << 24, 1 << 16
#: Bytes of a block of ids that are digested together.
BLOCK_BYTES = 1 << 15
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def turn_hashes(turns: DataFrame) -> DataFrame:
    """conv, turn, a and b (hashes of role and text) and chars (code points of the text) of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("second"), role, text).alias("b"), F.length(text).cast("long").alias("chars")
    )


def running(rows: DataFrame, key: str, order: list[Column], values: dict[str, tuple[str, str]], what: str) -> DataFrame:
    """rows (of longs) with running values over a key's rows in order, and `ends`: whether a row is its key's last one.

    values: name to (`sum` or `xor`, column). Ranges of keys and order are sorted apart, and what a key has in earlier
    ranges is added: a key that spans ranges is at the edge of each, so at most two keys a range are broadcast.
    """
    names = list(values)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, before, held = None, dict.fromkeys(names, 0), None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
            first = np.concatenate([[carried is None or keys[0] != carried], keys[1:] != keys[:-1]])
            start = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
            own = (start == 0) & (not first[0])
            made = []
            for name, (kind, column) in values.items():
                v = batch.column(batch.schema.get_field_index(column)).to_numpy()
                if kind == "sum":
                    total = np.cumsum(v)
                    run = total - (total - v)[start] + np.where(own, before[name], 0)
                else:
                    total = np.bitwise_xor.accumulate(v)
                    run = total ^ (total ^ v)[start] ^ np.where(own, before[name], 0)
                before[name] = int(run[-1])
                made.append(pa.array(run, pa.int64()))
            carried = keys[-1]
            if held is not None:
                yield finished(held, ends=bool(first[0]))
            held = batch, made, first
        if held is not None:
            yield finished(held, ends=True)

    def finished(held: tuple, ends: bool) -> pa.RecordBatch:
        batch, made, first = held
        last = pa.array(np.concatenate([first[1:], [ends]]))
        return pa.RecordBatch.from_arrays([*batch.columns, *made, last], names=[*batch.schema.names, *names, "ends"])

    schema = ", ".join([*(f"{c} {t}" for c, t in rows.dtypes), "part int", *(f"{n} long" for n in names), "ends boolean"])
    ranged = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order).withColumn("part", F.spark_partition_id())
    scanned = stored(ranged.mapInArrow(scan, schema), what)
    edges = scanned.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high")).select("part", F.explode(F.array_distinct(F.array("low", "high"))).alias(key))
    edges = edges.join(edges.groupBy(key).agg(F.max("part").alias("last_part"), F.count("*").alias("parts")).where("parts > 1"), key).select(key, "part", "last_part")
    at = [key, "part"]
    totals = scanned.join(F.broadcast(edges), at).groupBy(*at, "last_part").agg(*[(F.sum if kind == "sum" else F.bit_xor)(column).alias(n) for n, (kind, column) in values.items()])
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*at, (F.col("part") < F.col("last_part")).alias("goes_on"), *[F.coalesce((F.sum if kind == "sum" else F.bit_xor)(n).over(earlier), F.lit(0)).alias(f"earlier_{n}") for n, (kind, _) in values.items()])
    joined = scanned.join(F.broadcast(offsets), at, "left")
    placed = {n: (F.col(n) + F.coalesce(f"earlier_{n}", F.lit(0)) if kind == "sum" else F.col(n).bitwiseXOR(F.coalesce(f"earlier_{n}", F.lit(0)))) for n, (kind, _) in values.items()}
    return joined.select(*rows.columns, *[c.alias(n) for n, c in placed.items()], (F.col("ends") & ~F.coalesce("goes_on", F.lit(False))).alias("ends"))


def numbered(turns: DataFrame) -> DataFrame:
    """conv, pos (from 1), a, b and chars of each turn."""
    rows = turn_hashes(turns).withColumn("one", F.lit(1).cast("long")).withColumn("turn_null", F.col("turn").isNotNull().cast("long")).na.fill(0, ["turn"])
    order = [F.col(c) for c in ("turn_null", "turn", "a", "b")]
    return running(rows, "conv", order, {"pos": ("sum", "one")}, "numbered-turns").select("conv", "pos", "a", "b", "chars")


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """numbered() turns as conversations that begin like the first one of their group of ids: the first crc32(id) % most turns are its own first ones.

    Depth 0 is a row of each conversation, even of one without turns.
    """
    base = F.col("conv") - F.col("conv") % group
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    heads = turns.where((F.col("conv") % group == 0) & (F.col("pos") < most))
    sizes = heads.groupBy(F.col("conv").alias("base")).agg(F.count("*").alias("there"))
    own = turns.withColumn("taken", taken).where("pos > taken").withColumn("base", base).join(sizes, "base", "left")
    tails = own.select("conv", (F.col("pos") - F.col("taken") + F.least(F.col("taken"), F.coalesce("there", F.lit(0)))).alias("depth"), "a", "b", "chars")
    each = turns.where("pos = 1").select("conv", taken.alias("taken"), base.alias("base"))
    taught = each.join(heads.select(F.col("conv").alias("base"), "pos", "a", "b", "chars"), "base").where("pos <= taken").select("conv", F.col("pos").alias("depth"), "a", "b", "chars")
    return tails.unionByName(taught).unionByName(roots(turns))


def roots(turns: DataFrame) -> DataFrame:
    none = F.lit(0).cast("long")
    return turns.where("pos = 1").select("conv", none.alias("depth"), none.alias("a"), none.alias("b"), none.alias("chars"))


def _places(x: np.ndarray, y: np.ndarray, width: int) -> list[np.ndarray]:
    x, y = x.view(np.uint64), y.view(np.uint64)
    return [((x + np.uint64(k) * (y | np.uint64(1))) >> np.uint64(40 - 8 * k)) & np.uint64(width - 1) for k in range(DEEP)]


def _halved(counts: np.ndarray) -> bytes:
    """Counters of 0, 1 and 2 as two planes of bits."""
    return zlib.compress(np.packbits(counts > 0).tobytes() + np.packbits(counts > 1).tobytes(), 1)


def _whole(data: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8)).reshape(2, -1)
    return bits[0] + bits[1]


class Sketch:
    """Count-min counters that stop at two: all that is asked is whether a digest occurs once."""

    def __init__(self, width: int):
        self.width = width
        self.counts = np.zeros((DEEP, width), np.uint8)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        for row, at in zip(self.counts, _places(x, y, self.width), strict=True):
            u, n = np.unique(at, return_counts=True)
            row[u] = np.minimum(2, row[u] + np.minimum(n, 2))

    def once(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether a digest's estimate is one."""
        least = np.full(len(x), 2, np.uint8)
        for row, at in zip(self.counts, _places(x, y, self.width), strict=True):
            least = np.minimum(least, row[at])
        return least == 1

    def slices(self) -> Iterator[tuple[int, bytes]]:
        flat = self.counts.reshape(-1)
        for i in range(0, len(flat), SLICE):
            if flat[i : i + SLICE].any():
                yield i, _halved(flat[i : i + SLICE])

    def put(self, at: int, data: bytes) -> None:
        self.counts.reshape(-1)[at : at + SLICE] = _whole(data)


def count_min(prefixes: DataFrame, width: int) -> list[tuple[int, bytes]]:
    """The slices of the sketch of digests x, y: each task adds up its own, and a slice's ones meet in one task, one at a time."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(width)
        for batch in batches:
            sketch.add(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        for at, data in sketch.slices():
            yield pa.record_batch([pa.array([at], pa.int64()), pa.array([data], pa.binary())], names=["at", "data"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[at] = np.minimum(2, found[at] + _whole(data)) if at in found else _whole(data)
        yield pa.record_batch([pa.array(list(found), pa.int64()), pa.array(map(_halved, found.values()), pa.binary())], names=["at", "data"])

    kind = "at long, data binary"
    return [tuple(r) for r in prefixes.select("x", "y").mapInArrow(own, kind).repartition("at").mapInArrow(met, kind).collect()]


def screened(prefixes: DataFrame, widest: int = WIDEST) -> DataFrame:
    """prefixes (with x, y and above_x, above_y of the prefix one turn shorter) with alone and above_alone: proved to have one member.

    The root (depth 0) is never alone.
    """
    asked = prefixes.where("depth > 0")
    width = min(widest, max(SLICE // DEEP, 1 << (4 * asked.count()).bit_length()))
    shared = prefixes.sparkSession.sparkContext.broadcast(count_min(asked, width))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(width)
        for at, data in shared.value:
            sketch.put(at, data)
        for batch in batches:
            depth, x, y, above_x, above_y = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("depth", "x", "y", "above_x", "above_y"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sketch.once(x, y) & (depth > 0)), pa.array(sketch.once(above_x, above_y) & (depth > 1))], names=[*batch.schema.names, "alone", "above_alone"])

    return prefixes.mapInArrow(probe, ", ".join(f"{c} {t}" for c, t in prefixes.dtypes) + ", alone boolean, above_alone boolean")


def id_digests(rows: DataFrame, keys: list[str], value: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """keys (two longs) and sha256 of each group's values in decimal, ascending, with commas between.

    Values are sorted in ranges and joined to blocks; a digest is made in one pass over a group's blocks, so a task
    streams a group's text and holds one block of it.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, size = None, [], 0

        def block() -> pa.RecordBatch:
            return pa.record_batch([*(pa.array([k], pa.int64()) for k in now), pa.array([own[0]], pa.int64()), pa.array([",".join(map(str, own))])], names=[*keys, "first", "ids"])

        for batch in batches:
            for x, y, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own and ((x, y) != now or size >= block_bytes):
                    yield block()
                    own, size = [], 0
                now = (x, y)
                own.append(v)
                size += len(str(v)) + 1
        if own:
            yield block()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None

        def out(found: list) -> pa.RecordBatch:
            return pa.record_batch([*(pa.array([k[i] for k, _ in found], pa.int64()) for i in (0, 1)), pa.array([d for _, d in found], pa.string())], names=[*keys, "sha256"])

        for batch in batches:
            found = []
            for x, y, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (x, y) == now:
                    sha.update(b"," + ids.encode())
                else:
                    if now:
                        found.append((now, sha.hexdigest()))
                    now, sha = (x, y), hashlib.sha256(ids.encode())
            yield out(found)
        if now:
            yield out([(now, sha.hexdigest())])

    by = ", ".join(f"{k} long" for k in keys)
    made = rows.select(*keys, value).repartitionByRange(*keys, value).sortWithinPartitions(*keys, value).mapInArrow(blocks, f"{by}, first long, ids string")
    return made.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(digests, f"{by}, sha256 string")


def trie(turns: DataFrame, widest: int = WIDEST) -> DataFrame:
    """Nodes from conv, depth, a, b and chars: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 (of the members that end there) and the digest x, y. Each conversation has a row of depth 0."""
    at_root = F.col("depth") == 0
    placed = turns.select("conv", "depth", "chars", *[F.when(at_root, F.lit(0)).otherwise(F.xxhash64("depth", c)).cast("long").alias(c) for c in ("a", "b")])
    ways = running(placed, "conv", [F.col("depth")], {"x": ("xor", "a"), "y": ("xor", "b"), "below": ("sum", "chars")}, "prefixes")
    ways = ways.select("conv", "depth", "chars", "x", "y", F.col("x").bitwiseXOR(F.col("a")).alias("above_x"), F.col("y").bitwiseXOR(F.col("b")).alias("above_y"), "below", "ends")
    found = stored(screened(ways, widest), "screened-prefixes")
    single, possibly = found.where("alone"), found.where("not alone")

    node, counts = ["x", "y", "depth"], (F.count("*").alias("n"), F.min("conv").alias("least"), F.count_if(F.col("ends")).alias("n_ends"))
    shared = possibly.groupBy(*node).agg(*counts)
    # of the nodes on its way that a conversation doesn't stand for, the deepest one's text so far; and whether it stands for a leaf
    leaf = F.col("ends") & (F.col("n") == F.col("n_ends")) & (F.col("conv") == F.col("least"))
    met = possibly.where("depth > 0 or ends").join(shared, node).select("conv", F.when(F.col("conv") != F.col("least"), F.col("below")).otherwise(0).alias("saved"), leaf.cast("long").alias("leaf"))
    root_only = possibly.where("depth = 0 and not ends").select("conv", F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("leaf"))
    tails = single.where("ends").select("conv", F.lit(0).cast("long").alias("saved"), F.lit(1).cast("long").alias("leaf"))
    own = met.unionByName(root_only).unionByName(tails).groupBy("conv").agg(F.max("saved").alias("saved"), F.max("leaf").alias("leaf"))

    first = F.min_by(F.struct("saved", "above_x", "above_y", "above_alone", "chars", "below"), "conv")
    nodes = possibly.join(own, "conv").groupBy(*node).agg(*counts, F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("all_saved"), first.alias("own"))
    before = F.col("own.below") - F.col("own.chars")
    nodes = stored(nodes.select(
        *node, F.col("least").alias("conv_id"), F.col("n").alias("n_convs"), "n_ends", "n_leaves", (F.col("all_saved") - F.col("own.saved") - (F.col("n") - 1) * before).alias("saved_tokens"), "own.above_x", "own.above_y", "own.above_alone"
    ), "shared-nodes")

    links = nodes.where("depth > 0 and not above_alone").select("x", "y", "depth", "above_x", "above_y").unionByName(single.where("not above_alone").select("x", "y", "depth", "above_x", "above_y"))
    children = links.groupBy(F.col("above_x").alias("x"), F.col("above_y").alias("y"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    ends = id_digests(possibly.where("ends"), ["x", "y"], "conv")
    whole = nodes.join(children, node, "left").join(ends, ["x", "y"], "left")
    shown = whole.select(*node, "above_x", "above_y", "above_alone", "conv_id", "n_convs", F.coalesce("n_children", F.when(F.col("n_ends") == F.col("n_convs"), 0).otherwise(1)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
    one = F.lit(1).cast("long")
    alone = single.select(
        *node, "above_x", "above_y", "above_alone", F.col("conv").alias("conv_id"), one.alias("n_convs"), (~F.col("ends")).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.sha2(F.when(F.col("ends"), F.col("conv").cast("string")).otherwise("").cast("binary"), 256).alias("ends_sha256"),
    )
    every = shown.unionByName(alone)
    root = nodes.where("depth = 0").select(F.col("conv_id").alias("root_conv_id"))  # one row
    parents = nodes.where("depth > 0").select(F.col("x").alias("above_x"), F.col("y").alias("above_y"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above_conv_id"))
    near = every.where("depth < 2 or above_alone").crossJoin(F.broadcast(root)).withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("root_conv_id")).when(F.col("depth") > 1, F.col("conv_id"))).drop("root_conv_id")
    far = every.where("depth > 1 and not above_alone").join(parents, ["above_x", "above_y", "depth"]).withColumnRenamed("above_conv_id", "parent_conv_id")
    return near.unionByName(far).select("conv_id", "depth", "parent_conv_id", *[F.col(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], "ends_sha256", "x", "y")


def prefix_trie(turns: DataFrame, widest: int = WIDEST) -> DataFrame:
    """trie() of the conversations of a table conv_id, turn, role, text as they are."""
    own = numbered(turns)
    return trie(own.withColumnRenamed("pos", "depth").unionByName(roots(own)), widest)


ORACLE_SQL = r"""
with t as (
  select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as x, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos
  from conversations where conv_id is not null
), bits as (
  select c, flatten(list_transform(range(1, length(s) + 1), lambda i: list_transform(range(8), lambda j: cast((ascii(s[i]) >> j) & 1 as bigint)))) as b from (select distinct c, cast(c as varchar) as s from t)
), ids as (
  select c, c - c % 100 as base, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda a, z: xor(a >> 1, case when xor(a, z) & 1 = 1 then 3988292384 else 0 end))) % 6 as h from bits
), made as (
  select i.c, 0 as part, t.pos, t.r, t.x from ids i join t on t.c = i.base and t.pos <= i.h union all select i.c, 1, t.pos, t.r, t.x from ids i join t on t.c = i.c and t.pos > i.h
), numbered as (
  select c, row_number() over (partition by c order by part, pos) as d, r, x from made
), ways as (
  select a.c, a.d, length(any_value(a.x)) as chars, sha256(string_agg(concat(length(b.r), ':', b.r, length(b.x), ':', b.x), '' order by b.d)) as k
  from numbered a join numbered b on a.c = b.c and b.d <= a.d group by 1, 2 union all select c, 0, 0, '' from ids
), lengths as (
  select c, max(d) as l from ways group by 1
), nodes as (
  select k, d, min(c) as conv_id, count(*) as n, count(*) filter (l > d) = 0 as leaf, any_value(chars) as chars, sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (l = d), '')) as ends_sha256
  from ways join lengths using (c) group by 1, 2
), subtrees as (
  select w.k, w.d, count(*) filter (v.leaf) as n_leaves, sum((v.n - 1) * v.chars) as saved_tokens from nodes v join ways w on w.c = v.conv_id and w.d <= v.d group by 1, 2
), parents as (
  select v.k, v.d, p.k as above, u.conv_id as parent_conv_id from nodes v join ways p on p.c = v.conv_id and p.d = v.d - 1 join nodes u on u.k = p.k and u.d = p.d
), children as (
  select above as k, d - 1 as d, count(*) as n_children from parents group by 1, 2
)
select conv_id, cast(d as bigint) as depth, parent_conv_id, n as n_convs, coalesce(n_children, 0) as n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens, ends_sha256
from nodes join subtrees using (k, d) left join parents using (k, d) left join children using (k, d)
"""

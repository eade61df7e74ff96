"""Bootstrap intervals and paired permutation tests for groups of any size, and in plain SQL.

Rows are counted by distinct value first. What is drawn for a group are sums, one a resample; tasks draw the parts that
their values add to these, and only the sums are shuffled, CHUNK of them a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESAMPLES, DRAWS, EXACT_PAIRS = 2000, 10_000, 16
#: Distinct values that are drawn together, sums in a shuffled row, and numbers that a task draws at once.
BLOCK, CHUNK, AT_ONCE = 1024, 50, 2_000_000
#: Draws, and sums of sign choices, that a task works on at once: they stay in a core's own cache.
DRAWN, SIGNED = 1 << 16, 1 << 16
#: P(Poisson(1) <= k) for k from 0.
_POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]


def _generator(*seeds: int) -> np.random.Generator:
    """A counter-based stream for these seeds, the same in whatever task asks."""
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([s & ((1 << 64) - 1) for s in seeds])))


def _seed(seed: int, keys: list[str]) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(k).cast("string") for k in keys])


def _joined(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of their group; null keys are a group."""
    if not keys:
        return rows.crossJoin(F.broadcast(groups))  # one row
    named = groups.withColumnsRenamed({k: f"group_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"group_{k}"))
    return rows.join(named, same).drop(*[f"group_{k}" for k in keys])


def _counted(rows: DataFrame, keys: list[str], value: str, times: str | None = None) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg((F.sum(F.col(times).cast("long")) if times else F.count("*")).alias("c"))


def _chunks(kept: list[pa.Array], names: list[str], places: list[int], sums: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each CHUNK of sums: the kept columns of row places[i], the chunk's number, and the sums, zeros at the end."""
    n = -(-len(sums[0]) // CHUNK)
    whole = np.zeros((len(sums), n * CHUNK))
    for row, s in zip(whole, sums, strict=True):
        row[: len(s)] = s
    whole = whole.reshape(-1, CHUNK)
    at = pa.array(np.repeat(places, n))
    columns = [c.take(at) for c in kept] + [pa.array(np.tile(np.arange(n, dtype=np.int32), len(places)))] + [pa.array(whole[:, i]) for i in range(CHUNK)]
    return pa.record_batch(columns, names=[*names, "chunk", *(f"s{i}" for i in range(CHUNK))])


_SUMS = ", chunk int, " + ", ".join(f"s{i} double" for i in range(CHUNK))


def _kinds(df: DataFrame, names: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in names)


def _drawn_sums(rng: np.random.Generator, times: np.ndarray, v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each resample, the sum of `times` draws with replacement from values v that are there c times."""
    total = int(c.sum())
    if total > 16 * len(v):  # few values, many of each: how often each is drawn costs less than the draws
        per = max(1, AT_ONCE // len(v))
        return np.concatenate([rng.multinomial(times[i : i + per], c / total) @ v for i in range(0, len(times), per)])
    held, out = np.repeat(v, c), np.zeros(len(times))
    kind = np.uint16 if total <= 1 << 16 else np.int64  # four short numbers come from one random word
    some = np.flatnonzero(times)
    ends, begin = np.cumsum(times[some]), 0
    while begin < len(some):
        done = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + DRAWN, "right")))
        drawn = held[rng.integers(0, total, int(ends[end - 1]) - done, dtype=kind)]
        out[some[begin:end]] = np.add.reduceat(drawn, np.concatenate([[0], ends[begin : end - 1] - done]))
        begin = end
    return out


def bootstrap_mean(rows: DataFrame, keys: list[str], value: str, resamples: int = RESAMPLES, seed: int = 0, times: str | None = None) -> DataFrame:
    """keys, mean, n, stdev (of the resampled means), ci_low and ci_high (percentile interval) of each group; null values don't count. A row stands for `times` values.

    A resample draws n rows of a group with replacement. A group's distinct values are dealt to blocks of about BLOCK by hash. How many
    draws fall to each block comes from a tree over its blocks: from the root on, a node's draws are split between its halves by a binomial,
    seeded by group and node, so each block finds its own number on its way down without the others. Then a block draws its own
    values. Memory is bounded by a block, whatever the group, and results don't depend on how rows are dealt to tasks.
    """
    counts = _counted(rows, keys, value, times)
    sizes = counts.groupBy(*keys).agg(F.count("*").alias("distinct"), F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))
    sizes = sizes.withColumn("levels", F.greatest(F.lit(0), F.ceil(F.log2(F.col("distinct") / BLOCK))).cast("int")).drop("distinct")
    block = F.pmod(F.xxhash64("v"), F.expr("shiftleft(1L, levels)"))
    group = [*keys, "n", "mean", "levels"]
    blocks = _joined(counts, sizes, keys).groupBy(*group, block.alias("block")).agg(F.sum("c").alias("size"), F.array_sort(F.collect_list(F.struct("v", "c"))).alias("held"))
    # each block's way from the root: at a node, the rows below it and those below its left half
    ways = blocks.where("levels > 0").select(*keys, "block", "size", F.explode(F.sequence(F.lit(1), F.col("levels"))).alias("level"))
    ways = ways.withColumns({"node": F.expr("shiftright(block, level)"), "right": F.expr("shiftright(block, level - 1) & 1")})
    nodes = ways.groupBy(*keys, "level", "node").agg(F.sum("size").alias("whole"), F.sum(F.when(F.col("right") == 0, F.col("size")).otherwise(0)).alias("left"))
    met = _joined(ways.drop("size"), nodes, [*keys, "level", "node"])
    ways = met.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct("level", "node", "whole", "left", "right")), asc=False).alias("way"))
    named = ways.withColumnsRenamed({k: f"way_{k}" for k in [*keys, "block"]})
    same = F.col("block") == F.col("way_block")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"way_{k}"))
    drawn = blocks.join(named, same, "left").select(*keys, "n", "mean", _seed(seed, keys).alias("seed"), "block", "held", "way")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, names = batch.columns[: len(keys) + 2], batch.schema.names[: len(keys) + 2]
            own = [batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("n", "seed", "block")]
            for i, (n, seed, block) in enumerate(zip(*own, strict=True)):
                held, way = batch.column(batch.num_columns - 2)[i].values, batch.column(batch.num_columns - 1)[i].as_py()
                times = np.full(resamples, n, np.int64)
                for step in way or []:
                    left = _generator(seed, step["level"], step["node"]).binomial(times, step["left"] / step["whole"])
                    times = times - left if step["right"] else left
                sums = _drawn_sums(_generator(seed, 0, block), times, held.field(0).to_numpy(), held.field(1).to_numpy())
                yield _chunks(kept, names, [i], [sums])

    named = [*keys, "n", "mean"]
    sums = drawn.mapInArrow(draw, _kinds(drawn, named) + _SUMS).groupBy(*named, "chunk").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(CHUNK)])
    one = sums.select(*named, "chunk", F.posexplode(F.array(*[f"s{i}" for i in range(CHUNK)])).alias("place", "sum")).where(F.col("chunk") * CHUNK + F.col("place") < resamples)
    ends = one.groupBy(*named).agg(F.stddev_pop(F.col("sum") / F.col("n")).alias("stdev"), F.percentile(F.col("sum") / F.col("n"), F.array(F.lit(0.025), F.lit(0.975))).alias("ends"))
    return ends.select(*keys, "mean", "n", "stdev", F.get("ends", F.lit(0)).alias("ci_low"), F.get("ends", F.lit(1)).alias("ci_high"))


def poisson_weight(key: Column, resample: Column) -> Column:
    """How often a row is in a resample: Poisson(1) by a digest of its key and the resample's number."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), resample.cast("string")).cast("binary"))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0
    return sum(((u > p).cast("int") for p in _POISSON), F.lit(0))


def bootstrap_poisson(rows: DataFrame, keys: list[str], value: str, unit: str, resamples: int = 50) -> DataFrame:
    """The same interval in SQL functions alone, with digests for randomness. Rows times resamples are made, so resamples are few;
    each row's weights are added up before a shuffle."""
    drawn = rows.where(F.col(value).isNotNull()).select(*keys, unit, value, F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b"))
    means = drawn.withColumn("w", poisson_weight(F.col(unit), F.col("b"))).groupBy(*keys, "b").agg((F.sum(F.col("w") * F.col(value)) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    ends = means.groupBy(*keys).agg(F.round(F.percentile("m", F.lit(0.025)), 9).alias("ci_low"), F.round(F.percentile("m", F.lit(0.975)), 9).alias("ci_high"))
    return rows.groupBy(*keys).agg(F.round(F.avg(value), 9).alias("mean"), F.count(value).alias("n")).join(ends, keys)


def poisson_sql(key: str, resample: str) -> str:
    u = f"(cast(('0x' || substr(md5(concat({key}, '|', {resample})), 1, 8)) as bigint) / 4294967296.0)"
    return "(" + " + ".join(f"cast({u} > {p!r} as int)" for p in _POISSON) + ")"


#: Figures of agreement that cells_intervals() draws; the last three can be undefined in a resample.
FIGURES = ["exact", "within_one", "mae", "mean_human", "mean_judge", "pearson", "spearman", "kappa"]
UNDEFINED = FIGURES[-3:]


def _correlation(x: np.ndarray, y: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    sx, sy = (w * x).sum(axis=1), (w * y).sum(axis=1)
    vx, vy = (w * x * x).sum(axis=1) - sx * sx / n, (w * y * y).sum(axis=1) - sy * sy / n
    cov = (w * x * y).sum(axis=1) - sx * sy / n
    known = (vx > 1e-9 * n) & (vy > 1e-9 * n) if n > 1 else np.zeros(len(w), bool)
    return np.where(known, cov / np.sqrt(np.where(known, vx * vy, 1.0)), np.nan)


def cell_figures(h: np.ndarray, j: np.ndarray, drawn: np.ndarray) -> dict[str, np.ndarray]:
    """Each of FIGURES for rows of counts of the cells (h, j); NaN where it is undefined."""
    n = int(drawn[0].sum())
    w = drawn.astype(np.float64)
    gap = np.abs(h - j)
    hs, hi = np.unique(h, return_inverse=True)
    js, ji = np.unique(j, return_inverse=True)
    by_h, by_j = w @ np.eye(len(hs))[hi], w @ np.eye(len(js))[ji]
    ranks = [(np.cumsum(by, axis=1) - by + (by + 1) / 2)[:, i] for by, i in ((by_h, hi), (by_j, ji))]
    apart = (hs[:, None] - js[None, :]) ** 2
    chance = ((by_h @ apart) * by_j).sum(axis=1)
    kappa = np.where(chance > 0, 1 - w @ (gap**2) * n / np.where(chance > 0, chance, 1.0), np.nan)
    return {
        "exact": w @ (gap == 0) / n, "within_one": w @ (gap <= 1) / n, "mae": w @ gap / n, "mean_human": w @ h / n, "mean_judge": w @ j / n,
        "pearson": _correlation(h, j, w, n), "spearman": _correlation(*ranks, w, n), "kappa": kappa,
    }


def cell_intervals(counted: DataFrame, keys: list[str], resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """keys and, of each figure of agreement, its 95 % bootstrap interval (figure_low, figure_high); of those that can be undefined, how many resamples were (figure_undefined).

    counted has h, j and c: counts of (human, judge) values. A resample of pairs is one multinomial draw of these counts and feeds all
    figures at once; undefined ones are left out of that figure's interval. A figure that is undefined itself has no interval. A group is one
    row of its cells: 25 for scores of 1 to 5.
    """
    groups = counted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("h").cast("double").alias("h"), F.col("j").cast("double").alias("j"), "c"))).alias("cells"))
    groups = groups.select(*keys, _seed(seed, keys).alias("seed"), "cells")
    names = [*(f"{f}_{e}" for f in FIGURES for e in ("low", "high")), *(f"{f}_undefined" for f in UNDEFINED)]

    def one(seed: int, h: np.ndarray, j: np.ndarray, c: np.ndarray) -> list:
        n = int(c.sum())
        drawn = _generator(seed).multinomial(n, c / n, size=resamples)
        point, found = cell_figures(h, j, c[None, :]), cell_figures(h, j, drawn)
        ends: list = []
        for f in FIGURES:
            known = found[f][~np.isnan(found[f])]
            ends += map(float, np.percentile(known, [2.5, 97.5])) if len(known) and not np.isnan(point[f][0]) else [None, None]
        return [*ends, *(int(np.isnan(found[f]).sum()) for f in UNDEFINED)]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [x.values for x in batch.column(len(keys) + 1)]
            rows = [one(seed, *(x.field(i).to_numpy() for i in range(3))) for seed, x in zip(batch.column(len(keys)).to_pylist(), cells, strict=True)]
            kinds = [pa.float64()] * (2 * len(FIGURES)) + [pa.int64()] * len(UNDEFINED)
            yield pa.record_batch([*batch.columns[: len(keys)], *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[*keys, *names])

    kinds = [_kinds(groups, keys)] if keys else []
    return groups.mapInArrow(draw, ", ".join([*kinds, *(f"{n} {'long' if n.endswith('undefined') else 'double'}" for n in names)]))


def _exact_ps(held: list[np.ndarray], seen: np.ndarray) -> np.ndarray:
    """p of each of many small groups of differences: all ways to choose signs, by doubling, for all groups with as many differences at once.

    Differences of zero change nothing. Turning all signs gives the same size, so the first sign stays.
    """
    out = np.ones(len(held))
    held = [d[d != 0] for d in held]
    sizes = np.array([len(d) for d in held])
    for n in np.unique(sizes[sizes > 0]):
        of = np.flatnonzero(sizes == n)
        per = max(1, SIGNED >> int(n - 1))
        for i in range(0, len(of), per):
            own = of[i : i + per]
            d = np.array([held[k] for k in own])
            sums = d[:, :1]
            for k in range(1, n):
                sums = np.concatenate([sums + d[:, k : k + 1], sums - d[:, k : k + 1]], axis=1)
            out[own] = (np.abs(sums) >= seen[own, None] - 1e-9).mean(axis=1)
    return out


#: Up to so many equal differences are flipped one by one; up to so many by the bits of random words; more by a binomial.
SINGLES, IN_WORDS = 12, 1024
_SIGNS = 2.0 * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) - 1.0


def _flipped_sums(rng: np.random.Generator, v: np.ndarray, c: np.ndarray, draws: int) -> np.ndarray:
    """What counted differences add to each draw's sum of differences with random signs.

    Of eight differences one random byte chooses all signs: their sums are read off a table of 256.
    """
    total, raw = np.zeros(draws), rng.bit_generator.random_raw
    few = c <= SINGLES
    singles = np.repeat(v[few], c[few])
    singles = np.concatenate([singles, np.zeros(-len(singles) % 8)]).reshape(-1, 8)
    for table in singles @ _SIGNS.T:
        total += table[raw(-(-draws // 8)).view(np.uint8)[:draws]]
    for size, count in zip(v[~few].tolist(), c[~few].tolist(), strict=True):
        if count > IN_WORDS:
            heads = rng.binomial(count, 0.5, draws)
        else:
            words = raw(-(-count // 64) * draws).reshape(-1, draws)
            words[0] >>= np.uint64(-count % 64)
            heads = np.bitwise_count(words).sum(axis=0, dtype=np.int64)
        total += size * (2 * heads - count)
    return total


def _tested(own: DataFrame, keys: list[str], exact: int) -> DataFrame:
    """keys, n, p_value and method of the groups of at most `exact` differences, from counts with their group's n and seen."""
    group = [*keys, "n", "seen"]
    small = own.where(F.col("n") <= exact).groupBy(*group).agg(F.collect_list(F.struct("v", "c")).alias("held"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.repeat(x.values.field(0).to_numpy(), x.values.field(1).to_numpy()) for x in batch.column(len(group))]
            p = _exact_ps(held, batch.column(len(keys) + 1).to_numpy())
            yield pa.record_batch([*batch.columns[: len(keys) + 1], pa.array(p), pa.array(["exact"] * len(p), pa.string())], names=[*keys, "n", "p_value", "method"])

    return small.mapInArrow(test, _kinds(small, [*keys, "n"]) + ", p_value double, method string")


def _sizes(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.abs(F.sum(F.col("v") * F.col("c"))).alias("seen"), F.count("*").alias("distinct"), F.max(F.abs("v")).alias("most"))


def paired_permutation(differences: DataFrame, keys: list[str], value: str, exact: int = EXACT_PAIRS, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """keys, n, p_value (two-sided, of the mean difference) and method of each group: all ways to flip signs up to `exact` pairs, drawn flips above.

    Small groups are rows of their differences, tested many at a time. The distinct differences of large ones are dealt to blocks of about
    BLOCK by hash, each adds its part to the sums of all draws, and these are added up on their way. A block's signs depend on group, block and
    its differences alone, so results don't depend on how rows are dealt to tasks. One more hit keeps a drawn p off zero; without a difference it is 1.
    """
    counts = _counted(differences, keys, value)
    sizes = _sizes(counts, keys)
    own, group = _joined(counts, sizes.drop("most"), keys), [*keys, "n", "seen"]
    levels = F.greatest(F.lit(0), F.ceil(F.log2(F.col("distinct") / BLOCK))).cast("int")
    dealt = own.where((F.col("n") > exact) & (F.col("v") != 0)).withColumn("levels", levels).withColumn("block", F.pmod(F.xxhash64("v"), F.expr("shiftleft(1L, levels)")))
    large = dealt.groupBy(*group, "block").agg(F.array_sort(F.collect_list(F.struct("v", "c"))).alias("held")).select(*group, _seed(seed, keys).alias("seed"), "block", "held")

    def flip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[int, tuple[int, np.ndarray]] = {}  # by group: a row of it, and its sums
            seeds, blocks, held = (batch.column(i) for i in range(len(group), len(group) + 3))
            for i, (own, block) in enumerate(zip(seeds.to_pylist(), blocks.to_pylist(), strict=True)):
                v, c = (held[i].values.field(k).to_numpy() for k in range(2))
                added = _flipped_sums(_generator(own, block), v, c, draws)
                first, before = sums.get(own, (i, 0.0))
                sums[own] = first, before + added
                if len(sums) * draws >= AT_ONCE:
                    yield _chunks(batch.columns[: len(group)], group, [k for k, _ in sums.values()], [x for _, x in sums.values()])
                    sums = {}
            if sums:
                yield _chunks(batch.columns[: len(group)], group, [k for k, _ in sums.values()], [x for _, x in sums.values()])

    sums = large.mapInArrow(flip, _kinds(large, group) + _SUMS).groupBy(*group, "chunk").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(CHUNK)])
    hits = sum(((F.abs(f"s{i}") >= F.col("seen") - 1e-9 * F.col("n")) & (F.col("chunk") * CHUNK + i < draws)).cast("long") for i in range(CHUNK))
    found = sums.groupBy(*keys, "n").agg(((F.sum(hits) + 1) / (draws + 1)).alias("p_value"))
    without = sizes.where((F.col("n") > exact) & (F.col("most") == 0)).select(*keys, "n", F.lit(1.0).alias("p_value"))
    return _tested(own, keys, exact).unionByName(found.unionByName(without).withColumn("method", F.lit("sampled")))


def permutation_exact(differences: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two-sided p of the mean of at most EXACT_PAIRS differences, over all ways to flip signs. Larger groups have null, and nothing is drawn for them."""
    counts = _counted(differences, keys, value)
    sizes = _sizes(counts, keys).drop("most", "distinct")
    tested = _tested(_joined(counts, sizes, keys), keys, EXACT_PAIRS).select(*keys, "n", F.round("p_value", 9).alias("p_value"))
    return tested.unionByName(sizes.where(F.col("n") > EXACT_PAIRS).select(*keys, "n", F.lit(None).cast("double").alias("p_value")))


def permutation_sampled(differences: DataFrame, keys: list[str], value: str, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """The same p by drawn flips for groups of any size."""
    return paired_permutation(differences, keys, value, exact=0, draws=draws, seed=seed).drop("method")

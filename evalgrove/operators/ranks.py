"""Order statistics of groups of any size: distinct values are counted, ranges of them sorted apart, and counts before each range added."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import shared_dir


def running_counts(counted: DataFrame, order: list, count: str) -> DataFrame:
    """counted with first and last: the places, from 0, that a row's `count` members have in the total order.

    Ranges are drawn by sampling, so they are checkpointed before both reads; no task holds more than a range, whatever the groups.
    """
    shared_dir(counted.sparkSession)
    ranged = counted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).checkpoint()
    within = F.sum(count).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sizes = ranged.groupBy("part").agg(F.sum(count).alias("size"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy(F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.size"), F.lit(0)).alias("before"))
    placed = ranged.withColumn("within", within).join(F.broadcast(before), "part")  # one row a range
    last = F.col("before") + F.col("within") - 1
    return placed.withColumns({"last": last.cast("long"), "first": (last - F.col(count) + 1).cast("long")}).drop("part", "within", "before")


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], times: str | None = None) -> DataFrame:
    """keys and, by name, linearly interpolated percentiles of each group. Null keys are a group; null values don't count. A row stands for `times` values."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("x")).agg((F.sum(times) if times else F.count("*")).alias("c"))
    placed = running_counts(counted, [*keys, "x"], "c")
    ends = placed.groupBy(*keys).agg(F.min("first").alias("begins"), (F.max("last") - F.min("first")).alias("most"))
    if keys:
        a, b = placed.alias("a"), ends.alias("b")
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        own = a.join(b, same).select(*[F.col(f"a.{k}").alias(k) for k in keys], "x", "first", "last", "begins", "most")
    else:
        own = placed.crossJoin(F.broadcast(ends))  # one row
    first, last = F.col("first") - F.col("begins"), F.col("last") - F.col("begins")
    rank = {k: F.lit(p) * F.col("most") for k, p in shares.items()}
    near = [F.max(F.when((first <= end(r)) & (last >= end(r)), F.col("x"))).alias(f"{k}_{n}") for k, r in rank.items() for n, end in (("low", F.floor), ("high", F.ceil))]
    found = own.groupBy(*keys).agg(*near, F.max("most").alias("most"))
    part = {k: r - F.floor(r) for k, r in rank.items()}
    return found.select(*keys, *[(F.col(f"{k}_low") + (F.col(f"{k}_high") - F.col(f"{k}_low")) * part[k]).alias(k) for k in shares])

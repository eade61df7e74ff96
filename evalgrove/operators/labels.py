"""Human labels: latest records, provenance, coverage, annotation order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import running_counts


def latest(records: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The record of highest order for each key."""
    rest = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def duplicate_keys(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keys that occur more than once, with their count and first place."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1")


def provenance(records: DataFrame, items: DataFrame, responses: DataFrame, dataset: str) -> DataFrame:
    """records (item_id, dataset_sha256, response_sha256) with the first reason for which each can't be used, null if it can."""
    known = items.select("item_id").distinct().withColumn("has_item", F.lit(True))
    said = responses.select("item_id", F.sha2(F.col("response").cast("binary"), 256).alias("said_sha256"))
    joined = records.join(known, "item_id", "left").join(said, "item_id", "left")
    why = (
        F.when(~F.col("dataset_sha256").eqNullSafe(F.lit(dataset)), "other dataset").when(F.col("has_item").isNull(), "unknown item")
        .when(F.col("said_sha256").isNull(), "no response").when(~F.col("response_sha256").eqNullSafe(F.col("said_sha256")), "other response")
    )
    return joined.select(*records.columns, why.alias("reject_reason"))


def balance(records: DataFrame, n_items: DataFrame, label: str) -> DataFrame:
    """One row: records, items covered as a share, classes, runs, and whether one class holds everything."""
    counts = records.groupBy(label).agg(F.count("*").alias("c"))
    top = counts.agg(F.sum("c").alias("n"), F.count(label).alias("n_classes"), F.max("c").alias("largest"))
    total = n_items.agg(F.count("*").alias("n_items"))
    covered = records.agg(F.count_distinct("item_id").alias("n_covered"), F.count_distinct("run_id").alias("n_runs"))
    return top.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(covered)).select("n", "n_classes", "n_runs", F.round(F.col("n_covered") / F.col("n_items"), 3).alias("coverage"), (F.col("largest") == F.col("n")).alias("degenerate"))


def candidates(items: DataFrame, labels: DataFrame, redo: DataFrame, where: Column, most: int | None = None) -> DataFrame:
    """Items to label: those of the filter without a label, and those to be redone whatever their label; the `most` first by id if it is given."""
    wanted = items.where(where)
    fresh = wanted.join(labels.select("item_id").distinct(), "item_id", "left_anti")
    found = fresh.unionByName(wanted.join(redo.select("item_id").distinct(), "item_id", "left_semi")).dropDuplicates(["item_id"])
    return found if most is None else found.orderBy("item_id").limit(most)


def annotation_order(rows: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """rows with round: each group's rows in an order by digest, dealt one a round, so that like rows lie far apart; order by round and deal.

    A row's round is its place among all rows ordered by group, less that of its group's first row: a handful of large groups is sorted in as many ranges as any other rows.
    """
    deal = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    placed = positions(rows.withColumn("deal", deal), [group, "deal", key])
    begins = placed.groupBy(F.col(group).alias("dealt_group")).agg(F.min("pos").alias("begins"))
    numbered = placed.join(begins, F.col(group).eqNullSafe(F.col("dealt_group"))).withColumn("round", F.col("pos") - F.col("begins") + 1)
    return numbered.drop("dealt_group", "begins", "pos").withColumn("group_deal", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string")).cast("binary")))


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """pos of each row, from 1, in a total order, without one task that holds all."""
    return running_counts(rows.withColumn("one", F.lit(1)), order, "one").withColumn("pos", F.col("last") + 1).drop("one", "first", "last")


def smallest_gap(placed: DataFrame, group: str) -> DataFrame:
    """Smallest distance between rows of a group: each row meets the one before it in the order of groups and places."""
    own = positions(placed.select(group, F.col("pos").alias("at")), [group, "at"])
    after = own.select(F.col(group).alias("other_group"), F.col("at").alias("other_at"), (F.col("pos") + 1).alias("pos"))
    gap = F.when(F.col(group).eqNullSafe(F.col("other_group")), F.col("at") - F.col("other_at"))
    return own.join(after, "pos", "left").groupBy(group).agg(F.min(gap).alias("min_gap"))


def labelling_pairs(items: DataFrame, responses: DataFrame) -> DataFrame:
    """item_id, run_id and response of every response to a known item; unanswered() lists the items without one."""
    return responses.join(items.select("item_id").distinct(), "item_id")


def unanswered(items: DataFrame, responses: DataFrame) -> DataFrame:
    """run_id and item_id of items that a run has no response to.

    Only items that fewer runs have answered than there are meet the list of runs.
    """
    said = responses.select("run_id", "item_id").distinct()
    runs = said.select("run_id").distinct()
    counted = items.select("item_id").distinct().join(said.groupBy("item_id").agg(F.count("*").alias("answered")), "item_id", "left")
    lacking = counted.crossJoin(F.broadcast(runs.agg(F.count("*").alias("n_runs")))).where("coalesce(answered, 0) < n_runs").select("item_id")  # one row
    return lacking.crossJoin(runs).join(said, ["run_id", "item_id"], "left_anti").select("run_id", "item_id")


SPACES = ["binary_behavioral", "rubric_1_5"]


def latest_of_each(records: DataFrame, order: str) -> DataFrame:
    """The last record of each run, item and annotator: a correction replaces its own annotator's label, never another's."""
    return latest(records, ["run_id", "item_id", "annotator"], order)


def contested(records: DataFrame) -> DataFrame:
    """item_id and n_annotators of items that more than one annotator has labelled: how far these agree is another statistic, with another denominator."""
    return records.groupBy("item_id").agg(F.count_distinct(F.coalesce(F.col("annotator"), F.lit(""))).alias("n_annotators")).where("n_annotators > 1")


def usable(records: DataFrame, order: str, space: str, annotator: str | None = None) -> DataFrame:
    """The latest records, of one annotator if one is named, which fail to be read if an item has labels of several annotators, or if any is in another space than
    `space`: two annotators' labels aren't averaged, the last one doesn't win, and labels of one space aren't converted to another."""
    if space not in SPACES:
        raise ValueError(f"label spaces are {SPACES}")
    own = latest_of_each(records if annotator is None else records.where(F.col("annotator") == annotator), order)
    several = contested(own).agg(F.count("*").alias("several"))
    other = own.agg(F.count_if(~F.col("label_space").eqNullSafe(F.lit(space))).alias("other"))
    ok = several.crossJoin(other).select(  # one row
        F.assert_true(F.col("several") == 0, F.concat(F.col("several").cast("string"), F.lit(" items are labelled by more than one annotator; name one"))).alias("a"),
        F.assert_true(F.col("other") == 0, F.concat(F.col("other").cast("string"), F.lit(f" labels aren't in the space {space}"))).alias("b"),
    )
    return own.crossJoin(F.broadcast(ok)).where("a is null and b is null").drop("a", "b")


def shared_ids(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that both sides have."""
    return left.select(*keys).intersect(right.select(*keys))


def replays(calls: DataFrame, request: list[Column], order: str) -> DataFrame:
    """calls with request_sha and whether an earlier call had the same request.

    The first of each request is found by a grouped minimum, so that a very common request is no burden to one task.
    """
    keyed = calls.withColumn("request_sha", F.sha2(F.to_json(F.struct(*request)), 256))
    first = keyed.groupBy("request_sha").agg(F.min(order).alias("first_seq"))
    return keyed.join(first, "request_sha").withColumn("is_replay", F.col(order) > F.col("first_seq")).drop("first_seq")

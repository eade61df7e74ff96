"""Structured Streaming: trace ingest, live rates, latest labels, completion."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.intervals import rate
from ..operators.labels import latest
from ..storage import new_folder


def ingest(stream: DataFrame, path: str, checkpoint: str, partition: str | None = None) -> StreamingQuery:
    """Append a stream of trace rows to Parquet, each row once; ends when what is there has been read."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    return (writer.partitionBy(partition) if partition else writer).start(path)


def windowed_rates(stream: DataFrame, time: str, keys: list[str], flag, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Rates of each window and group; rows later than the watermark are dropped and counted in the query's progress."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width), *keys).agg(*rate(flag))


def live_rates(stream: DataFrame, time: str, keys: list[str], flag, value: str, width: str = "1 day") -> DataFrame:
    """Counts, rate and mean of each window and group, for the complete output mode."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    out = timed.groupBy(F.window(time, width), *keys).agg(*rate(flag), F.round(F.avg(value), 9).alias("mean_value"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), *keys, "mean", "n", "stdev", "ci_low", "ci_high", "mean_value")


def keep_latest(stream: DataFrame, keys: list[str], order: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Fold each micro-batch into a table of the latest record of each key, a new snapshot a batch under folder/batch=N."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = latest(batch, keys, order)
        if number:
            own = latest(spark.read.parquet(f"{folder}/batch={number - 1}").unionByName(own), keys, order)
        own.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def completion(stream: DataFrame, keys: list[str], order: str, done_role: str) -> DataFrame:
    """For each item so far whether its last row is of the role that completes it, for the complete output mode."""
    return stream.groupBy(*keys).agg(F.count("*").alias("n_rows"), (F.max_by("role", order) == done_role).alias("completed"))


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings of the session while a stream is started, which keeps them; afterwards they are what they were."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: State that processors hold lies in files of this store, so it may be larger than memory.
KEYED_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Finish(StatefulProcessor):
    """Tells once that an item's last turn has its completing row. An item that isn't heard of for a time is forgotten."""

    def __init__(self, keys: list[str], idle_ms: int):
        self.keys, self.idle_ms = keys, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.known = handle, handle.getValueState("known", "n_rows long, told boolean, until long")

    def handleInputRows(self, key, rows, timerValues):
        n, told, until = self.known.get() if self.known.exists() else (0, False, None)
        ends, newest = False, timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            n, ends, newest = n + len(batch), ends or bool(batch["ends"].any()), max(newest, int(batch["ms"].max()))
        wanted = max(until or 0, newest + self.idle_ms)
        if wanted != until:
            if until is not None:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(wanted)
        self.known.update((int(n), bool(told or ends), wanted))
        if ends and not told:
            yield pd.DataFrame([[*key, n]], columns=[*self.keys, "n_rows"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.known.clear()
        return iter(())

    def close(self) -> None:
        pass


def completions(stream: DataFrame, items: DataFrame, keys: list[str], time: str, order: str, done_role: str, late: str = "1 day", idle_ms: int = 86_400_000) -> DataFrame:
    """keys and n_rows (seen so far) of each item, once, in append mode, when the row of done_role of its last turn arrives.

    items says by n_turns how many turns an item has; rows of other items are passed over, as are rows later than the watermark. State is a
    count and a flag an item, kept in files; it goes once the watermark is idle_ms past the item's newest row, whether it ended or not, and an item
    that comes back after that counts anew.
    """
    ends = F.coalesce((F.col(order) == F.col("n_turns") - 1) & (F.col("role") == done_role), F.lit(False))
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    known = timed.join(items.select(*keys, "n_turns"), keys).select(*keys, time, F.unix_millis(time).alias("ms"), ends.alias("ends"))
    kinds = dict(known.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n_rows long"
    return known.groupBy(*keys).transformWithStateInPandas(_Finish(keys, idle_ms), schema, "append", "EventTime")


def live_sketches(stream: DataFrame, time: str, keys: list[str], value: str, width: str = "1 day", size: int = 400) -> DataFrame:
    """window_start, keys, n and a mergeable quantile sketch of the values of each window and group; null values don't count. Every window may be pooled with others later."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).where(F.col(value).isNotNull())
    out = timed.groupBy(F.window(time, width), *keys).agg(F.count(value).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("sketch"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), *keys, "n", "sketch")


def pooled_quantiles(sketches: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """keys, n and, by name, quantiles of the merged sketches of each group: of rank within about 1.7 / size^0.9 of the share (0.8 % for 400)."""
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select(*keys, "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(share)).alias(name) for name, share in shares.items()])


def appended_result(spark: SparkSession, result: DataFrame) -> DataFrame:
    """Run a stream to the end of its input in append mode and return the rows that it gave."""
    folder = new_folder(spark, "stream-appended")
    with _settings(spark, KEYED_STATE):
        query = result.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/rows")


def as_stream(spark: SparkSession, rows: DataFrame, files: int) -> DataFrame:
    """A file stream over rows written in several files, one file a micro-batch."""
    path = new_folder(spark, "stream-input")
    rows.repartition(files).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def complete_result(spark: SparkSession, result: DataFrame) -> DataFrame:
    """Run a stream to the end of its input in complete mode and return the last result, kept as Parquet by each micro-batch."""
    folder = new_folder(spark, "stream-result")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/last")

    query = result.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/last")

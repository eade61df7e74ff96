"""Helpers shared by the corpus operators: shared folders, materialisation, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import new_folder, shared_dir  # noqa: F401

#: Bytes of a column batch sent to Python, so that very long texts don't fill a worker.
ARROW_BATCH_BYTES = "8m"

#: Sort key of a null doc_id: it counts as one document after all others.
NULL_ID = (1 << 63) - 1


def arrow_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH_BYTES)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends and lost executors cost nothing."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that stored() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores after it while df has a column of that name or one that begins with it."""
    taken = [c.lower() for c in df.columns]
    while any(c == name or c.startswith(name + "_") for c in taken):
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("*",)))


def over_texts(
    df: DataFrame, columns: list[str], schema: str | T.StructType, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
) -> DataFrame:
    """mapInArrow over some columns only, in batches bounded by bytes."""
    arrow_batches(df.sparkSession)
    return df.select(*columns).mapInArrow(rows, schema)


def fold(column: str, buckets: int):
    """crc32 of a column's text form, modulo buckets; null ids go to fold 0 of crc32('')."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(buckets))


def sampled(rows: DataFrame, column: str, most: int, salt: str) -> DataFrame:
    """About `most` of rows at most, chosen by a 64-bit hash of a column; all of them if they are no more. A sample without a row of a table that has some is an error."""
    n = rows.count()
    if n <= most:
        return rows
    chosen = rows.where(F.xxhash64(column, F.lit(salt)) < F.lit((most << 64) // n - (1 << 63)))
    if not chosen.limit(1).count():
        raise ValueError(f"the sample for {salt} is empty, though {n} rows are there to choose from")
    return chosen

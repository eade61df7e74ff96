"""The corpus pipeline: toxic and poor documents go, repeated lines and near copies go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last
return the columns of documents. Models learn from the stage's own documents and the labels table. A
document that loses all its lines stays, with an empty text, until the near-duplicate stage, which
keeps one of these.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evalgrove.llm import linededup, packing, quality, simhash, toxicity
from evalgrove.llm.common import dropped, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(docs, counts=False)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_poor), ("line dedup", drop_lines), ("simhash near-dedup", drop_copies), ("packing", pack)]

#: SQL can't express fitted models, fingerprints by a library or token ids; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name.replace(' ', '-')}")
        if before:
            dropped(before)
        docs = before = spark.read.parquet(f"{folder}/{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

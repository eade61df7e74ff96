"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, embeddings, langid, licenses, linededup, packing, prefixtrie, quality, simhash, tokencount, tokenstore, toxicity
from .common import NULL_ID, documents, fold, new_folder

TOKEN_LIMIT = 2048


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.line_dedup(documents(spark, sf_dir, "doc_id", "text"), min_chars=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(documents(spark, sf_dir, "doc_id", "text"), shingle=3)
    none = F.lit(NULL_ID)
    return found.select(F.nullif("id", none).alias("doc_id"), simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), F.nullif("component_id", none).alias("component_id"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    statistics = quality.document_statistics(documents(spark, sf_dir, "doc_id", "text"))
    rules = quality.learn(statistics, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judged(statistics, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.get("licenses", F.lit(0))
    return licenses.scan(documents(spark, sf_dir, "doc_id", "text")).select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"), best["name"].alias("license"), best["coverage"].alias("coverage"), best["begin"].alias("begin"), best["end"].alias("end"), "licenses"
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), TOKEN_LIMIT)


def op6_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.98)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = toxicity.learn(docs, labels.where(fold("doc_id", 5) != 0))
    return toxicity.tag(docs, chain).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans"
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    filters = langid.learn(docs.where(fold("doc_id", 4) != 2))
    return langid.identify(docs, filters).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir, "text", "lang", "source"), least_docs=10, most=10)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefixtrie.rebuilt(prefixtrie.numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return prefixtrie.trie(turns).drop("x", "y")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-store")
    tokenstore.write(documents(spark, sf_dir, "doc_id", "text"), folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return tokenstore.checksums(tokenstore.read(spark, folder))


def token_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix's token count, stored, and a budget question answered from it."""
    return tokencount.prefix_token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), budget=TOKEN_LIMIT)


def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations under limits on tokens, segments and the tokens of assistant turns."""
    return packing.pack_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def queries() -> dict:
    return {f.__name__: f for f in (token_prefixes, packed_conversations, op1_line_dedup, op2_simhash, op3_quality_rules, op4_license_scan, op5_token_counts, op6_embedding_links, op7_packing, op8_toxicity, op9_byte_bpe, op10_language, op11_source_divergence, op12_prefix_trie, op13_token_files)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": linededup.ORACLE_SQL, "op6_embedding_links": embeddings.ORACLE_SQL, "op11_source_divergence": divergence.ORACLE_SQL, "op12_prefix_trie": prefixtrie.ORACLE_SQL}

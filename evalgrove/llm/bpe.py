"""Byte-level BPE: encoding to ids with offsets, and decoding ids to the same bytes.

The rank file becomes a byte-pair model of the tokenizers library: each byte stands for one printable
character, and the pattern's matches are encoded separately. Decoding reverses the byte table, so
tokens that hold parts of one character give its bytes back when joined.

Rows: null texts are empty texts, with no token. Repeated rows are encoded each by itself; an empty
table gives an empty result. Other columns of the input are not read, whatever their names. Ids that
the vocabulary lacks make decoding fail.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts
from .tokenfiles import ChunkEncoder, byte_characters, rank_tokenizer


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ChunkEncoder:
    return ChunkEncoder(rank_tokenizer(path, pattern), pattern)


@lru_cache(maxsize=2)
def token_bytes(path: str, pattern: str) -> list[bytes]:
    """Bytes of each id, by the reversed byte table of the vocabulary."""
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    vocab = rank_tokenizer(path, pattern).get_vocab()
    table = [b""] * (max(vocab.values()) + 1)
    for name, i in vocab.items():
        table[i] = bytes(map(byte_of.__getitem__, name))
    return table


def _docs(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids, and byte_ends: the end of each token in the text's UTF-8 bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, size = encoder(path, pattern), np.array(list(map(len, token_bytes(path, pattern))), dtype=np.int64)
        for batch in batches:
            ids = [np.frombuffer(code.encode(t or ""), dtype="<u4") for t in batch.column(1).to_pylist()]
            ends = [np.cumsum(size[x]) for x in ids]
            yield pa.record_batch(
                [batch.column(0), pa.array(ids, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))],
                names=["doc_id", "ids", "byte_ends"],
            )

    return over_texts(_docs(docs, id_column, text_column), ["doc_id", "text"], "doc_id long, ids array<long>, byte_ends array<long>", rows)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of ids; null ids give no bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path, pattern)
        for batch in batches:
            out = [b"".join(map(table.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return over_texts(encoded, ["doc_id", "ids"], "doc_id long, decoded binary", rows)


def round_trip(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Digests of encoding and decoding in one pass: doc_id, n_tokens, n_bytes, ids_sha256, decoded_sha256, exact."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, table = encoder(path, pattern), token_bytes(path, pattern)
        for batch in batches:
            n_tokens, n_bytes, ids_hash, text_hash, exact = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode()
                ids = code.encode(text or "")
                decoded = b"".join(map(table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
                n_tokens.append(len(ids) // 4)
                n_bytes.append(len(raw))
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(decoded).hexdigest())
                exact.append(decoded == raw)
            yield pa.record_batch(
                [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string()), pa.array(exact, pa.bool_())],
                names=["doc_id", "n_tokens", "n_bytes", "ids_sha256", "decoded_sha256", "exact"],
            )

    return over_texts(
        _docs(docs, id_column, text_column), ["doc_id", "text"],
        "doc_id long, n_tokens long, n_bytes long, ids_sha256 string, decoded_sha256 string, exact boolean", rows,
    )

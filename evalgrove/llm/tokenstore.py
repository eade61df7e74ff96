"""Token ids on disk in fixed-width bit packing.

A store is a folder of Parquet tables. `blocks` has a row for each block of whole documents: its shard and
number, the ids before it in its shard, the id and the first place of each of its documents, and the ids
themselves, each in the least number of bits that the vocabulary needs, little-endian and without gaps.
The i-th id of a block begins at bit i times the width, so any stretch is unpacked by itself. `shards` has
the number of ids before each shard. Shards are ranges of doc_id in ascending order, blocks and documents
ascend within them, so the whole is one sequence of ids with a known place for each document.

A block is closed once it holds BLOCK_IDS ids, so a task holds one block and one text. Texts are shuffled once,
into their ranges; nothing is shuffled to read.

Rows: a null text is an empty text (its end id alone); a null doc_id comes after all others; rows of one doc_id
are ordered by a hash of their texts, equal rows are stored each by itself; an empty table gives an empty store;
other columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, over_texts
from .packing import encoder
from .tokenfiles import library_tokenizer

#: A block is closed when it holds so many ids.
BLOCK_IDS = 1 << 16
_CHUNK = 1 << 16
_BLOCKS = "shard long, block long, before long, n_ids long, width int, doc_ids array<long>, offsets array<long>, packed binary"
_DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"


def bits_needed(size: int) -> int:
    """Bits of the largest of `size` ids."""
    return max(1, (size - 1).bit_length())


def packed(ids: np.ndarray, width: int) -> bytes:
    """ids in `width` bits each, the lowest bit first."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    out = []
    for i in range(0, len(ids), _CHUNK):  # chunks of a multiple of eight ids end at whole bytes
        bits = np.unpackbits(np.ascontiguousarray(ids[i : i + _CHUNK], dtype="<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
        out.append(np.packbits(bits.ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpacked(data: bytes, width: int, begin: int, length: int) -> np.ndarray:
    """`length` ids from the begin-th on, as unsigned 32-bit integers; no other part of data is read."""
    first = begin * width
    own = np.frombuffer(data, np.uint8)[first >> 3 : (first + length * width + 7) >> 3]
    own = np.concatenate([own, np.zeros(8, np.uint8)])
    out = np.empty(length, np.uint32)
    for i in range(0, length, _CHUNK):
        bit = (first & 7) + np.arange(i, min(length, i + _CHUNK), dtype=np.int64) * width
        at, value = bit >> 3, np.zeros(len(bit), np.uint64)
        for k in range((width + 14) // 8):
            value |= own[at + k].astype(np.uint64) << np.uint64(8 * k)
        out[i : i + _CHUNK] = (value >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)
    return out


def _block(serial: int, before: int, width: int, docs: list, offsets: list[int], ids: list[bytes]) -> pa.RecordBatch:
    own = np.frombuffer(b"".join(ids), "<u4")
    values = (TaskContext.get().partitionId(), serial, before, len(own), width, docs, offsets, packed(own, width))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
    return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in _BLOCKS.split(", ")])


def write(docs: DataFrame, folder: str, path: str, pattern: str, end_id: int = 0, block_ids: int = BLOCK_IDS, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode documents, each ended by end_id, and write their ids to a new store in folder."""
    width = max(bits_needed(library_tokenizer(path).get_vocab_size()), bits_needed(end_id + 1))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(path, pattern), end_id.to_bytes(4, "little")
        serial = before = held = 0
        own: list = []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = code.encode(text.as_py() or "") + end
                own.append((doc, held, ids))
                held += len(ids) // 4
                if held >= block_ids:
                    yield _block(serial, before, width, *map(list, zip(*own, strict=True)))
                    serial, before, held, own = serial + 1, before + held, 0, []
        if own:
            yield _block(serial, before, width, *map(list, zip(*own, strict=True)))

    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    blocks = over_texts(named.repartitionByRange(*order).sortWithinPartitions(*order), ["doc_id", "text"], _BLOCKS, rows)
    blocks.write.parquet(f"{folder}/blocks")
    sizes = read_blocks(docs.sparkSession, folder).groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    sizes.select("shard", "n_ids", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("first")).write.parquet(f"{folder}/shards")


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks with first, the ids before them in the whole store. Shards are as many as tasks have written: 16 bytes each are broadcast."""
    shards = spark.read.schema("shard long, first long").parquet(f"{folder}/shards")
    arrow_batches(spark)
    return read_blocks(spark, folder).join(F.broadcast(shards), "shard").withColumn("first", F.col("first") + F.col("before"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (the ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit integers) of each stored document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, width, docs, offsets, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = unpacked(data, width, 0, n).tobytes()
                ends = [*offsets[1:], n]
                columns = (docs, [first + o for o in offsets], [e - o for o, e in zip(offsets, ends, strict=True)])
                yield pa.record_batch([*(pa.array(c, pa.int64()) for c in columns), pa.array([ids[4 * o : 4 * e] for o, e in zip(offsets, ends, strict=True)], pa.binary())], names=[x.split()[0] for x in _DOCUMENTS.split(", ")])

    return _placed(spark, folder).select("first", "n_ids", "width", "doc_ids", "offsets", "packed").mapInArrow(rows, _DOCUMENTS)


def read_stretches(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """doc_id, begin, length and ids (array) for each wanted (doc_id, begin, length): only these stretches are unpacked.

    A stretch ends with its document; documents that aren't stored give no row.
    """
    at, size = F.col("place"), F.size("doc_ids")
    blocks = _placed(spark, folder).select("width", "n_ids", "packed", "doc_ids", "offsets", F.posexplode("doc_ids").alias("place", "doc_id"))
    ends = F.when(at + 1 < size, F.get("offsets", at + 1)).otherwise(F.col("n_ids"))
    found = blocks.select("doc_id", "width", "packed", F.get("offsets", at).alias("offset"), ends.alias("end")).join(wanted.select("doc_id", F.col("begin").cast("long"), F.col("length").cast("long")), "doc_id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [c.to_pylist() for c in batch.columns]
            ids = [unpacked(d, w, o + b, max(0, min(n, e - o - b))) for _, w, d, o, e, b, n in zip(*own, strict=True)]
            yield pa.record_batch([pa.array(own[0], pa.int64()), pa.array(own[5], pa.int64()), pa.array(own[6], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "begin", "length", "ids"])

    return found.select("doc_id", "width", "packed", "offset", "end", "begin", "length").mapInArrow(rows, "doc_id long, begin long, length long, ids array<long>")


def checksums(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (unsigned) of documents that read() gave."""
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))



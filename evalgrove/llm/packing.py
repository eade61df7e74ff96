"""Vector bin packing of training examples into sequences.

Each example demands tokens, a segment and loss-bearing tokens; a sequence has a limit on each. The
dot-product heuristic gives an open sequence the example, among those that fit, whose demand has the
largest dot product with what the sequence has left, both as shares of the limits. Examples of equal
demand are interchangeable, so the search runs over distinct demands. Examples longer than a sequence
are cut at its limit and only what is left over is packed; when nothing fits an open sequence, the
largest remaining example is cut to fill it. At the end of a task the last sequence is cut into powers
of two, which need no padding.

A task packs the texts of its own partition in blocks of BLOCK examples, so nothing is shuffled and
memory is bounded. Rows: null texts are empty texts (one token, the end mark); repeated rows are packed
each by itself; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts
from .tokenfiles import ChunkEncoder, library_tokenizer

#: Examples packed together by a task.
BLOCK = 4096
#: Pieces shorter than this are not cut off while a sequence still has room for other examples.
LEAST_CUT = 16
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ChunkEncoder:
    library = library_tokenizer(path)
    return ChunkEncoder(library, pattern, tuple(t.content for t in library.get_added_tokens_decoder().values()))


class Example:
    """A run of token ids of one document; loss marks the loss-bearing ones, all of them if it is None."""

    __slots__ = ("doc", "start", "ids", "total", "loss")

    def __init__(self, doc, start, ids, total, loss=None):
        self.doc, self.start, self.ids, self.total, self.loss = doc, start, ids, total, loss

    def demand(self) -> tuple[int, int]:
        n = len(self.ids) // 4
        return n, n if self.loss is None else int(self.loss.sum())

    def cut(self, n: int) -> tuple["Example", "Example"]:
        head, tail = (None, None) if self.loss is None else (self.loss[:n], self.loss[n:])
        return Example(self.doc, self.start, self.ids[: 4 * n], self.total, head), Example(self.doc, self.start + n, self.ids[4 * n :], self.total, tail)


class Packer:
    """Sequences of one task. take() gives an example; sequences come out as lists of examples."""

    def __init__(self, tokens: int, segments: int, loss: int):
        self.limits = np.array([tokens, segments, loss], dtype=np.float64)
        self.tokens, self.segments, self.loss = tokens, segments, loss
        self.waiting: dict[tuple[int, int], list[Example]] = defaultdict(list)
        self.count = 0

    def take(self, example: Example) -> Iterator[list[Example]]:
        while True:
            n, loss = example.demand()
            if n < self.tokens and loss <= self.loss:
                break
            room = self.tokens
            if loss > self.loss:  # as many tokens as the limit on loss allows
                marked = np.flatnonzero(example.loss) if example.loss is not None else np.arange(n)
                room = min(room, int(marked[self.loss]))
            head, example = example.cut(min(room, n))
            yield [head]
            if not example.ids:
                return
        self.waiting[example.demand()].append(example)
        self.count += 1
        if self.count >= BLOCK:
            yield from self.pack(last=False)

    def pack(self, last: bool) -> Iterator[list[Example]]:
        """Fill sequences from the waiting examples; unless last, what can't fill one keeps waiting."""
        if not self.count:
            return
        keys = list(self.waiting)
        place = {k: i for i, k in enumerate(keys)}
        # room for a new kind from each cut; kinds without an example are never chosen
        kinds, held = np.zeros((2 * len(keys) + 64, 3)), np.zeros(2 * len(keys) + 64, dtype=np.int64)
        kinds[: len(keys)] = [(n, 1, loss) for n, loss in keys]
        held[: len(keys)] = [len(self.waiting[k]) for k in keys]
        share, waits = kinds / self.limits, int(kinds[: len(keys), 0] @ held[: len(keys)])
        while self.count:
            if not last and waits < 4 * self.tokens:
                return
            left, bin_ = self.limits.copy(), []
            while left[0] > 0 and left[1] > 0:
                fits = (held > 0) & (kinds <= left).all(axis=1)
                k = int(np.argmax(np.where(fits, share @ (left / self.limits), -1.0)))
                if not fits[k]:
                    break
                bin_.append(self._pop(keys[k]))
                held[k] -= 1
                left -= kinds[k]
            room = int(min(left[0], left[2]))
            if room > 0 and left[1] > 0 and self.count and (room >= LEAST_CUT or last):
                k = int(np.argmax(np.where(held > 0, kinds[:, 0], -1)))
                head, tail = self._pop(keys[k]).cut(min(room, keys[k][0] - 1))
                held[k] -= 1
                bin_.append(head)
                key = tail.demand()
                self.waiting[key].append(tail)
                self.count += 1
                left[0] -= len(head.ids) // 4
                if key not in place:
                    place[key] = len(keys)
                    keys.append(key)
                    if len(keys) > len(held):
                        kinds, held = np.concatenate([kinds, np.zeros_like(kinds)]), np.concatenate([held, np.zeros_like(held)])
                    kinds[len(keys) - 1] = (key[0], 1, key[1])
                    share = kinds / self.limits
                held[place[key]] += 1
            waits -= sum(len(x.ids) // 4 for x in bin_)
            if last and not self.count and left[0] > 0:
                yield from self._powers(bin_)
            else:
                yield bin_

    def _pop(self, key) -> Example:
        stack = self.waiting[key]
        out = stack.pop()
        if not stack:
            del self.waiting[key]
        self.count -= 1
        return out

    def _powers(self, bin_: list[Example]) -> Iterator[list[Example]]:
        total = sum(len(x.ids) // 4 for x in bin_)
        queue = list(reversed(bin_))
        while total:
            size = 1 << (total.bit_length() - 1)
            total, part = total - size, []
            while size:
                x = queue.pop()
                n = len(x.ids) // 4
                if n > size:
                    x, rest = x.cut(size)
                    queue.append(rest)
                    n = size
                part.append(x)
                size -= n
            yield part


def packed(examples: Iterator[Iterator[Example]], tokens: int, segments: int, loss: int) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA for the batches of examples of one task; sequence ids hold the task's partition."""
    packer, serial = Packer(tokens, segments, loss), TaskContext.get().partitionId() << 40

    def batch(sequences: Iterator[list[Example]]) -> pa.RecordBatch:
        nonlocal serial
        out: list[list] = [[] for _ in range(7)]
        for sequence in sequences:
            offset = 0
            for x in sequence:
                n = len(x.ids) // 4
                for column, value in zip(out, (x.doc, x.start, n, zlib.crc32(x.ids), x.total, serial, offset), strict=True):
                    column.append(value)
                offset += n
            serial += 1
        return pa.record_batch([pa.array(x, pa.int64()) for x in out], names=[x.split()[0] for x in SCHEMA.split(", ")])

    for group in examples:
        yield batch(s for x in group for s in packer.take(x))
    yield batch(packer.pack(last=True))


def pack_documents(
    docs: DataFrame, path: str, pattern: str, tokens: int = 1024, segments: int = 64, loss: int = 1024, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Documents, each ended by end_id, as pieces of sequences; every token bears loss."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(path, pattern), end_id.to_bytes(4, "little")

        def examples(batch: pa.RecordBatch) -> Iterator[Example]:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = code.encode(text or "") + end
                yield Example(doc, 0, ids, len(ids) // 4)

        return packed(map(examples, batches), tokens, segments, loss)

    return over_texts(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")), ["doc_id", "text"], SCHEMA, rows)


def pack_conversations(
    turns: DataFrame, path: str, pattern: str, tokens: int = 1024, segments: int = 16, loss: int = 768, end_id: int = 0, loss_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as pieces; tokens of loss_roles bear loss. doc_id is conv_id.

    A conversation's turns meet in one row; its turns are ordered by turn, role and text.
    """
    whole = turns.groupBy(F.col("conv_id").cast("long").alias("doc_id")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(path, pattern), end_id.to_bytes(4, "little")

        def examples(batch: pa.RecordBatch) -> Iterator[Example]:
            for doc, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = [(code.encode(t["text"] or "") + end, t["role"] in loss_roles) for t in said]
                ids = b"".join(p for p, _ in parts)
                marked = np.concatenate([np.full(len(p) // 4, bears) for p, bears in parts])
                yield Example(doc, 0, ids, len(ids) // 4, marked)

        return packed(map(examples, batches), tokens, segments, loss)

    return over_texts(whole, ["doc_id", "turns"], SCHEMA, rows)

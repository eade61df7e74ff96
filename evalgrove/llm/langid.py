"""Language identification by bit-sliced Bloom filters over character n-grams.

One table of slots serves all languages: bit l of a slot belongs to language l (of several words of bits, for
more than 64 languages), so reading an n-gram's slots and taking their conjunction gives the set of languages whose
training texts hold the n-gram. A text's n-grams are counted for each language by popcount of those masks, and the counts are corrected
for each filter's rate of false positives.

Training counts n-grams over at most sample_per_lang texts of a language (a bounded sample, chosen by a
hash of the id; the bound is a parameter), never over texts of the held-out fold. An n-gram belongs to a
language if at least least_share of its texts hold it and that share is at least lead of the largest; n-grams
below that share are left out language by language before anything goes to the driver, so that what goes there
follows the length of texts (their distinct n-grams, over least_share) and not their number.

Rows: a null text, or one without a letter, is `und` with score 0. Null languages teach nothing. A text
without a known n-gram gets the most frequent language, with score 0. Without any training text every
text is `und`. Equal counts go to the language first in order. Repeated rows are decided each by itself;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts

N = 4
#: Languages in a word of bits.
WORD = 64


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case code point of each letter, 0 for anything else."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x40000):  # there are no letters beyond
        c = chr(i)
        if c.isalpha():
            table[i] = ord(c.lower()[0])
    return table


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of letters of all texts, the text of each, and whether each text has a letter.

    Runs of other characters count as one boundary, which an n-gram may have only at its ends.
    """
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = _letters()[points]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    has_letter = np.bincount(owner[letters > 0], minlength=len(texts)) > 0
    keep = letters > 0
    keep[1:] |= letters[:-1] > 0  # the first of each run of others
    letters, owner = letters[keep], owner[keep]
    if len(letters) < N:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), has_letter
    end = len(letters) - N + 1
    fit = (owner[:end] == owner[N - 1 :]) & (letters[1 : end + 1] > 0) & (letters[2 : end + 2] > 0)
    at = np.flatnonzero(fit)
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(N):
        h = (h ^ letters[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h, owner[at], has_letter


@dataclass
class Filters:
    """The sliced filters: slots of language bits, and each language's rate of false positives."""

    languages: list[str]
    slots: np.ndarray
    hashes: int
    false_rate: np.ndarray
    usual: str

    @classmethod
    def of(cls, languages: list[str], grams: np.ndarray, masks: np.ndarray, usual: str, hashes: int, bits_per_gram: int) -> "Filters":
        """From n-grams and their masks, a row of masks for each word of bits."""
        size = 1 << max(10, int(np.ceil(np.log2(max(1, len(grams)) * bits_per_gram))))
        slots = np.zeros((len(masks), size), dtype=np.uint64 if len(languages) > 16 else np.uint16)
        for at in cls._places(grams, hashes, size):
            for own, mask in zip(slots, masks, strict=True):
                np.bitwise_or.at(own, at, mask.astype(slots.dtype))
        fill = np.array([np.mean((slots[l // WORD] >> slots.dtype.type(l % WORD)) & slots.dtype.type(1)) for l in range(len(languages))])
        return cls(languages, slots, hashes, fill**hashes, usual)

    @staticmethod
    def _places(grams: np.ndarray, hashes: int, size: int) -> Iterator[np.ndarray]:
        step = (grams >> np.uint64(32)) | np.uint64(1)
        for k in range(hashes):
            yield ((grams + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram the languages that hold it, as bits, a row for each word of bits."""
        out = np.full((len(self.slots), len(grams)), ~self.slots.dtype.type(0), dtype=self.slots.dtype)
        for at in self._places(grams, self.hashes, self.slots.shape[1]):
            out &= self.slots[:, at]
        return out

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        grams, owner, has_letter = ngrams([t or "" for t in texts])
        masks, total = self.masks(grams), np.bincount(owner, minlength=len(texts))
        one = self.slots.dtype.type(1)
        found = np.stack([np.bincount(owner[((masks[l // WORD] >> self.slots.dtype.type(l % WORD)) & one) > 0], minlength=len(texts)) for l in range(len(self.languages))])
        true = np.maximum(0, (found - total * self.false_rate[:, None]) / np.maximum(1e-9, 1 - self.false_rate[:, None]))
        best, sums = true.argmax(axis=0), true.sum(axis=0)
        score = np.where(sums > 0, true.max(axis=0) / np.maximum(sums, 1e-12), 0.0)
        names = [
            ("und" if not letter else self.languages[b] if s > 0 else self.usual)
            for letter, b, s in zip(has_letter, best, sums, strict=True)
        ]
        return names, np.where(has_letter, score, 0.0)


def learn(
    docs: DataFrame, sample_per_lang: int = 4000, least_share: float = 0.01, lead: float = 0.3, hashes: int = 3, bits_per_gram: int = 16
) -> Filters | None:
    """Filters from the texts and languages of docs (doc_id, text, lang); None without any."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    n_of = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not n_of:
        return None
    languages = sorted(n_of)
    spark = docs.sparkSession
    numbers = spark.createDataFrame([(x, i, min(1.0, sample_per_lang / n_of[x])) for i, x in enumerate(languages)], "lang string, number int, share double")
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    sample = known.join(F.broadcast(numbers), "lang").where(chosen).select(F.col("number").cast("long").alias("lang"), "text")  # one row a language is broadcast
    texts = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_numpy()
            grams, owner, _ = ngrams(batch.column(1).to_pylist())
            grams, owner = _distinct(grams, owner)  # once a text
            lang = langs[owner]
            grams, lang, n = _counted(grams, lang)
            yield pa.record_batch([pa.array(lang, pa.int64()), pa.array(grams.view(np.int64), pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counts = over_texts(sample, ["lang", "text"], "lang long, gram long, n long", counted).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    least = spark.createDataFrame([(l, float(n)) for l, n in texts.items()], "lang long, texts double")
    rows = counts.join(F.broadcast(least), "lang").select("lang", "gram", (F.col("n") / F.col("texts")).alias("share")).where(F.col("share") >= least_share).toPandas()
    rows = rows[rows.share >= lead * rows.groupby("gram").share.transform("max")]
    lang = rows.lang.to_numpy(np.int64)
    grams, place = np.unique(rows.gram.to_numpy(np.int64).view(np.uint64), return_inverse=True)
    masks = np.zeros((-(-len(languages) // WORD), len(grams)), dtype=np.uint64)
    np.bitwise_or.at(masks, (lang // WORD, place), np.left_shift(np.uint64(1), (lang % WORD).astype(np.uint64)))
    usual = max(languages, key=lambda x: (n_of[x], x))
    return Filters.of(languages, grams, masks, usual, hashes, bits_per_gram)


def _counted(grams: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of n-gram and owner, and how often each occurs."""
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])])) if len(grams) else np.zeros(0, np.int64)
    return grams[first], owner[first], np.diff(np.append(first, len(grams)))


def _distinct(grams: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _counted(grams, owner)[:2]


def identify(docs: DataFrame, filters: Filters | None) -> DataFrame:
    """doc_id, lang_pred and score of each row of docs (doc_id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names, scores = filters.decide(texts) if filters else (["und"] * len(texts), [0.0] * len(texts))
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return over_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], "doc_id long, lang_pred string, score double", rows)

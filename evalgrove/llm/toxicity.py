"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Token labels come from labelled documents: words and word beginnings that tell toxic from other
documents are chosen one after another; a toxic document counts half as much for each one that it
already has, so that rare words of a copied document don't all count. A token of a toxic document that
has a chosen feature is labelled toxic, every other token is not. A chain of two states is then fitted
to such labelled stretches; forward and backward passes over whole texts give each token's probability,
and the largest and the sum of these, through a logistic curve fitted on document labels, the score.

Learning uses at most sample_docs labelled documents (a bounded sample, chosen by a hash of the id). From these,
at most `candidates` beginnings and words are weighed and `features` of them chosen, and the chain is fitted to at most
`stretches` stretches of `reach` tokens to each side of a text's middle found token. All of these bounds are parameters of
learn() and bound the fit alone: scoring reads every token of every text. Rows: null and empty texts have no token and get the score of a text in which
nothing was found. Several labels of a document: the highest counts. Null labels teach nothing; without
labels of both kinds every score is the share of toxic labels, 0 if there are none. Repeated rows are
scored each by itself; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts, sampled, stored

SPACE = "\x20\t-\r"
_EDGES = ".,;:!?\"'()[]{}<>«»„“”‘’…*#$%&|-"
_WORD = re.compile(f"[^{SPACE}]+")
PREFIXES = range(3, 9)
#: Tokens remembered in a worker, and bytes of text that it works on at once: a worker's memory stays under some 100 MB, as several share an executor.
CACHE_ENTRIES, AT_ONCE = 150_000, 1 << 20


def slices(batches: Iterator[pa.RecordBatch], text_at: int = 0) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose texts hold AT_ONCE bytes at most, or one text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
            yield batch.slice(at, end - at)
            at = end


def normal(token: str) -> str:
    return token.strip(_EDGES).lower()


class _Features(dict):
    """Raw token to the number of its best feature; 0: none. Forgets when full."""

    def __init__(self, names: dict[str, int]):
        super().__init__()
        self.names = names

    def __missing__(self, token: str) -> int:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        word = normal(token)
        found = [n for k in PREFIXES if len(word) > k and (n := self.names.get("^" + word[:k]))]
        if n := self.names.get("=" + word):
            found.append(n)
        best = min(found, default=0)
        if len(token) <= 24:
            self[token] = best
        return best


@dataclass
class Chain:
    """Log-weights of the two states: emission of each feature for state 1, transitions and start."""

    names: dict[str, int]
    emit: np.ndarray
    move: np.ndarray
    start: float
    curve: np.ndarray = field(default_factory=lambda: np.zeros(4))
    base: float = 0.0
    _cache: _Features | None = None

    def __getstate__(self):
        return self.__dict__ | {"_cache": None}

    def features(self, text: str) -> np.ndarray:
        if self._cache is None:
            self._cache = _Features(self.names)
        words = _WORD.findall(text) if re.search("[\x1c-\x1f\x85\xa0  -     　]", text) else text.split()
        return np.fromiter(map(self._cache.__getitem__, words), dtype=np.int32, count=len(words))

    def marginals(self, features: list[np.ndarray]) -> list[np.ndarray]:
        """P(state 1) of each token, by log-odds recursions over all texts side by side."""
        order = np.argsort([-len(f) for f in features], kind="stable")
        lengths = np.array([len(features[i]) for i in order], dtype=np.int64)
        if not len(lengths) or not lengths[0]:
            return [np.zeros(0) for _ in features]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        flat = self.emit[np.concatenate([features[i] for i in order])]
        live = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")  # texts longer than t
        (a, b), (c, d) = np.exp(self.move - self.move.max())
        forward, backward = np.empty(len(flat)), np.zeros(len(flat))
        odds = flat[starts[: live[0]]] + self.start
        forward[starts[: live[0]]] = odds
        for t in range(1, lengths[0]):
            at = starts[: live[t]] + t
            r = np.exp(np.minimum(odds[: live[t]], 50.0))
            odds = flat[at] + np.log((b + d * r) / (a + c * r))
            forward[at] = odds
        after = np.zeros(0)
        for t in range(lengths[0] - 2, -1, -1):
            n = live[t + 1]
            at = starts[:n] + t
            beta = np.zeros(n)
            beta[: len(after)] = after
            r = np.exp(np.minimum(beta + flat[at + 1], 50.0))
            after = np.log((c + d * r) / (a + b * r))
            backward[at] = after
        p = 1 / (1 + np.exp(-np.clip(forward + backward, -50, 50)))
        out: list[np.ndarray] = [np.zeros(0)] * len(features)
        for k, i in enumerate(order):
            out[i] = p[starts[k] : starts[k] + lengths[k]]
        return out

    def evidence(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """For each text a constant, the log-odds of its largest marginal, log of 1 + the sum, and log of 1 + its tokens."""
        p = self.marginals([self.features(t) for t in texts])
        top = np.array([x.max() if len(x) else 1e-4 for x in p])
        rows = [np.ones(len(p)), np.log(np.clip(top, 1e-4, 1 - 1e-4) / (1 - np.clip(top, 1e-4, 1 - 1e-4))), np.log1p([x.sum() for x in p]), np.log1p([len(x) for x in p]) * 0.1]
        return np.stack(rows, axis=1), p

    def scores(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        x, p = self.evidence(texts)
        if not len(self.names):
            return np.full(len(texts), self.base), p
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -50, 50))), p


def _gain(a, b, n1, n0):
    """Log-likelihood ratio of a feature in a toxic and b other texts of n1 and n0."""
    def part(x, n):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / np.maximum(n, 1e-12)), 0.0)

    tot, n = a + b, n1 + n0
    return 2 * (part(a, n1 * tot / n) + part(b, n0 * tot / n))


def training_sample(docs: DataFrame, labels: DataFrame, sample_docs: int) -> DataFrame:
    """At most about sample_docs distinct labelled texts (text, toxic), stored."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    marks = sampled(marks, "doc_id", sample_docs, "toxicity sample")
    # at most about sample_docs rows of two numbers are broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(marks), "doc_id")
    once = texts.groupBy(F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), F.col("text")).alias("g")).agg(F.first("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))
    return stored(once.select("text", "toxic"), "toxicity-sample")


def _word_counts(sample: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic == 1].update({w for t in set(_WORD.findall(text)) if (w := normal(t))})
            words = list(counts[0] | counts[1])
            yield pa.record_batch([pa.array(words, pa.string()), pa.array([counts[1][w] for w in words], pa.int64()), pa.array([counts[0][w] for w in words], pa.int64())], names=["word", "a", "b"])

    return over_texts(sample, ["text", "toxic"], "word string, a long, b long", rows).groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _candidates(sample: DataFrame, n1: int, n0: int, least: int, purity: float, most: int) -> list[str]:
    """Features in at least `least` toxic texts and hardly any other, best first."""
    beginnings = F.transform(F.sequence(F.lit(PREFIXES[0]), F.lit(PREFIXES[-1])), lambda k: F.when(F.length("word") > k, F.concat(F.lit("^"), F.left(F.col("word"), k))))
    found = (
        _word_counts(sample)
        .select(F.explode(F.array_compact(F.array_append(beginnings, F.concat(F.lit("="), F.col("word"))))).alias("feature"), "a", "b")
        .groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .where((F.col("a") >= least) & (F.col("a") >= purity * (F.col("a") + F.col("b"))))
        .orderBy(F.desc("a"), F.length("feature"), "feature").limit(most).collect()
    )
    a, b = np.array([r["a"] for r in found], dtype=float), np.array([r["b"] for r in found], dtype=float)
    gain = _gain(a, b, n1, n0) if found else a
    return [found[i]["feature"] for i in np.argsort(-gain, kind="stable")]


def _held(sample: DataFrame, features: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each sampled text the numbers of the features it has, and its label."""
    number = {f: i for i, f in enumerate(features)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = []
            for text in batch.column(0).to_pylist():
                own = set()
                for w in {normal(t) for t in set(_WORD.findall(text))}:
                    own.update(n for k in PREFIXES if len(w) > k and (n := number.get("^" + w[:k])) is not None)
                    if (n := number.get("=" + w)) is not None:
                        own.add(n)
                ids.append(sorted(own))
            yield pa.record_batch([pa.array(ids, pa.list_(pa.int32())), batch.column(1)], names=["ids", "toxic"])

    got = over_texts(sample, ["text", "toxic"], "ids array<int>, toxic int", rows).toArrow().to_pydict()
    return [np.array(x, dtype=np.int64) for x in got["ids"]], np.array(got["toxic"], dtype=np.int64)


def _chosen(features: list[str], held: list[np.ndarray], toxic: np.ndarray, least: int, most: int) -> list[str]:
    """Features, each the best for what the ones before it leave unexplained: a toxic text counts half as much for each chosen feature that it has."""
    owner = np.concatenate([np.full(len(x), i) for i, x in enumerate(held)]) if held else np.zeros(0, np.int64)
    which = np.concatenate(held) if held else owner
    weight, out = (toxic == 1).astype(float), []
    n1, n0 = max(1, int((toxic == 1).sum())), max(1, int((toxic == 0).sum()))
    b = np.bincount(which[toxic[owner] == 0], minlength=len(features)).astype(float)
    while len(out) < most:
        a = np.bincount(which, weights=weight[owner], minlength=len(features))
        gain = np.where((a >= least) & (a > 2 * b), _gain(a, b, n1, n0), -1.0)
        k = int(gain.argmax()) if len(gain) else 0
        if not len(gain) or gain[k] < 10:
            return out
        out.append(features[k])
        weight[np.unique(owner[which == k])] *= 0.5
        open_ = which != k  # chosen once
        owner, which = owner[open_], which[open_]
    return out


def _stretches(sample: DataFrame, chain: Chain, most: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and labels of stretches of tokens, one a text, padded by -1."""
    width = 2 * reach + 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list[int]] = []
            marks: list[int] = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = chain.features(text)
                hits = np.flatnonzero(f)
                at = int(hits[len(hits) // 2]) if len(hits) else len(f) // 2
                own = f[max(0, at - reach) : at + reach + 1].tolist()
                out.append(own + [-1] * (width - len(own)))
                marks.append(toxic)
            yield pa.record_batch([pa.array(out, pa.list_(pa.int32())), pa.array(marks, pa.int32())], names=["f", "toxic"])

    got = over_texts(sample, ["text", "toxic"], "f array<int>, toxic int", rows).orderBy(F.xxhash64("f"), "f", "toxic").limit(most).toArrow().to_pydict()
    f = np.array(got["f"], dtype=np.int64).reshape(-1, width)
    return f, (f > 0) & (np.array(got["toxic"]) == 1)[:, None]


def fit_chain(chain: Chain, f: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.5, decay: float = 1e-3) -> None:
    """Gradient ascent on the likelihood of labelled stretches, by forward and backward passes."""
    if not len(f):
        return
    there, fx = f >= 0, np.maximum(f, 0)
    both = there[:, 1:]
    lab = y.astype(np.int64)
    real_moves = np.zeros((2, 2))
    np.add.at(real_moves, (lab[:, :-1][both], lab[:, 1:][both]), 1)
    real_emit = np.bincount(fx[there], weights=lab[there], minlength=len(chain.emit))
    seen = np.bincount(fx[there], minlength=len(chain.emit))
    n, width = f.shape
    for _ in range(rounds):
        e = np.where(there, chain.emit[fx], 0.0)
        m = np.exp(chain.move)
        alpha, beta = np.zeros((width, n, 2)), np.ones((width, n, 2))
        x = np.stack([np.ones(n), np.exp(e[:, 0] + chain.start)], axis=1)
        alpha[0] = x / x.sum(axis=1, keepdims=True)
        for t in range(1, width):
            x = alpha[t - 1] @ m
            x[:, 1] *= np.exp(e[:, t])
            x = np.where(there[:, t, None], x, alpha[t - 1])
            alpha[t] = x / x.sum(axis=1, keepdims=True)
        moves = np.zeros((2, 2))
        for t in range(width - 2, -1, -1):
            nxt = beta[t + 1] * np.stack([np.ones(n), np.exp(e[:, t + 1])], axis=1)
            pair = alpha[t][:, :, None] * m[None] * nxt[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            moves += pair[there[:, t + 1]].sum(axis=0)
            x = nxt @ m.T
            x = np.where(there[:, t + 1, None], x, beta[t + 1])
            beta[t] = x / x.sum(axis=1, keepdims=True)
        p = alpha * beta
        p = (p / p.sum(axis=2, keepdims=True))[:, :, 1].T
        model = np.bincount(fx[there], weights=p[there], minlength=len(chain.emit))
        chain.emit += rate * ((real_emit - model) / np.maximum(seen, 1) * 8 - decay * chain.emit)
        chain.move += rate * ((real_moves - moves) / max(1.0, real_moves.sum()) * 4 - decay * chain.move)
        chain.start += rate * float(np.mean(lab[:, 0] - p[:, 0]))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = 16_000, least: int = 6, purity: float = 0.7, candidates: int = 20_000, features: int = 400, stretches: int = 6000, reach: int = 24) -> Chain:
    """A fitted chain from documents (doc_id, text) and labels (doc_id, toxic)."""
    sample = training_sample(docs, labels, sample_docs)
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    chain = Chain({}, np.zeros(1), np.zeros((2, 2)), 0.0, base=n1 / max(1, n1 + n0))
    if not n1 or not n0:
        return chain
    found = _candidates(sample, n1, n0, least, purity, candidates)
    chosen = _chosen(found, *_held(sample, found), least, features) if found else []
    if not chosen:
        return chain
    chain.names = {f: i + 1 for i, f in enumerate(chosen)}
    chain.emit = np.zeros(len(chosen) + 1)
    fit_chain(chain, *_stretches(sample, chain, stretches, reach))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, _ = chain.evidence(batch.column(0).to_pylist())
            yield pa.record_batch([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    got = over_texts(sample, ["text", "toxic"], "x array<double>, toxic int", rows).toArrow().to_pydict()
    chain.curve = fit_curve(np.array(got["x"]), np.array(got["toxic"], dtype=float))
    return chain


def tag(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, and spans: begin and end (code points) and probability of each offending token."""
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            scores, p = chain.scores(texts)
            spans = []
            for text, own in zip(texts, p, strict=True):
                hits = {int(i) for i in np.flatnonzero(own >= threshold)}
                spans.append([{"begin": m.start(), "end": m.end(), "p": float(own[i])} for i, m in enumerate(_WORD.finditer(text)) if i in hits] if hits else [])
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    return over_texts(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"],
        "doc_id long, score double, spans array<struct<begin:long,end:long,p:double>>", rows,
    )


def without_toxic(docs: DataFrame, chain: Chain, limit: float = 0.5) -> DataFrame:
    """The rows of docs with a score below limit, with all their columns."""
    text_at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_at):
            scores, _ = chain.scores([t or "" for t in batch.column(text_at).to_pylist()])
            yield batch.filter(pa.array(scores < limit))

    return over_texts(docs, docs.columns, docs.schema, rows)

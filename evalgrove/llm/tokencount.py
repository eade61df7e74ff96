"""Token counts at every prefix, by dynamic programming over byte-pair vocabularies with word ends.

The count at a prefix needs only the count at one earlier prefix: a word's encoding ends in exactly one
token that is compatible with the last token of what precedes it. A pair of tokens is compatible if
no merge crosses the border between them while they grow; pairs are remembered. Counts of distinct words are
computed once in a worker, and a text's counts are running sums over its words.

Rows: null texts are empty texts, with no token. Repeated rows are counted each by itself. An empty
table gives an empty result. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from string import punctuation

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import over_texts
from .tokenfiles import byte_characters, library_tokenizer

#: White space of the tokenizer's normaliser (fixed values).
SPACE = "\t-\r\x20\x85\xa0  -     　"
_SPACES = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{SPACE}]", c))
_CHUNKS = re.compile(f"[^{SPACE}]+").findall
#: The white space before a text's first chunk, or a chunk with what white space follows it.
_UNITS = re.compile(f"^[{SPACE}]+|[^{SPACE}]+[{SPACE}]*").findall
_NOT_PYTHON_SPACE = re.compile("[\x1c-\x1f]").search
#: The pre-tokenizer's pattern, and its form for lower-case printable ASCII.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall
#: Characters without white space that normalisation only turns to lower case, one by one.
_PLAIN = re.compile("[!-~\xa1-\u012f\u0131-\u01c3\u01cd-\u024f]+").fullmatch
_SHOWN = dict(enumerate(byte_characters()))
#: Entries remembered in a worker before the older ones go.
CACHE_ENTRIES, CACHE_CHARS = 700_000, 24


class _Counts(dict):
    """Text to token count, computed when first asked for. When full, what was asked for since the last time stays for one more turn."""

    entries = CACHE_ENTRIES

    def __init__(self, count):
        super().__init__()
        self.count, self.old = count, {}

    def __missing__(self, text: str) -> int:
        n = self.old.get(text)
        if n is None:
            n = self.count(text)
        if len(text) <= CACHE_CHARS:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[text] = n
        return n


class _Insides(_Counts):
    """Text to the counts at each of its characters: bytes, or an array if they need more."""

    entries = 250_000

    def __init__(self, counts):
        super().__init__(lambda text: _small(counts(text)))


def _small(counts: list[int]) -> bytes | np.ndarray:
    return bytes(counts) if max(counts) < 256 else np.array(counts, dtype=np.int32)


class _Word:
    """The dynamic program over one word of byte characters: at each prefix its last token and its number of tokens."""

    __slots__ = ("counter", "chars", "last", "count")

    def __init__(self, counter: "PrefixCounter", chars: str = ""):
        self.counter, self.chars, self.last, self.count = counter, "", [""], [0]
        self.more(chars)

    def more(self, chars: str) -> None:
        at, self.chars = len(self.chars), self.chars + chars
        word, last, count = self.chars, self.last, self.count
        vocab, pairs, lengths = self.counter.vocab, self.counter.pairs, self.counter.lengths
        for i in range(at + 1, len(word) + 1):
            for n in lengths[word[max(0, i - 4) : i]]:
                j = i - n
                if j >= 0 and (token := word[j:i]) in vocab and last[j] is not None and pairs[last[j], token]:
                    last.append(token)
                    count.append(count[j] + 1)
                    break
            else:
                last.append(None)  # only before a vocabulary's single bytes with an end
                count.append(0)

    def whole(self) -> int:
        """Tokens of the prefix so far as a word of its own."""
        word, last, vocab, pairs, end = self.chars, self.last, self.counter.vocab, self.counter.pairs, self.counter.end
        i = len(word)
        for n in self.counter.end_lengths[word[max(0, i - 4) : i]]:
            j = i - n
            if j >= 0 and (token := word[j:i] + end) in vocab and last[j] is not None and pairs[last[j], token]:
                return self.count[j] + 1
        raise ValueError("the vocabulary lacks single bytes")

    def cut(self, n: int) -> None:
        self.chars = self.chars[:n]
        del self.last[n + 1 :], self.count[n + 1 :]


class _Pairs(dict):
    """Whether two tokens (the left one empty: one token) stay as they are when merged."""

    def __init__(self, compatible):
        super().__init__()
        self.compatible = compatible

    def __missing__(self, pair: tuple[str, str]) -> bool:
        if len(self) > 2 * CACHE_ENTRIES:
            self.clear()
        found = self[pair] = self.compatible(*pair)
        return found


class _Lengths(dict):
    """Lengths, longest first, of the tokens that can end in the last TAIL characters before a place."""

    TAIL = 4

    def __init__(self, tokens):
        super().__init__()
        self.of: dict[str, list[int]] = {}
        for n, tail in sorted({(len(t), t[-self.TAIL :]) for t in tokens}, reverse=True):
            self.of.setdefault(tail, []).append(n)

    def __missing__(self, tail: str) -> tuple[int, ...]:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        found = list(self.of.get(tail, ())) if len(tail) == self.TAIL else []
        for n in range(min(len(tail), self.TAIL - 1), 0, -1):
            found += [n] if tail[-n:] in self.of else []
        out = self[tail] = tuple(found)
        return out


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Characters that normalisation can join to what stands before them."""
    second = {chr(int(d[1], 16)) for d in (unicodedata.decomposition(chr(i)).split() for i in range(0xC0, 0x30000)) if len(d) == 2 and d[0][0] != "<"}
    return frozenset(second | set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)])))


class PrefixCounter:
    """Exact token counts of prefixes under one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = library_tokenizer(path)
        self.end = spec["model"]["end_of_word_suffix"] or ""
        vocab, end = spec["model"]["vocab"], len(self.end)
        self.vocab = frozenset(vocab)
        self.rank = {tuple(m): i for i, m in enumerate(spec["model"]["merges"])}
        self.made = {a + b: (i, a, b) for (a, b), i in self.rank.items()}
        self.lengths = _Lengths(t for t in vocab if not (end and t.endswith(self.end)))
        self.end_lengths = _Lengths(t[:-end] if end else t for t in vocab if t.endswith(self.end) and len(t) > end)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.longest = max(map(len, [*vocab, *self.specials]))
        self.special = re.compile("|".join(map(re.escape, self.specials)))
        self.pairs = _Pairs(self.compatible)
        self.words, self.chunks = _Counts(self.word), _Counts(self.chunk)
        self.runs, self.insides = _Insides(self.run), _Insides(self.unit)

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain merging in rank order; only for single tokens."""
        while len(symbols) > 1:
            rank, i = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 60:
                break
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def compatible(self, left: str, right: str) -> bool:
        if not left:
            return self.merged(self.symbols(right)) == [right]
        if not self.pairs["", right]:
            return False
        # the border must not merge at any time while the two grow: take the later made one apart again and again
        none, limit = (-1, "", ""), 1 << 60
        while True:
            if self.rank.get((left, right), 1 << 60) < limit:
                return False
            (a, _, inner), (b, outer, _) = self.made.get(left, none), self.made.get(right, none)
            if a < 0 and b < 0:
                return True
            if a > b:  # of equal merges the left one comes first
                limit, left = a, inner
            else:
                limit, right = b + 1, outer

    def prefixes(self, word: str) -> list[int]:
        """Token counts of the prefixes of a word of byte characters, each as a word of its own."""
        state, out = _Word(self), []
        for c in word:
            state.more(c)
            out.append(state.whole())
        return out

    def word(self, word: str) -> int:
        """Tokens of a word of byte characters."""
        if word + self.end in self.vocab and self.pairs["", word + self.end]:
            return 1
        return _Word(self, word).whole()

    def normal(self, text: str) -> str:
        if _PLAIN(text):
            return text.lower()
        return self.library.normalizer.normalize_str(text)

    def pieces(self, normal: str) -> list[tuple[str, str]]:
        """Words of a normalised chunk, and the same in byte characters."""
        if _PLAIN(normal):
            found = _ASCII_WORDS(normal) if normal.isascii() else _WORDS(normal)
            return [(p, p if p.isascii() else p.encode().decode("latin-1").translate(_SHOWN)) for p in found]
        return [(normal[a:b], p) for p, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def chunk(self, chunk: str) -> int:
        if _PLAIN(chunk):
            lower = chunk.lower()
            stem = lower.rstrip(punctuation)
            if stem.isalpha():  # a word and the marks after it
                total = self.words[stem if stem.isascii() else stem.encode().decode("latin-1").translate(_SHOWN)]
                return total + self.words[lower[len(stem) :]] if len(stem) < len(lower) else total
        return sum(self.words[p] for _, p in self.pieces(self.normal(chunk)))

    def counts(self, text: str) -> list[int]:
        """Counts of the chunks between white space, in order; special strings are chunks of one token."""
        out: list[int] = []
        for k, part in enumerate(self.special.split(text) if "<|" in text else [text]):
            if k:
                out.append(1)
            out += map(self.chunks.__getitem__, _CHUNKS(part) if _NOT_PYTHON_SPACE(part) else part.split())
        return out

    def clusters(self, chunk: str) -> list[str]:
        """Parts of a chunk that are normalised independently: a character and those that can join it."""
        if _PLAIN(chunk):
            return list(chunk)
        joining = _joining()
        out: list[str] = []
        for c in chunk:
            if out and (c in joining or unicodedata.combining(c)):
                out[-1] += c
            else:
                out.append(c)
        return out

    def _steps(self, normal: str) -> Iterator[tuple[int, int, str, int, _Word]]:
        """After each character of a normalised chunk: tokens so far, those before the open word, that word, how much of it has come, its program.

        An apostrophe counts to the word after it, which it may yet become one with.
        """
        before, lead = 0, ""
        for text, shown in self.pieces(normal):
            state, at, count = _Word(self), 0, before
            joined = text[0] == "'" and text[1:].isalpha()  # one word, whose beginnings are two
            for n, c in enumerate(text, 1):
                if joined:
                    count = before + self._tokens(text[:n])
                else:
                    width = len(c.encode())
                    state.more(shown[at : at + width])
                    at += width
                    count = before + state.whole()
                if lead:
                    yield count, before - self._tokens(lead), lead + text, n + 1, state
                else:
                    yield count, before, text, n, state
            before, lead = count, text if text == "'" else ""

    def _tokens(self, normal: str) -> int:
        return sum(self.words[p] for _, p in self.pieces(normal))

    def _followed(self, before: int, text: str, n: int, state: _Word, by: str) -> int:
        """Tokens if `by` came after the first n characters of the open word."""
        if n <= 64:
            return before + self._tokens(text[:n] + by)
        kind = unicodedata.category(text[n - 1])[0]
        run = 0
        while run < len(by) and kind != "N" and (by[run].isalpha() if kind == "L" else unicodedata.category(by[run])[0] not in "LN"):
            run += 1
        at = len(state.chars)
        state.more(by[:run].encode().decode("latin-1").translate(_SHOWN))
        total = before + state.whole() + self._tokens(by[run:])
        state.cut(at)
        return total

    def inside(self, chunk: str) -> list[int]:
        """Token counts of chunk[:1], chunk[:2] and so on, in one pass: a word's program goes on from one prefix to the next."""
        parts, out = self.clusters(chunk), []
        normal = [self.normal(p) for p in parts]
        steps, now = self._steps("".join(normal)), (0, 0, "", 0, _Word(self))
        for part, own in zip(parts, normal, strict=True):
            out += [self._followed(*now[1:], self.normal(part[:n])) for n in range(1, len(part))]
            for _ in own:
                now = next(steps)
            out.append(now[0])
        return out

    def run(self, word: str) -> list[int]:
        """Token counts of the prefixes of a plain word of letters alone or of marks alone, each as a word of its own."""
        shown, ends = word, range(1, len(word) + 1)
        if not word.isascii():
            shown = word.encode().decode("latin-1").translate(_SHOWN)
            ends = np.cumsum([len(c.encode()) for c in word]).tolist()
        vocab, pairs, lengths, end_lengths, end = self.vocab, self.pairs, self.lengths, self.end_lengths, self.end
        last, count, out, at = [""], [0], [], 0
        for i in range(1, len(shown) + 1):
            tail = shown[i - 4 if i > 4 else 0 : i]
            for n in lengths[tail]:
                j = i - n
                if j >= 0 and (token := shown[j:i]) in vocab and last[j] is not None and pairs[last[j], token]:
                    last.append(token)
                    count.append(count[j] + 1)
                    break
            else:
                last.append(None)
                count.append(0)
            if i != ends[at]:  # inside of a character
                continue
            at += 1
            for n in end_lengths[tail]:
                j = i - n
                if j >= 0 and (token := shown[j:i] + end) in vocab and last[j] is not None and pairs[last[j], token]:
                    out.append(count[j] + 1)
                    break
            else:
                raise ValueError("the vocabulary lacks single bytes")
        return out

    def unit(self, unit: str) -> list[int]:
        """Token counts at each character of a chunk and the white space after it; of white space alone, none."""
        chunk = unit.rstrip(_SPACES)
        inside: list[int] = []
        if chunk and _PLAIN(chunk) and (stem := (lower := chunk.lower()).rstrip(punctuation)).isalpha():  # a word and the marks after it
            inside = [int(n) for n in self.runs[stem]]
            if len(stem) < len(lower):
                inside += [inside[-1] + int(n) for n in self.runs[lower[len(stem) :]]]
        elif chunk:
            inside = self.inside(chunk)
        return inside + [inside[-1] if inside else 0] * (len(unit) - len(chunk))

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token counts of text[:0], text[:1] and so on to the whole text. Those inside of chunks are remembered; a text's are running sums over these."""
        if any(special in text for special in self.specials):
            return np.array(self._around_specials(text), dtype=np.int32)
        units = [b"\0", *map(self.insides.__getitem__, _UNITS(text))]
        if any(type(u) is not bytes for u in units):
            held = np.concatenate([np.frombuffer(u, np.uint8).astype(np.int32) if type(u) is bytes else u for u in units])
        else:
            held = np.frombuffer(b"".join(units), np.uint8).astype(np.int32)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        own = held[np.cumsum(sizes) - 1]
        held += np.repeat((np.cumsum(own) - own).astype(np.int32), sizes)
        return held

    def every_prefix(self, text: str) -> list[int]:
        """prefix_counts() as a list."""
        return self.prefix_counts(text).tolist()

    def _around_specials(self, text: str) -> list[int]:
        """prefix_counts() of a text that holds special strings."""
        out, before = [0], 0
        special = re.compile("|".join([self.special.pattern, f"[{SPACE}]+"]))
        at = 0
        for m in [*special.finditer(text), None]:
            chunk = text[at : m.start() if m else len(text)]
            if chunk:
                inside = self.insides[chunk]
                out += [before + n for n in (inside if type(inside) is bytes else inside.tolist())]
                before = out[-1]
            if m and m[0] in self.specials:  # a cut special string is ordinary text, joined to what stands before it
                out += [before - (self.chunk(chunk) if chunk else 0) + self.chunk(chunk + m[0][:i]) for i in range(1, len(m[0]))]
                before += 1
                out.append(before)
            elif m:
                out += [before] * len(m[0])
            at = m.end() if m else at
        return out

    def longest_prefix(self, text: str, budget: int, counts: list[int] | None = None) -> int:
        """Code points of the longest prefix of at most budget tokens; only the part of the text in which the budget ends is gone through."""
        counts = self.counts(text) if counts is None else counts
        whole = f"[^{SPACE}]+" if "<|" not in text else f"{self.special.pattern}|(?:(?!{self.special.pattern})[^{SPACE}])+"
        spans, head, k = [m.span() for m in re.finditer(whole, text)], 0, 0
        while k < len(counts) and head + counts[k] <= budget:
            head += counts[k]
            k += 1
        if k == len(counts):
            return len(text)
        special = [self.special.fullmatch(text[a:b]) is not None for a, b in spans[max(0, k - 1) : k + 2]] if "<|" in text else [False] * 3
        own, low, high = min(k, 1), k, k
        # a cut special string is ordinary text and joined to the chunk that it touches
        if special[own] and k and not special[own - 1] and spans[k - 1][1] == spans[k][0]:
            low, head = k - 1, head - counts[k - 1]
        if not special[own] and k + 1 < len(spans) and special[own + 1] and spans[k][1] == spans[k + 1][0]:
            high = k + 1
        # a token holds at most `longest` bytes, so nothing beyond this many code points can fit
        start = spans[low][0]
        inside = self.every_prefix(text[start : min(spans[high][1], start + (budget - head + 1) * self.longest)])
        return start + max(i for i, n in enumerate(inside) if head + n <= budget)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str, budget: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit, and chars_in_limit: the code points that fit a budget of tokens."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            n_bytes, n_tokens, fits = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                counts = count.counts(text)
                total = sum(counts)
                n_bytes.append(len(text.encode()))
                n_tokens.append(total)
                fits.append(len(text) if total <= budget else count.longest_prefix(text, budget, counts))
            yield pa.record_batch(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > budget for n in n_tokens], pa.bool_()), pa.array(fits, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "chars_in_limit"],
            )

    return over_texts(
        docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")), ["doc_id", "text"],
        "doc_id long, n_bytes long, n_tokens long, over_limit boolean, chars_in_limit long", rows,
    )


def prefix_token_counts(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", budget: int | None = None) -> DataFrame:
    """id and prefix_tokens: at index i the tokens of the text's first i code points, from 0 to the whole.

    With a budget also n_tokens, and chars_in_limit: what chars_within() reads off the counts.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            held = [count.prefix_counts(t or "") for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, held)], dtype=np.int32)
            counts = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *held])))
            columns = {"doc_id": batch.column(0), "prefix_tokens": counts}
            if budget is not None:
                columns["n_tokens"] = pa.array([int(n[-1]) for n in held], pa.int64())
                columns["chars_in_limit"] = pa.array([int(np.flatnonzero(n <= budget)[-1]) if budget >= 0 else None for n in held], pa.int64())
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return over_texts(
        docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")), ["doc_id", "text"],
        "doc_id long, prefix_tokens array<int>" + (", n_tokens long, chars_in_limit long" if budget is not None else ""), rows,
    )


def tokens_of_prefix(prefix_tokens: Column, chars: Column) -> Column:
    """Tokens of the first chars code points, read off the stored counts."""
    return F.get(prefix_tokens, F.least(chars, F.size(prefix_tokens) - 1).cast("int"))


def chars_within(prefix_tokens: Column, budget: Column) -> Column:
    """Code points of the longest prefix of at most budget tokens, read off the stored counts."""
    fits = F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i))
    return F.array_max(fits)

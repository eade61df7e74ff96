"""Loading public tokenizer files once in each Python worker, and caching encodings of short chunks."""

from __future__ import annotations

import base64
import os
import re
from array import array
from functools import lru_cache
from string import punctuation

#: Encodings remembered in a worker before the older ones go.
CACHE_ENTRIES = 700_000
#: Longer chunks are encoded each time.
CACHE_CHARS = 24

@lru_cache(maxsize=4)
def library_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others, in order, for characters from 256 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, extra = [], 256
    for byte in range(256):
        if byte in shown:
            table.append(chr(byte))
        else:
            table.append(chr(extra))
            extra += 1
    return table


def merges_of(rank_of: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge list behind a rank file: the two parts that a token has under all lower ranks."""
    out = []
    for token, rank in sorted(rank_of.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            best = min(
                ((rank_of.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)), default=(rank, 0)
            )
            if best[0] >= rank:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


@lru_cache(maxsize=2)
def rank_tokenizer(path: str, pattern: str):
    """A tokenizers-library BPE that encodes by the ranks of a tiktoken file, each pattern match by itself."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    rank_of, shown = ranks(path), byte_characters()
    name = {token: "".join(shown[b] for b in token) for token in rank_of}
    merges = [(name[a], name[b]) for a, b in merges_of(rank_of)]
    model = models.BPE(vocab={name[t]: r for t, r in rank_of.items()}, merges=merges, ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    return tokenizer


#: Chunks of these characters split alike under the library's and Python's regular expressions.
_PLAIN = re.compile(r"[\t-\r\x20-\u024f]*")


class _OddSpace(Exception):
    """A run of white space that isn't inside one chunk."""


class _Chunks(dict):
    """Chunk to ids, computed when first asked for. When full, what was asked for since the last time stays for one more turn."""

    def __init__(self, ids_of):
        super().__init__()
        self.ids_of, self.old = ids_of, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.ids_of(chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class ChunkEncoder:
    """Token ids of whole texts as little-endian unsigned 32-bit integers, by the tokenizers library.

    The byte-level pattern never spans a single space before other characters, nor the beginning of one or
    two newlines, so a text is cut there, and encodings of the parts, joined, are the encoding of the text.
    Parts are encoded once in a worker and remembered. New ones are split by the pattern, and each match goes
    to the library's model; parts with characters beyond the Latin blocks go to the library as they are, as
    do whole texts with special strings or with other runs of white space.
    """

    def __init__(self, tokenizer, pattern: str, specials: tuple[str, ...] = ()):
        import regex

        self.tokenizer, self.tokenize, self.specials = tokenizer, tokenizer.model.tokenize, specials
        self.find, self.shown = regex.compile(pattern).findall, dict(enumerate(byte_characters()))
        self.first, self.later, self.pieces = (_Chunks(f) for f in (self._chunk, self._later, self._piece))

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """One match of the pattern."""
        name = piece.encode().decode("latin-1").translate(self.shown)
        return array("I", [t.id for t in self.tokenize(name)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk[-1:].isspace():
            raise _OddSpace
        if not _PLAIN.fullmatch(chunk):
            return self._whole(chunk)
        return b"".join(map(self.pieces.__getitem__, self.find(chunk)))

    def _later(self, chunk: str) -> bytes:
        """A chunk after the text's first one: it begins with newlines, or stands for itself after a space."""
        if not chunk:
            raise _OddSpace
        word = chunk.rstrip(punctuation)
        if word.isalpha() and _PLAIN.fullmatch(chunk):  # a word and the marks after it are two matches
            return self.later[word] + self.pieces[chunk[len(word) :]] if len(word) < len(chunk) else self._piece(" " + chunk)
        return self._chunk(chunk if chunk[0] == "\n" else " " + chunk)

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.specials):
            return self._whole(text)
        first, *rest = text.replace("\n", " \n").replace("\n \n", "\n\n").split(" ")
        end = b""
        if rest and rest[-1] == "\n":
            end = self.pieces[rest.pop()]
        try:
            return b"".join([self.first[first] if first else b"", *map(self.later.__getitem__, rest), end])
        except _OddSpace:
            return self._whole(text)

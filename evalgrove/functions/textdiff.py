"""Longest common runs of words of two texts, and the spans in which they differ.

Of two ranges the longest run that both hold is matched first: of equally long ones the first in the left text, and of these the first
in the right one; what lies before and after it is matched likewise. All runs of a range's greatest length are taken in one pass from left to
right, since between two of them only shorter ones are left; so there are as many rounds as there are different lengths, at most
about the root of twice the words, and a round looks at each word a few times.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

#: An odd number to multiply by; runs are compared word by word before they count.
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Runs:
    """Hashes of all runs of a given length of a list of word numbers, from hashes of its beginnings."""

    def __init__(self, words: np.ndarray, powers: np.ndarray):
        self.words, self.powers = words, powers
        mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
        # the sum of word k times base ** k; a run's sum is brought to a common power
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((mixed ^ (mixed >> np.uint64(29))) * powers[: len(words)], dtype=np.uint64)])

    def of(self, begin: int, end: int, length: int) -> np.ndarray:
        last = end - length + 1
        return (self.sums[begin + length : last + length] - self.sums[begin:last]) * self.powers[len(self.powers) - 1 - np.arange(begin, last)]


def matching_runs(left: list[str], right: list[str]) -> list[tuple[int, int, int]]:
    """(place in left, place in right, words) of the matched runs, in order; neighbours that touch on both sides are one."""
    number: dict[str, int] = {}
    a, b = (np.array([number.setdefault(w, len(number)) for w in words], np.int64) for words in (left, right))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(len(a), len(b)), _BASE)]), dtype=np.uint64)
        x, y = _Runs(a, powers), _Runs(b, powers)
        found, ranges = [], [(0, len(a), 0, len(b), min(len(a), len(b)))]
        while ranges:
            a0, a1, b0, b1, most = ranges.pop()
            low, high = 0, min(most, a1 - a0, b1 - b0)
            while low < high:  # the greatest length of a run that both ranges hold
                n = (low + high + 1) // 2
                low, high = (n, high) if np.isin(x.of(a0, a1, n), y.of(b0, b1, n)).any() else (low, n - 1)
            while low and not (runs := _taken(x, y, a0, a1, b0, b1, low)):
                low -= 1  # equal hashes of different runs
            if not low:
                continue
            found += [(i, j, low) for i, j in runs]
            for i, j in runs:
                ranges.append((a0, i, b0, j, low - 1))
                a0, b0 = i + low, j + low
            ranges.append((a0, a1, b0, b1, low - 1))
    out: list[tuple[int, int, int]] = []
    for i, j, n in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


def _taken(x: _Runs, y: _Runs, a0: int, a1: int, b0: int, b1: int, n: int) -> list[tuple[int, int]]:
    """Runs of n words, each the first in left that right still holds after the one before."""
    ours, theirs = x.of(a0, a1, n), y.of(b0, b1, n)
    places: dict[int, list[int]] = {}
    shared = np.flatnonzero(np.isin(theirs, ours))
    for j, h in zip((shared + b0).tolist(), theirs[shared].tolist(), strict=True):
        places.setdefault(h, []).append(j)
    out: list[tuple[int, int]] = []
    i_from, j_from = a0, b0
    known = np.flatnonzero(np.isin(ours, theirs))
    for i, h in zip((known + a0).tolist(), ours[known].tolist(), strict=True):
        if i < i_from:
            continue
        own = places[h]
        for k in range(bisect_left(own, j_from), len(own)):
            if (x.words[i : i + n] == y.words[own[k] : own[k] + n]).all():
                out.append((i, own[k]))
                i_from, j_from = i + n, own[k] + n
                break
    return out


def differing_spans(left: str | None, right: str | None) -> int:
    """How many stretches of words have to be put in, taken out or replaced to make one text of the other."""
    a, b = (left or "").split(), (right or "").split()
    spans = at = other = 0
    for i, j, n in [*matching_runs(a, b), (len(a), len(b), 0)]:
        spans += i > at or j > other
        at, other = i + n, j + n
    return spans

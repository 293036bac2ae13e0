"""Recompression of texts: rounds that name token runs and pairs the same way everywhere.

A text is a row of word hashes. The first round names runs of one word; each later round splits all symbols into left and
right ones by a hash bit of round and name, and every left symbol followed by a right one becomes one symbol. A name is a hash of
what it stands for, so equal symbols have equal names in every task without a dictionary. Symbols of ``FULL`` words or more stay as
they are. For each symbol the words that decided it are kept: itself, and the neighbours that could have joined it. Wherever those
words occur again, the same symbol occurs again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ROUNDS, FULL = 7, 10
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


@dataclass
class Symbols:
    """Names with the words they span (``start`` to ``end``) and the words that decided them (``low`` to ``high``); where those
    would reach over an end of the text, ``low`` or ``high`` lies outside it."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def keep(self, rows: np.ndarray) -> Symbols:
        return Symbols(*(x[rows] for x in (self.name, self.start, self.end, self.low, self.high)))


def recompress(words: np.ndarray, text: np.ndarray) -> Symbols:
    """Symbols of several texts laid end to end: word hashes, and the number of the text each belongs to (ascending)."""
    n = len(words)
    place = np.arange(n)
    last = np.ones(n, dtype=bool)
    last[:-1] = (words[1:] != words[:-1]) | (text[1:] != text[:-1])
    end = place[last] + 1
    start = np.concatenate([[0], end[:-1]])[:len(end)]
    name = mix(words[start] ^ mix((end - start).astype(np.uint64) * _M1))
    s = Symbols(name, start, end, start - 1, end + 1)
    of = text[start]
    for r in range(1, ROUNDS + 1):
        if not len(s.name):
            break
        free = s.end - s.start < FULL
        right = free & (mix(s.name + np.uint64(r * int(_M1) % 2**64)) >> np.uint64(63) == 1)
        left = free & ~right
        near = np.zeros(len(of), dtype=bool)
        near[:-1] = of[1:] == of[:-1]  # a next symbol in the same text
        joins = np.zeros(len(of), dtype=bool)
        joins[:-1] = near[:-1] & left[:-1] & right[1:]
        joined = np.concatenate([[False], joins[:-1]])
        # A left symbol that stays alone was decided by its next symbol too, a right one by the one before.
        low, high = s.low.copy(), s.high.copy()
        at = np.nonzero(left & ~joins)[0]
        inner = at[near[at]]
        low[inner], high[inner] = np.minimum(s.low[inner], s.low[inner + 1]), np.maximum(s.high[inner], s.high[inner + 1])
        outer = at[~near[at]]
        high[outer] = np.maximum(s.high[outer], s.end[outer] + 1)
        back = np.concatenate([[False], near[:-1]])
        at = np.nonzero(right & ~joined)[0]
        inner = at[back[at]]
        low[inner], high[inner] = np.minimum(low[inner], s.low[inner - 1]), np.maximum(high[inner], s.high[inner - 1])
        outer = at[~back[at]]
        low[outer] = np.minimum(s.low[outer], s.start[outer] - 1)
        at = np.nonzero(joins)[0]
        name, end = s.name.copy(), s.end.copy()
        name[at] = mix(mix(s.name[at] + _M1) ^ (s.name[at + 1] * _M2))
        end[at] = s.end[at + 1]
        low[at], high[at] = np.minimum(s.low[at], s.low[at + 1]), np.maximum(s.high[at], s.high[at + 1])
        s, of = Symbols(name, s.start, end, low, high).keep(~joined), of[~joined]
    return s

"""FM-indexes over integer symbols, for many searches at a time.

A text is a sequence of chunks of symbols from 1 on, each closed by a 0. Closing symbols
count as distinct and rank by their place, so suffixes compare within their chunk and the
sort ends after as many doublings as the longest chunk needs. The Burrows-Wheeler
transform is held as a wavelet matrix; every function takes arrays of intervals or rows
and answers all of them level by level.
"""

from __future__ import annotations

import numpy as np


class Wavelet:
    """A wavelet matrix: per level one bit for each symbol, symbols with a 0 before those
    with a 1, and the number of ones before every 64 bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n = bits, len(symbols)
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for k in range(bits - 1, -1, -1):
            one = (symbols >> k & 1).astype(bool)
            words = np.zeros((self.n >> 6) + 1, np.uint64)
            raw = np.packbits(one, bitorder="little")
            words.view(np.uint8)[:len(raw)] = raw
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((words, before, self.n - int(one.sum())))
            symbols = np.concatenate((symbols[~one], symbols[one]))
        every = np.arange(1 << bits)
        self.begin = np.zeros(len(every), np.int64)
        self.begin = self._follow(every, np.zeros(len(every), np.int64))

    @staticmethod
    def _ones(level: tuple, i: np.ndarray) -> np.ndarray:
        """The ones before place ``i`` of a level."""
        at = i >> 6
        return level[1][at] + np.bitwise_count(level[0][at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def _follow(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(self.levels):
            ones = self._ones(level, i)
            i = np.where(c >> (self.bits - 1 - k) & 1, level[2] + ones, i - ones)
        return i - self.begin[c]

    def rank(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often symbol ``c`` stands before ``lo`` and before ``hi``."""
        both = self._follow(np.concatenate((c, c)), np.concatenate((lo, hi)))
        return both[:len(lo)], both[len(lo):]

    def less(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How many symbols under ``c`` stand from ``lo`` to ``hi``."""
        found = np.zeros(len(lo), np.int64)
        for k, level in enumerate(self.levels):
            one = (c >> (self.bits - 1 - k) & 1).astype(bool)
            l1, h1 = self._ones(level, lo), self._ones(level, hi)
            found += np.where(one, hi - lo - h1 + l1, 0)
            lo, hi = np.where(one, level[2] + l1, lo - l1), np.where(one, level[2] + h1, hi - h1)
        return found

    def children(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        """Every symbol in every interval: (interval, symbol, its rank at lo, at hi, how
        many lesser symbols the interval holds)."""
        who, c, less = np.arange(len(lo)), np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        for level in self.levels:
            l1, h1 = self._ones(level, lo), self._ones(level, hi)
            l0, h0 = lo - l1, hi - h1
            zero, one = h0 > l0, h1 > l1
            less = np.concatenate((less[zero], (less + h0 - l0)[one]))
            who, c = np.concatenate((who[zero], who[one])), np.concatenate((2 * c[zero], 2 * c[one] + 1))
            lo = np.concatenate((l0[zero], level[2] + l1[one]))
            hi = np.concatenate((h0[zero], level[2] + h1[one]))
        return who, c, lo - self.begin[c], hi - self.begin[c], less

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places ``i`` and how often each stands before its place."""
        c = np.zeros(len(i), np.int64)
        for level in self.levels:
            ones = self._ones(level, i)
            bit = (level[0][i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            c = 2 * c + bit
            i = np.where(bit, level[2] + ones, i - ones)
        return c, i - self.begin[c]


def suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """The places of ``text`` in the order of their suffixes: one sort by as many symbols
    as a 64-bit key holds, then doubling among those still tied."""
    n, depth = len(text), max(1, 63 // bits)
    inside, symbols = text != 0, text.astype(np.uint64)
    key = symbols.copy()
    for j in range(1, depth):
        later = np.zeros(n, np.uint64)
        later[:-1] = key[1:]
        later *= inside
        later |= symbols << np.uint64(bits * j)
        key = later
    ended = key & np.uint64((1 << bits) - 1) == 0  # the key reaches its chunk's end
    order = np.argsort(key)
    rank, slots, k = np.empty(n, np.int64), np.arange(n), depth
    slots = _settle(key[order], order, rank, slots)
    closed = ended[order[slots]]  # equal up to their chunks' ends, which rank by place
    last = slots[closed]
    key = rank[order[last]] << 32 | order[last]
    by = np.argsort(key)
    order[last] = order[last][by]
    _settle(key[by], order, rank, last)
    slots = slots[~closed]
    while len(slots):
        place = order[slots]
        key = rank[place] << 32 | rank[place + k]
        by = np.argsort(key)
        order[slots] = place[by]
        slots = _settle(key[by], order, rank, slots)
        k *= 2
    return order


def _settle(key: np.ndarray, order: np.ndarray, rank: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Rank the suffixes in ``slots`` of the order by their sorted keys, equal ones by the
    first slot of their group; the slots of those groups are returned."""
    head = np.ones(len(slots), bool)
    np.not_equal(key[1:], key[:-1], out=head[1:])
    rank[order[slots]] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
    single = head.copy()
    single[:-1] &= head[1:]
    return slots[~single]


class FMIndex:
    """An FM-index of ``text`` (symbols under 2 ** bits); with ``every`` the places that
    are a multiple of it from their chunk's start are kept, so that rows can be located."""

    def __init__(self, text: np.ndarray, bits: int, every: int = 0):
        self.n = len(text)
        order = suffix_order(text, bits)
        self.bwt = Wavelet(text[order - 1], bits)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=1 << bits))))
        if every:
            closing = np.flatnonzero(text == 0)
            begins = np.concatenate(([0], closing[:-1] + 1)) if len(closing) else closing
            offset = np.arange(self.n) - np.repeat(begins, np.diff(np.append(begins, self.n)))
            kept = offset[order] % every == 0
            self.kept, self.places = Wavelet(kept.astype(np.int64), 1), order[kept]

    def left(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of ``c`` followed by what the rows from lo to hi begin with."""
        lo, hi = self.bwt.rank(c, lo, hi)
        return self.first[c] + lo, self.first[c] + hi

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of many patterns (one a row, ending in the last column): the
        rows (lo, hi) that begin with each."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        for t in range(patterns.shape[1]):
            go = np.flatnonzero((lengths > t) & (hi > lo))
            if not len(go):
                break
            lo[go], hi[go] = self.left(patterns[go, -1 - t].astype(np.int64), lo[go], hi[go])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of each row, by steps to the left up to a kept place."""
        out, left, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(rows):
            kept, number = self.kept.access(rows)
            here = kept == 1
            out[left[here]] = self.places[number[here]] + steps
            rows, left = rows[~here], left[~here]
            c, rank = self.bwt.access(rows)
            rows = self.first[c] + rank
            steps += 1
        return out

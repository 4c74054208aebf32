"""Bit-sliced Hamming comparison of groups of 64-bit fingerprints.

The fingerprints of a group stand in columns: plane b holds bit b of 64 fingerprints in
one machine word.  One query against a word updates 64 distances at a time: two
difference planes and the lowest counter go through a carry-save adder, the carry
ripples through the higher counters, and what leaves the highest marks the lane as
beyond the radius.  Words whose lanes are all beyond it are abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BITS = 64
ALL = np.uint64(2**64 - 1)
ROWS_AT_ONCE, WORDS_AT_ONCE = 1 << 16, 1 << 13


def planes_of(fingerprints: np.ndarray, lane: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes (64 x words) and the mask of the lanes in use."""
    lanes = np.zeros((words * BITS, BITS), np.uint8)
    lanes[lane] = np.unpackbits(fingerprints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    used = np.zeros(words * BITS, np.uint8)
    used[lane] = 1
    return np.packbits(np.ascontiguousarray(lanes.T), axis=1, bitorder="little").view("<u8"), np.packbits(used, bitorder="little").view("<u8")


def near_lanes(planes: np.ndarray, word: np.ndarray, query: np.ndarray, wanted: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each (query, word): the wanted lanes within the radius, where there are any.

    Returns the positions of such rows and their lane masks.
    """
    high = radius.bit_length()
    counters = np.zeros((high, len(word)), np.uint64)
    beyond, at = ~wanted, np.arange(len(word))
    for bit in range(0, BITS, 2):
        first, second = (planes[b, word] ^ (np.uint64(0) - ((query >> np.uint64(b)) & np.uint64(1))) for b in (bit, bit + 1))
        if high:
            half = counters[0] ^ first
            carry = (counters[0] & first) | (half & second)
            counters[0] = half ^ second
            for k in range(1, high):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
        else:
            carry = first | second
        beyond = beyond | carry
        if bit % 8 == 6:
            live = beyond != ALL
            if not live.all():
                counters, beyond, at, word, query = counters[:, live], beyond[live], at[live], word[live], query[live]
                if not len(at):
                    break
    above, equal = np.zeros_like(beyond), np.full_like(beyond, ALL)
    for k in range(high - 1, -1, -1):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    near = ~(beyond | above)
    return at[near != 0], near[near != 0]


def near_pairs(fingerprints: np.ndarray, sizes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j within the radius inside each of the consecutive groups of the
    given sizes, a bounded number of comparisons at a time."""
    begins = np.concatenate([[0], np.cumsum(sizes)])
    n_words = -(-sizes // BITS)
    g = 0
    while g < len(sizes):
        h = max(g + 1, int(np.searchsorted(np.cumsum(n_words[g:]), WORDS_AT_ONCE, "right")) + g)
        own, base = fingerprints[begins[g] : begins[h]], begins[g]
        group = np.repeat(np.arange(h - g), sizes[g:h])
        place = np.arange(len(own)) - (begins[g:h] - base)[group]
        word_0 = np.concatenate([[0], np.cumsum(n_words[g:h])])
        lane = word_0[group] * BITS + place
        planes, used = planes_of(own, lane, int(word_0[-1]))
        index_of = np.zeros(int(word_0[-1]) * BITS, np.int64)
        index_of[lane] = np.arange(len(own)) + base
        rows = word_0[group + 1] - lane // BITS  # a query meets its own word and those after it
        ends = np.cumsum(rows)
        i = 0
        while i < len(own):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + ROWS_AT_ONCE, "right")))
            who = np.repeat(np.arange(i, j), rows[i:j])
            step = np.arange(len(who)) - np.repeat(ends[i:j] - rows[i:j] - (ends[i - 1] if i else 0), rows[i:j])
            word = lane[who] // BITS + step
            wanted = used[word] & np.where(step == 0, ALL << np.uint64(1) << (lane[who] % BITS).astype(np.uint64), ALL)
            at, near = near_lanes(planes, word, own[who], wanted, radius)
            if len(at):
                hit, bit = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                yield who[at[hit]] + base, index_of[word[at[hit]] * BITS + bit]
            i = j
        g = h


class Forest:
    """Union of index pairs, vectorised: each root is the smallest index of its tree."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            p = self.parent
            while not np.array_equal(q := p[p], p):
                p = q
            self.parent = p
            a, b = p[i], p[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if len(i):
                np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def roots(self) -> np.ndarray:
        p = self.parent
        while not np.array_equal(q := p[p], p):
            p = q
        return p

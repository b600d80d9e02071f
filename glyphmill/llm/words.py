"""Words and their hashes for whole Arrow columns at a time, by numpy over the joined bytes."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Inverse of BASE modulo 2^64.
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of `[^\x20\x09-\x0D]+`.
SOLID = np.ones(256, bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lowering A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: all bits of x reach all bits of the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of some texts: where they are, whose they are, and a 64-bit hash of each."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, inside: np.ndarray = ALNUM):
        """raw: the lowered bytes; off: where each text starts in them, and the end."""
        word = inside[raw]
        first = np.zeros(len(raw) + 1, bool)
        first[off[:-1]] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1] | first[1:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | first[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.raw, self.off = raw, off
        #: The first word of each text, and their number.
        self.first = np.searchsorted(self.start, off)
        self.text = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(len(raw), BASE), out=total[1:])
        self.hash = mixed((total[self.end] - total[self.start]) * powers(len(raw) + 1, BACK)[self.start] + (self.end - self.start).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.start)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each n words that follow one another in one text, and the index of the first of them."""
        if len(self) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        m = len(self) - n + 1
        out = np.zeros(m, np.uint64)
        for k in range(n):
            out = (out + self.hash[k : k + m]) * BASE
        at = np.flatnonzero(self.text[:m] == self.text[n - 1 :])
        return mixed(out[at]), at


def shingle_sets(raw: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct `n`-word shingles of each text, sorted, and where each text's begin; of fewer words, all are one shingle.

    Words are runs of SOLID bytes, A-Z lowered.
    """
    w = Words(LOWER[raw], off, SOLID)
    h, at = w.shingles(n)
    of, size = w.text[at], np.diff(w.first)
    few = np.flatnonzero((size > 0) & (size < n))
    if len(few):
        whole = np.zeros(len(few), np.uint64)
        for k in range(n - 1):
            on = size[few] > k
            whole[on] = (whole[on] + w.hash[w.first[few[on]] + k]) * BASE
        h, of = np.concatenate([h, mixed(whole + size[few].astype(np.uint64))]), np.concatenate([of, few])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])]) if len(h) else np.zeros(0, bool)
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(len(off)))


class Lookup:
    """Where 64-bit values stand in a sorted table of distinct ones; most that aren't there go by one small bitmap."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.map = np.zeros(1 << bits, bool)
        self.map[keys >> self.shift] = True

    def __call__(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the values that are there, and of their keys."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.flatnonzero(self.map[values >> self.shift])
        at = np.searchsorted(self.keys, values[near])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == values[near]
        return near[hit], at[hit]


def repeats(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... count[0] of them, then the same for the next."""
    total = int(count.sum())
    skip = np.repeat(np.cumsum(count) - count, count)
    return np.repeat(first, count) + np.arange(total) - skip

"""An FM-index over a sequence of integer symbols: suffix order, wavelet matrix, sampled suffix positions.

The sequence is a set of runs of symbols 1..sigma; a separator 0 ends each run and never matches. Suffixes
compare up to their run's separator, and separators compare by place, so the order is total. Positions are
sampled at multiples of ``step`` from the start of their run: a walk by LF never leaves its run.
"""

from __future__ import annotations

import numpy as np


def suffix_order(t: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. Rounds after the first sort only suffixes that still tie."""
    n = len(t)
    seps = t == 0
    n_seps = int(seps.sum())
    first = t.astype(np.int64) + n_seps - 1
    first[seps] = np.arange(n_seps)
    sa = np.argsort(first, kind="stable")
    heads = np.empty(n, bool)
    heads[:1] = True
    np.not_equal(first[sa][1:], first[sa][:-1], out=heads[1:])
    slot = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[sa] = slot
    rank[n] = -1
    k = 1
    ties = np.flatnonzero(~heads | np.append(~heads[1:], False))
    while len(ties):
        group, at = slot[ties], sa[ties]
        key = group * (n + 1) + rank[np.minimum(at + k, n)] + 1
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        sa[ties] = at
        new = np.empty(len(ties), bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        slot[ties] = ties[np.maximum.accumulate(np.where(new, np.arange(len(ties)), 0))]
        rank[at] = slot[ties]
        ties = ties[~(new & np.append(new[1:], True))]
        k *= 2
    return sa


class Bits:
    """A bit array with rank in constant time: 64-bit words and the count of ones before each."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n // 64 + 1) * 8, np.uint8)
        p = np.packbits(bits, bitorder="little")
        packed[: len(p)] = p
        self.words = packed.view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position ``i``."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)


class Wavelet:
    """A wavelet matrix: one level a bit, most significant first; zeros go before ones at each level."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.n, self.levels = len(values), []
        cur = values
        for bit in range(max(1, int(sigma).bit_length()) - 1, -1, -1):
            ones = (cur >> bit) & 1 == 1
            self.levels.append((bit, Bits(ones), self.n - int(ones.sum())))
            cur = np.concatenate([cur[~ones], cur[ones]])

    def rank(self, c: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """Occurrences of ``c`` before each place."""
        start, at = np.zeros(len(c), np.int64), [p.astype(np.int64) for p in places]
        for bit, bits, zeros in self.levels:
            one = (c >> bit) & 1 == 1
            r = bits.rank(start)
            start = np.where(one, zeros + r, start - r)
            for k, p in enumerate(at):
                r = bits.rank(p)
                at[k] = np.where(one, zeros + r, p - r)
        return [p - start for p in at]

    def get(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value at each place, and how often it occurs before it."""
        value, start, at = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), i.astype(np.int64)
        for bit, bits, zeros in self.levels:
            one = bits.get(at)
            value |= one.astype(np.int64) << bit
            r, s = bits.rank(at), bits.rank(start)
            at, start = np.where(one, zeros + r, at - r), np.where(one, zeros + s, start - s)
        return value, at - start


class FMIndex:
    def __init__(self, t: np.ndarray, sigma: int, step: int = 8):
        """``t``: runs of symbols 1..sigma, each ended by 0."""
        n = len(t)
        sa = suffix_order(t)
        self.n = n
        self.bwt = Wavelet(t[sa - 1].astype(np.int64), sigma)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=sigma + 1))])
        run_start = np.maximum.accumulate(np.where(np.concatenate([[True], t[:-1] == 0]), np.arange(n), 0))
        sampled = (np.arange(n) - run_start) % step == 0
        self.marks = Bits(sampled[sa])
        self.samples = sa[sampled[sa]]

    def search(self, symbols: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of the suffixes that start with ``symbols[start:start + width]`` (of 1..sigma) for each start, by backward search."""
        m = len(starts)
        lo, hi, live = np.zeros(m, np.int64), np.full(m, self.n, np.int64), np.arange(m)
        for k in range(width - 1, -1, -1):
            c = symbols[starts[live] + k].astype(np.int64)
            a, b = self.bwt.rank(c, lo[live], hi[live])
            lo[live], hi[live] = self.less[c] + a, self.less[c] + b
            dead = lo[live] >= hi[live]
            hi[live[dead]] = lo[live[dead]]
            live = live[~dead]
            if not len(live):
                break
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: LF steps back to a sampled position."""
        out, at, back, who = np.empty(len(rows), np.int64), rows.astype(np.int64), 0, np.arange(len(rows))
        while len(who):
            hit = self.marks.get(at)
            out[who[hit]] = self.samples[self.marks.rank(at[hit])] + back
            who, at, back = who[~hit], at[~hit], back + 1
            if len(who):
                c, before = self.bwt.get(at)
                at = self.less[c] + before
        return out

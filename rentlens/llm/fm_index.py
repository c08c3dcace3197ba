"""A compressed FM-index over integer symbols: wavelet tree, backward search, matching statistics.

Everything is vectorised over many patterns ("lanes") that advance by one
symbol at a time.  The collection is a list of segments; symbol 0 separates
them and never matches.
"""

from __future__ import annotations

import numpy as np


class BitRank:
    """A bit vector of 64-bit words with one running count per word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before position ``i``."""
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletTree:
    """Rank over a sequence of symbols, level by level from the highest bit; zeros go left at each level."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels: list[tuple[int, BitRank, int]] = []
        cur = values
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            b = ((cur >> bit) & 1).astype(np.uint8)
            self.levels.append((bit, BitRank(b), int(len(b) - b.sum())))
            cur = np.concatenate([cur[b == 0], cur[b == 1]])
        self.n = len(values)

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often ``symbol`` stands before ``lo`` and before ``hi``."""
        start = np.zeros_like(lo)
        for bit, ranks, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            s, a, b = ranks.ones(start), ranks.ones(lo), ranks.ones(hi)
            start = np.where(one, zeros + s, start - s)
            lo = np.where(one, zeros + a, lo - a)
            hi = np.where(one, zeros + b, hi - b)
        return lo - start, hi - start


class FMIndex:
    """FM-index of segments of symbols 1..sigma-1 for matches of up to ``depth`` symbols."""

    def __init__(self, segments: list[np.ndarray], sigma: int, depth: int):
        self.depth = depth
        sizes = np.array([len(s) for s in segments], np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes  # each segment stands after a separator
        n = int(sizes.sum() + len(segments) + 1)
        text = np.zeros(n, np.int64)
        for s, at in zip(segments, self.starts):
            text[at: at + len(s)] = s
        # ranks of all suffixes by their first 1, 2, 4, ... symbols, up to beyond the depth
        self._ranks = [text]
        span, rank = 1, text
        while span <= depth:
            shifted = np.zeros(n, np.int64)
            shifted[: n - span] = rank[span:] + 1
            pair = rank * (int(shifted.max()) + 1) + shifted
            order = np.argsort(pair, kind="stable")
            step = np.concatenate([[0], np.cumsum(pair[order][1:] != pair[order][:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = step
            span *= 2
            self._ranks.append(rank)
        self.suffix = np.argsort(rank, kind="stable")
        self.lcp = self._common()
        self._ranks = []
        bwt = text[self.suffix - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.tree = WaveletTree(bwt, sigma)
        self.n = n
        # minima of the lcp over blocks of 1, 2, 4, ... rows, to widen an interval
        self._low = [self.lcp]
        span = 1
        while span * 2 <= n:
            self._low.append(np.minimum(self._low[-1][:-span], self._low[-1][span:]))
            span *= 2

    def _common(self) -> np.ndarray:
        """Common symbols of each suffix and the one before it in order, up to the span that was sorted."""
        n = len(self.suffix)
        a, b = self.suffix[:-1].copy(), self.suffix[1:].copy()
        out = np.zeros(n - 1, np.int64)
        for level in range(len(self._ranks) - 1, -1, -1):
            span, rank = 1 << level, self._ranks[level]
            ok = (a < n) & (b < n)
            same = np.zeros(n - 1, bool)
            same[ok] = rank[a[ok]] == rank[b[ok]]
            out += np.where(same, span, 0)
            a, b = a + np.where(same, span, 0), b + np.where(same, span, 0)
        kind = np.uint8 if self.depth < 256 else np.int32  # nothing longer than the depth is asked for
        return np.concatenate([[0], np.minimum(out, np.iinfo(kind).max)]).astype(kind)

    def widen(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of all suffixes that share ``depth`` symbols with those in [lo, hi)."""
        lo, hi = lo.copy(), hi.copy()
        for level in range(len(self._low) - 1, -1, -1):
            span, low = 1 << level, self._low[level]
            at = lo - span + 1  # rows at..lo all continue the interval to the left
            ok = at >= 1  # the first row continues nothing
            ok[ok] = low[at[ok]] >= depth[ok]
            lo = np.where(ok, lo - span, lo)
            ok = hi + span <= self.n
            ok[ok] = low[hi[ok]] >= depth[ok]
            hi = np.where(ok, hi + span, hi)
        return lo, hi

    def matching_statistics(self, lanes: list[np.ndarray]):
        """For each position of each lane, from its end: (offset, active lanes, length, lo, hi).

        Length is the longest match, up to ``depth`` symbols, of the collection
        with the lane's symbols from that offset on; [lo, hi) are its suffixes.
        Unknown symbols are 0.
        """
        size = np.array([len(x) for x in lanes], np.int64)
        order = np.argsort(-size, kind="stable")
        width = int(size.max(initial=0))
        flat = np.zeros((len(lanes), width), np.int64)
        for row, i in enumerate(order):
            flat[row, width - size[i]:] = lanes[i]
        lo, hi = np.zeros(len(lanes), np.int64), np.full(len(lanes), self.n, np.int64)
        length = np.zeros(len(lanes), np.int64)
        for col in range(width - 1, -1, -1):
            k = int(np.searchsorted(-size[order], -(width - col), side="right"))  # lanes that reach this column
            c = flat[:k, col]
            todo = np.arange(k)
            while len(todo):
                sym, l0, h0, ln = c[todo], lo[todo], hi[todo], length[todo]
                full = ln >= self.depth  # keep one symbol fewer, so that the match stays within the depth
                if full.any():
                    w = self.widen(l0[full], h0[full], np.full(int(full.sum()), self.depth - 1))
                    l0[full], h0[full] = w
                    ln[full] = self.depth - 1
                r0, r1 = self.tree.rank(sym, l0, h0)
                found = (r1 > r0) & (sym > 0)
                at = todo[found]
                lo[at], hi[at] = self.before[sym[found]] + r0[found], self.before[sym[found]] + r1[found]
                length[at] = ln[found] + 1
                miss = ~found
                if not miss.any():
                    break
                dead = miss & ((ln == 0) | (sym == 0))
                at = todo[dead]
                lo[at], hi[at], length[at] = 0, self.n, 0
                retry = miss & ~dead
                todo2 = todo[retry]
                if len(todo2):  # to the parent: the longest shorter match with more suffixes
                    l1, h1 = l0[retry], h0[retry]
                    edge = np.zeros(len(l1), np.int64)
                    edge = np.maximum(edge, self.lcp[l1])
                    inside = h1 < self.n
                    edge[inside] = np.maximum(edge[inside], self.lcp[h1[inside]])
                    lo[todo2], hi[todo2] = self.widen(l1, h1, edge)
                    length[todo2] = edge
                todo = todo2
            yield col, order[:k], length[:k], lo[:k], hi[:k], width

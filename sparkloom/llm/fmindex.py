"""A compressed FM-index over texts of words: backward search on a Shannon-shaped wavelet tree, many patterns at a time.

Suffixes are sorted by as many words as the longest text has; a pattern lies within a text, so backward search needs no
more. The Burrows-Wheeler transform is held as a wavelet tree whose codes have ceil(log2(n / frequency)) bits,
so it takes about n (H0 + 1) bits, and a rank is one look-up and one population count a level. All steps are numpy
operations over whole arrays of patterns.
"""

from __future__ import annotations

import numpy as np

NONE = 1 << 40


class Wavelet:
    """Ranks of symbols in a sequence. Symbols are numbered by falling frequency, so by rising code length."""

    def __init__(self, seq: np.ndarray, counts: np.ndarray):
        n = len(seq)
        self.bits = np.maximum(1, np.ceil(np.log2(n / counts))).astype(np.int64)
        self.depth = int(self.bits[-1])
        width = np.left_shift(1, self.depth - self.bits)
        self.code = np.cumsum(width) - width
        before = np.concatenate([[0], np.cumsum(counts)])
        self.levels, first, node = [], 0, np.zeros(len(counts), np.int64)
        for at in range(self.depth):
            bit = (self.code[seq] >> (self.depth - 1 - at) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(bit) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            ones = np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)
            level = [first, words, ones, node, None]
            level[4] = self._ones(level, node)
            self.levels.append(level)
            # the elements whose codes go on, dealt to their nodes of the next level in stable order
            r1 = self._ones(level, np.arange(len(seq))) - level[4][seq - first]
            rank = np.where(bit, r1, np.arange(len(seq)) - node[seq - first] - r1)
            nxt = int(np.searchsorted(self.bits, at + 2))
            keep = seq >= nxt
            prefix = self.code[nxt:] >> (self.depth - at - 1)
            new = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]])) if len(prefix) else np.zeros(0, np.int64)
            starts = before[nxt:-1] - before[nxt]
            node = np.repeat(starts[new], np.diff(np.append(new, len(prefix))))
            moved = np.empty(int(keep.sum()), np.int64)
            moved[node[seq[keep] - nxt] + rank[keep]] = seq[keep]
            seq, first = moved, nxt

    @staticmethod
    def _ones(level: list, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return level[2][word] + np.bitwise_count(level[1][word] & mask)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        out, live = at.copy(), np.arange(len(at))
        for depth, level in enumerate(self.levels):
            live = live[symbols[live] >= level[0]]
            if not len(live):
                break
            s, pos = symbols[live], out[live]
            r1 = self._ones(level, level[3][s - level[0]] + pos) - level[4][s - level[0]]
            out[live] = np.where(self.code[s] >> (self.depth - 1 - depth) & 1, r1, pos - r1)
        return out


class FmIndex:
    """An index over ``texts`` (lists of words), each standing for ``weights`` equal ones."""

    def __init__(self, texts: list[list[bytes]], weights: np.ndarray):
        numbers: dict[bytes | None, int] = {None: 0}
        flat = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in (*t, None)), np.int64)
        counts = np.bincount(flat)
        order = np.argsort(-counts, kind="stable")
        symbol = np.empty_like(order)
        symbol[order] = np.arange(len(order))
        self.seq, self.size = symbol[flat], len(flat)
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        suffixes = self._suffixes(self.seq, int(self.lengths.max(initial=1)))
        self.first = np.concatenate([[0], np.cumsum(counts[order])])
        self.tree = Wavelet(self.seq[suffixes - 1], counts[order])
        weight = np.repeat(np.asarray(weights, np.int64), self.lengths + 1)[suffixes]
        self.weight = np.concatenate([[0], np.cumsum(weight)])

    @staticmethod
    def _suffixes(seq: np.ndarray, length: int) -> np.ndarray:
        """Places in the order of the next ``length`` symbols at least, by doubling."""
        rank, k = seq, 1
        while True:
            key = rank * (len(seq) + 1)
            key[: len(seq) - k] += rank[k:] + 1
            order = np.argsort(key)
            fresh = np.concatenate([[0], np.diff(key[order]) != 0])
            ranks = np.cumsum(fresh)
            rank = np.empty_like(ranks)
            rank[order] = ranks
            k *= 2
            if k >= length or ranks[-1] == len(seq) - 1:
                return order

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of patterns with one symbol more at their front."""
        got = self.first[symbols] + self.tree.rank(np.concatenate([symbols, symbols]), np.concatenate([lo, hi])).reshape(2, -1)
        return got[0], got[1]

    def repeated(self, window: int, least: int = 2) -> np.ndarray:
        """Where in the indexed texts a window of ``window`` words starts that stands in them at least ``least`` times.

        Every text is matched from its right end to the left, as far as the match occurs often enough. Where it breaks, at
        word p, no window over the broken match can occur; a short probe that starts right of p and grows until it breaks as
        well or spans all windows over p tells how far the next match may reach. Unrepeated text is thus left after a few
        words a window. A match that stands in its own text alone, and often enough there, does so for all that lies left of it.
        """
        marks, runs = np.zeros(self.size, bool), np.zeros(self.size + 1, np.int32)
        live = np.flatnonzero(self.lengths >= window)
        base, bound = self.starts[live], self.lengths[live].copy()
        end, at, probe = bound.copy(), bound.copy(), np.full(len(live), NONE)
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.size)
        while len(base):
            lo2, hi2 = self.extend(self.seq[base + at - 1], lo, hi)
            ok = self.weight[hi2] - self.weight[lo2] >= least
            at, lo, hi = np.where(ok, at - 1, at), np.where(ok, lo2, lo), np.where(ok, hi2, hi)
            alone = ok & (hi - lo == 1)
            np.add.at(runs, base[alone], 1)
            np.add.at(runs, (base + end)[alone] - window + 1, -1)
            # a probe that has passed its word: it spans all windows over it, or it grows and starts again
            passed = ok & (at == probe)
            whole = passed & (end == np.minimum(bound, probe + window))
            probe = np.where(whole, NONE, probe)
            grow = passed & ~whole
            hit = ok & ~grow & (end - at >= window)
            marks[(base + at)[hit]] = True
            # a break: windows over it are out; a match looks closer with a probe, a probe makes way for the next match
            bound = np.where(ok, bound, end - 1)
            new = ~ok & (probe == NONE)
            probe = np.where(new, at - 1, np.where(ok, probe, NONE))
            end = np.where(grow, np.minimum(np.minimum(bound, probe + window), 2 * end - probe), end)
            end = np.where(new, np.minimum(bound, probe + 4), np.where(~ok & ~new, bound, end))
            again = grow | ~ok
            at, lo, hi = np.where(again, end, at), np.where(again, 0, lo), np.where(again, self.size, hi)
            go = (bound >= window) & (again | (at > 0)) & ~alone
            if not go.all():
                base, bound, end, at, probe, lo, hi = (x[go] for x in (base, bound, end, at, probe, lo, hi))
        return marks | (np.cumsum(runs[:-1]) > 0)

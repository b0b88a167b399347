"""FM-index of word sequences: a wavelet matrix over the Burrows-Wheeler transform.

The index holds many short sequences.  Suffixes are ordered by their first
``DEPTH`` words, which is enough to search patterns of up to that many words.  Per
bit of the word numbers the wavelet matrix keeps packed bits and one rank sample
per 64 of them; a rank costs one popcount a level.  All searches are vectorised
over the streamed sequences.
"""
from __future__ import annotations

import numpy as np

#: Words by which suffixes are ordered (three-fold prefix ranks: 3, 9, 27, 81).
DEPTH = 81


class WaveletMatrix:
    """Rank queries over a sequence of numbers below 2**levels."""

    def __init__(self, seq: np.ndarray, levels: int):
        n = len(seq)
        self.levels, self.bits, self.ranks, self.zeros = levels, [], [], []
        for lev in range(levels - 1, -1, -1):
            bit = ((seq >> lev) & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[:len(raw)] = raw
            words = packed.view(np.uint64)
            self.bits.append(words)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int32)[:-1]]).astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def descend(self, value: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i arrives on the lowest level along the value's bits: the
        rank of the value in the first i entries, plus what position 0 arrives at."""
        for lev, bits, ranks, zeros in zip(range(self.levels - 1, -1, -1), self.bits, self.ranks, self.zeros):
            word = i >> 6
            low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = ranks[word] + np.bitwise_count(bits[word] & low)
            i = np.where((value >> lev) & 1, zeros + ones, i - ones)
        return i


class FMIndex:
    """Index over sequences of numbers 1 .. sigma - 1 (0 separates them), each with a
    weight: how often it stands in the corpus."""

    def __init__(self, seqs: np.ndarray, lengths: np.ndarray, weights: np.ndarray, sigma: int, window: int):
        """seqs: the concatenated sequences."""
        if not 27 < window <= 54:
            raise ValueError("windows of 28 to 54 words")
        self.window, self.sigma = window, sigma
        n = int(lengths.sum()) + len(lengths)
        text = np.zeros(n, np.int64)
        own = np.repeat(np.arange(len(lengths)), lengths)
        text[np.arange(len(seqs)) + own] = seqs
        owner = np.repeat(np.arange(len(lengths)), lengths + 1)
        rank, width = text, 1
        ranks27 = None
        while width < DEPTH:  # three prefix ranks make one of three times the width
            a = np.concatenate([rank[width:], np.zeros(min(width, n), np.int64)])[:n]
            b = np.concatenate([rank[2 * width:], np.zeros(min(2 * width, n), np.int64)])[:n]
            top = int(rank.max()) + 1
            if top ** 3 < 1 << 63:
                key = (rank * top + a) * top + b
                order = np.argsort(key, kind="stable")
                new = np.concatenate([[False], np.diff(key[order]) != 0])
            else:
                order = np.lexsort((b, a, rank))
                new = np.concatenate([[False], (np.diff(rank[order]) != 0) | (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            width *= 3
            if width == 27:
                ranks27 = rank
        bwt = text[order - 1]
        self.wavelet = WaveletMatrix(bwt, max(1, int(sigma - 1).bit_length()))
        values = np.arange(sigma)
        count = np.bincount(text, minlength=sigma)
        # first row of a value's suffixes, less where position 0 arrives
        self.base = np.cumsum(count) - count - self.wavelet.descend(values, np.zeros(sigma, np.int64))
        self.n = n
        self.upto = np.concatenate([[0], np.cumsum(weights[owner][order])])
        # rows whose first window - 1 words are equal form one run
        far = np.concatenate([ranks27, np.zeros(window, np.int64)])
        x, y = ranks27[order], far[order + window - 1 - 27]
        edge = np.concatenate([[True], (np.diff(x) != 0) | (np.diff(y) != 0)])
        starts = np.flatnonzero(edge)
        run = np.cumsum(edge) - 1
        self.run_start, self.run_end = starts[run], np.append(starts[1:], n)[run]

    def matches(self, seqs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For every word of the streamed sequences: the total weight of the places in
        the index where the window starting at it stands (0 near a sequence's end).

        Every sequence is read from its end.  A step puts one word before the
        current match; when the match has a window's length its weight is noted and
        its last word is dropped (all rows that share the other words).  When no row
        goes on, the last word of the failed match cannot be in any longer one:
        matching starts again at the word before it."""
        out = np.zeros(len(seqs), np.int64)
        first = np.cumsum(lengths) - lengths
        live = np.flatnonzero(lengths >= self.window)
        begin, at, depth = first[live], first[live] + lengths[live], np.zeros(len(live), np.int64)
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        while len(begin):
            value = seqs[at - 1]
            k = len(value)
            both = self.wavelet.descend(np.concatenate([value, value]), np.concatenate([lo, hi]))
            base = self.base[value]
            lo2, hi2 = base + both[:k], base + both[k:]
            ok = (hi2 > lo2) & (value > 0)
            end = at + depth
            at = np.where(ok, at - 1, end - 1)
            depth = np.where(ok, depth + 1, 0)
            lo, hi = np.where(ok, lo2, 0), np.where(ok, hi2, self.n)
            full = np.flatnonzero(depth == self.window)
            row = lo[full]
            out[at[full]] = self.upto[hi[full]] - self.upto[row]
            lo[full], hi[full] = self.run_start[row], self.run_end[row]
            depth[full] -= 1
            keep = at + depth - begin >= self.window  # a whole window still fits
            keep &= at > begin
            if not keep.all():
                begin, at, depth, lo, hi = begin[keep], at[keep], depth[keep], lo[keep], hi[keep]
        return out

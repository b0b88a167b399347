"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into overlapping pieces.  A piece of m characters that
occurs in a text with at most k edits shares at least m + 1 - q - k q character
q-grams with the occurrence, on diagonals (text position less piece position) that
lie within k of each other.  Shared q-grams are counted in overlapping bands of
2 (k + 1) diagonals; bands that reach the bound are verified by banded alignment
(edit distance of the whole piece, free start and end in the text).  Nothing that
the budget allows is missed.

Texts and items are compared with A-Z lowered and runs of white space as one
space; offsets refer to the characters of the original text.

Memory: benchmark items reach the workers in blocks of at most ``block_chars``
characters (one pass over the documents per block); q-grams of texts are hashed in
slices.  No document moves: documents are only mapped.

Cases: null or empty texts and items match nothing; items too short for any budget
are matched exactly; repeated items count as one each; repeated rows and null ids
are treated like any other row; empty tables give no hits.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.llm.common import prepare

SLICE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Not a character: separates texts, never equal to an item's character.
GAP = 0xFFFFFFFF
ORIGIN = 1 << 12
HITS = "array<struct<item_id: {kind}, start: long, stop: long, edits: int, pieces: int>>"


def codes_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points, and the original character position of each."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (c == 32) | ((c >= 9) & (c <= 13))
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[:1] = True
    c = np.where(space, np.uint32(32), np.where((c >= 65) & (c <= 90), c + np.uint32(32), c))
    at = np.flatnonzero(keep)
    return c[at], at


def grams(c: np.ndarray, q: int) -> np.ndarray:
    """Hash of every q-gram of code points, by doubling."""
    with np.errstate(over="ignore"):
        power, width, part = BASE, 1, c.astype(np.uint64) + np.uint64(1)
        out, done = None, 0
        n = len(c) - q + 1
        bits = q
        while bits:
            if bits & 1:
                piece = part[done:done + n]
                out = piece.copy() if out is None else out * power + piece
                done += width
            bits >>= 1
            if bits:
                part = part[:-width] * power + part[width:]
                power, width = power * power, 2 * width
        return (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


class PieceIndex:
    """Pieces of a block of benchmark items and their q-grams."""

    def __init__(self, items: list[tuple[object, str]], q: int, error: float, piece_chars: int):
        self.q, self.piece_chars = q, piece_chars
        self.items, self.pieces, self.owner, self.budget = [], [], [], []
        for item, text in items:
            c, _ = codes_of((text or "").strip())
            if not len(c):
                continue
            self.items.append(item)
            last = max(0, len(c) - piece_chars)
            for a in sorted({*range(0, last, piece_chars // 2), last}):
                p = c[a:a + piece_chars]
                self.pieces.append(p)
                self.owner.append(len(self.items) - 1)
                # the lemma's bound must stay positive
                self.budget.append(max(0, min(int(error * len(p)), (len(p) - q) // q)) if len(p) >= q else 0)
        self.pad = max(map(len, self.pieces), default=0) + 4 * (max(self.budget, default=0) + 2)
        long = [i for i, p in enumerate(self.pieces) if len(p) >= q]
        self.short = [i for i, p in enumerate(self.pieces) if len(p) < q]
        hashes = [grams(self.pieces[i], q) for i in long]
        h = np.concatenate([np.zeros(0, np.uint64), *hashes])
        piece = np.repeat(np.array(long, np.int64), [len(x) for x in hashes])
        pos = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(x)) for x in hashes]])
        order = np.argsort(h, kind="stable")
        self.grams, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.piece, self.pos = piece[order], pos[order]
        self.screen = np.zeros(1 << 22, bool)
        self.screen[(self.grams >> np.uint64(42)).astype(np.int64)] = True
        self.need = np.array([len(p) + 1 - q - k * q for p, k in zip(self.pieces, self.budget)], np.int64)
        self.k = np.array(self.budget, np.int64)

    def _shared(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text position, piece, piece position) of every shared q-gram."""
        found = []
        for a in range(0, len(c) - self.q + 1, SLICE):
            h = grams(c[a:a + SLICE + self.q - 1], self.q)
            at = np.flatnonzero(self.screen[(h >> np.uint64(42)).astype(np.int64)])
            slot = np.searchsorted(self.grams, h[at])
            slot[slot == len(self.grams)] = 0
            same = self.grams[slot] == h[at] if len(self.grams) else np.zeros(0, bool)
            at, slot = at[same] + a, slot[same]
            n = self.count[slot]
            rows = np.repeat(self.first[slot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append((np.repeat(at, n), self.piece[rows], self.pos[rows]))
        if not found:
            z = np.zeros(0, np.int64)
            return z, z, z
        return tuple(np.concatenate(x) for x in zip(*found))

    def candidates(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, lowest diagonal) of the bands that reach the lemma's bound."""
        at, piece, pos = self._shared(c)
        if not len(at):
            return at, at
        step = self.k[piece] + 1
        band = (at - pos) // step
        key = np.concatenate([piece * (1 << 40) + band + 1, piece * (1 << 40) + band])
        key, n = np.unique(key, return_counts=True)
        piece, band = key >> 40, (key & ((1 << 40) - 1)) - 1
        ok = n >= self.need[piece]
        return piece[ok], (band * (self.k[piece] + 1))[ok]

    def matches(self, c: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(piece, start, stop, edits) of verified occurrences in padded codes."""
        out = []
        piece, low = self.candidates(c)
        kinds = np.array([len(p) for p in self.pieces], np.int64)[piece] * (1 << 20) + self.k[piece] if len(piece) else piece
        for kind in np.unique(kinds):
            sel = np.flatnonzero(kinds == kind)
            for i in range(0, len(sel), 4096):
                s = sel[i:i + 4096]
                out += self._align(c, piece[s], low[s], int(kind & ((1 << 20) - 1)))
        for i in self.short:
            p = self.pieces[i]
            if len(c) >= len(p):
                w = np.flatnonzero((np.lib.stride_tricks.sliding_window_view(c, len(p)) == p).all(axis=1))
                out += [(i, int(x), int(x) + len(p), 0) for x in w]
        return out

    def _align(self, c: np.ndarray, piece: np.ndarray, low: np.ndarray, k: int) -> list[tuple[int, int, int, int]]:
        """Banded alignment of pieces of one length, all candidates at once.  A cell
        holds edits * ORIGIN + the diagonal where its path began."""
        pat = np.stack([self.pieces[p] for p in piece])
        m, width = pat.shape[1], 2 * (k + 1) + 2 * k
        start = low - k
        diag = np.arange(width)
        cost = np.tile(diag.astype(np.int32), (len(piece), 1))
        step = (diag * ORIGIN).astype(np.int32)
        big = np.int32(1 << 30)
        for j in range(m):
            text = np.take(c, start[:, None] + diag + j, mode="clip")
            new = cost + np.where(text != pat[:, j:j + 1], np.int32(ORIGIN), np.int32(0))
            up = np.concatenate([cost[:, 1:] + np.int32(ORIGIN), np.full((len(piece), 1), big)], axis=1)
            new = np.minimum(new, up)
            # runs of inserted text characters: prefix minimum after taking the steps out
            cost = np.minimum.accumulate(new - step, axis=1) + step
        best = cost.argmin(axis=1)
        value = cost[np.arange(len(piece)), best]
        edits, began = value // ORIGIN, value % ORIGIN
        return [(int(p), int(s + o), int(s + d + m), int(e))
                for p, s, o, d, e in zip(piece, start, began, best, edits) if e <= k]


def _hits(index: PieceIndex, texts: list[str]) -> list[list[dict]]:
    """Per text one entry per item: extent of its matched pieces, most edits of a
    piece, and how many pieces matched."""
    out: list[list[dict]] = [[] for _ in texts]
    group, size = [], 0
    for i, t in enumerate([*texts, None]):
        if group and (t is None or size + len(t) > SLICE):
            coded = [codes_of(texts[g]) for g in group]
            gap = np.full(index.pad, GAP, np.uint32)
            whole, starts, at = [gap], [], len(gap)
            for c, _ in coded:
                starts.append(at)
                whole += [c, gap]
                at += len(c) + len(gap)
            starts_a = np.array(starts)
            per: dict[tuple[int, int], list] = {}
            for piece, a, b, edits in index.matches(np.concatenate(whole)):
                g = int(np.searchsorted(starts_a, (a + b) // 2, side="right")) - 1
                c, where = coded[g]
                a, b = max(a - starts[g], 0), min(b - starts[g], len(c))
                x = per.setdefault((g, index.owner[piece]), [1 << 60, 0, 0, set()])
                x[0], x[1], x[2] = min(x[0], int(where[a])), max(x[1], int(where[b - 1]) + 1), max(x[2], edits)
                x[3].add(piece)
            for (g, item), (a, b, e, pieces) in sorted(per.items()):
                out[group[g]].append({"item_id": index.items[item], "start": a, "stop": b, "edits": e, "pieces": len(pieces)})
            group, size = [], 0
        if t:
            group.append(i)
            size += len(t) + index.pad
    return out


def _blocks(bench: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    """The items, in blocks of about ``block_chars`` characters."""
    b = bench.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("length(t) > 0")
    total = b.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    for k in range(n):
        yield [(r.i, r.t) for r in b.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k).orderBy("i", "t").collect()]


def with_hits(rows: DataFrame, bench: DataFrame, text: str, carry: str, item_col: str = "item_id",
              bench_text_col: str = "text", q: int = 10, error: float = 0.08, piece_chars: int = 80,
              block_chars: int = 4_000_000) -> DataFrame:
    """rows(carry, text) -> (carry, hits): ``hits`` lists the items found in the
    row's text, over all blocks."""
    kind = dict(bench.dtypes)[item_col]
    hit_type = HITS.format(kind=kind)
    out = rows.select(carry, F.col(text).cast("string").alias("__text"),
                      F.from_json(F.lit("[]"), hit_type).alias("hits"))
    for items in _blocks(bench, item_col, bench_text_col, block_chars):
        out = out.mapInArrow(_finder(items, q, error, piece_chars, carry), out.schema)
    return out.select(carry, "hits")


def _finder(items, q: int, error: float, piece_chars: int, carry: str):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = PieceIndex(items, q, error, piece_chars)
        for b in batches:
            texts = ["" if t is None else t for t in b.column(1).to_pylist()]
            new = [(old or []) + h for old, h in zip(b.column(2).to_pylist(), _hits(index, texts))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(new, b.schema.field(2).type)],
                                             [carry, "__text", "hits"])
    return find


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document row and benchmark item found in it: doc_id, item_id,
    start and stop (characters), edits (most of any matched piece), pieces."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = with_hits(rows, bench, "text", "doc_id", **options)
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all their columns, that hold no benchmark item."""
    prepare(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    return with_hits(rows, bench, "text", "row", **options).where(F.size("hits") == 0).select("row.*")


"""Packing documents into windows by non-negative least squares over length classes.

A document is its token ids and an end id.  Its whole windows are sequences by
themselves; what is left (its tail) falls into one of ``WINDOW / CLASS`` classes
of length.  All combinations of up to ``DEPTH`` classes whose upper lengths fill a
window exactly are enumerated, and non-negative least squares finds how often each
is used so that the classes' counts are met; the counts are rounded down (and
scaled where a class would be overdrawn).  Tails in a solved combination stay
whole; what the combination leaves free, up to a class width a tail, is a hole.
The residual tails lie on one line, greedily cut to fill first the holes, then
windows of their own; the line's last window is cut to powers of two, which need
no padding.

Only the class histogram (one row a class) and the solved counts are on the
driver, both bounded by the window.  Ranks of tails within a class, places on the
line and numbers of sequences are prefix sums in two levels: inside the task that
tokenised a document, and over the tasks.  A class holding a third of all rows is
dealt by (task, class).

Memory: a worker holds one text and a bounded memo of words; a stretch of the line
is ``STRETCH`` tokens with the holes it fills.

Cases: null and empty texts are the end id alone; repeated rows are packed each;
null ids stay null; an empty table gives no rows; extra columns are ignored.
"""
from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsight.llm.common import materialise, prepare, texts_of

WINDOW = 2048
#: Width of a length class in tokens, and pieces in a combination at most.
CLASS, DEPTH = 16, 4
#: Tokens of the line that one task cuts.
STRETCH = 1 << 15
#: Words in the young half of the memo; the old half is what was young before.
MEMO_WORDS = 700_000
#: Longer words are encoded but not remembered.
MEMO_BYTES = 64
WORDS_AT_ONCE = 8192
#: Between a letter and these a word ends whatever stands around them.
PUNCTUATION = b".,;:!?"

# ------------------------------------------------------------------ token ids


class Encoder:
    """One worker's tokenizer and its memo: word to ids, as little-endian bytes."""

    def __init__(self, path: str, words_apart: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.words_apart = words_apart
        mark = self.ids("\0")
        self.mark = mark[0] if len(mark) == 1 else None
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word: many words in one call, a NUL between two of them."""
        if self.mark is None or any(b"\0" in w for w in words):
            return [self.ids(w.decode()).tobytes() for w in words]
        got = self.ids(b" \0 ".join(words).decode())
        raw, size = got.tobytes(), self.kind.itemsize
        ends = np.flatnonzero(got == self.mark).tolist() + [len(got)]
        return [raw[(a + 1) * size:b * size] for a, b in zip([-1, *ends], ends)]

    def _learn(self, words: set[bytes]) -> list[bytes]:
        """Put words into the memo; returns what was put in.  A word that ends in a letter
        and punctuation is made of the two, so that only its letters are encoded."""
        memo, old = self.memo, self.old
        made, new = {}, set()
        for w in words:
            if w in old:
                memo[w] = old[w]
                continue
            stem = w.rstrip(PUNCTUATION)
            if len(stem) < len(w) and stem[-1:].islower():  # of bytes: a to z
                made[w] = stem, w[len(stem):]
                new.update(p for p in made[w] if p not in memo)
            else:
                new.add(w)
        todo = list(new)
        for i in range(0, len(todo), WORDS_AT_ONCE):
            some = todo[i:i + WORDS_AT_ONCE]
            memo.update(zip(some, self._words(some)))
        memo.update({w: memo[a] + memo[b] for w, (a, b) in made.items()})
        return [*todo, *made]

    def encode(self, texts: list[bytes], end: int) -> list[np.ndarray]:
        last = np.array([end], self.kind)
        if not self.words_apart:
            return [np.concatenate([self.ids(t.decode()), last]) for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.old = {}, self.memo
        memo, end_bytes = self.memo, last.tobytes()
        # the tokenizer lowers letters itself, but not in its special strings
        cut = [(t if b"<|" in t else t.lower()).split() for t in texts]
        got = [list(map(memo.get, ws)) for ws in cut]
        unknown = [list(compress(range(len(ws)), map(not_, ids))) for ws, ids in zip(cut, got)]
        new = self._learn({ws[i] for ws, at in zip(cut, unknown) for i in at})
        for ws, ids, at in zip(cut, got, unknown):
            for i in at:
                ids[i] = memo[ws[i]]
        for w in new:
            if len(w) > MEMO_BYTES:
                del memo[w]
        return [np.frombuffer(b"".join(ids) + end_bytes, self.kind) for ids in got]


@functools.lru_cache(maxsize=2)
def _encoder(path: str, words_apart: bool) -> Encoder:
    return Encoder(path, words_apart)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def crc(ids: np.ndarray) -> int:
    """CRC-32 of the ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenised(docs: DataFrame, path: str, words_apart: bool, end: int, window: int, width: int) -> DataFrame:
    """A row per document: the task (pid) and number (row) it got, ids, whole windows
    (their CRCs, and how many the task had before: full_before), the tail's length,
    class and CRC, and how many tails of that class the task had before (rank)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pid = _encoder(path, words_apart), TaskContext.get().partitionId()
        seen = np.zeros(window // width + 1, np.int64)
        row = full_before = 0
        for b in batches:
            texts, at = texts_of(b.column(1)), 0
            while at < len(texts):  # some MB of text at once
                n, size = 0, 0
                while at + n < len(texts) and (not n or size < 2 << 20):
                    size, n = size + len(texts[at + n]), n + 1
                out = {c: [] for c in ("row", "ids", "doc_tokens", "full_crcs", "full_before", "tail", "cls", "rank", "tail_crc")}
                for ids in enc.encode(texts[at:at + n], end):
                    whole = len(ids) // window * window
                    tail = len(ids) - whole
                    cls = -(-tail // width)
                    values = (row, ids.tobytes(), len(ids), [crc(ids[i:i + window]) for i in range(0, whole, window)],
                              full_before, tail, cls, int(seen[cls]), crc(ids[whole:]))
                    for c, v in zip(out.values(), values):
                        c.append(v)
                    seen[cls] += 1
                    row, full_before = row + 1, full_before + whole // window
                types = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, n), pa.array([pid] * n, pa.int32()), *[pa.array(c, t) for c, t in zip(out.values(), types)]],
                    ["doc_id", "pid", *out])
                at += n
    return docs.mapInArrow(run, f"doc_id {kind}, pid int, row long, ids binary, doc_tokens long, full_crcs array<long>, "
                                "full_before long, tail int, cls int, rank long, tail_crc long")


# ---------------------------------------------------------------------- solve


def combinations(classes: int, depth: int) -> np.ndarray:
    """All ways to write `classes` as a sum of at most `depth` classes, largest first,
    filled up with 0."""
    out: list[tuple] = []

    def grow(head: tuple, left: int, most: int) -> None:
        if left == 0:
            out.append(head + (0,) * (depth - len(head)))
        elif len(head) < depth:
            for c in range(min(left, most), -(-left // (depth - len(head))) - 1, -1):
                grow((*head, c), left - c, c)
    grow((), classes, classes)
    return np.array(out, np.int64)


def nnls(combos: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Repeats x >= 0 of the combinations that minimise |A x - counts|, A counting the
    classes of each (class 0 is none): active sets, so that few repeats are positive."""
    n, rows = len(combos), len(counts)

    def column(i: int) -> np.ndarray:
        c = np.bincount(combos[i], minlength=rows).astype(float)
        c[0] = 0
        return c
    target = counts.astype(float)
    target[0] = 0
    x, chosen, cols = np.zeros(n), [], np.zeros((rows, 0))
    residual, tolerance = target.copy(), 1e-9 * max(1.0, target.max())
    for _ in range(3 * rows):
        residual[0] = 0
        gain = residual[combos].sum(axis=1)
        gain[chosen] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= tolerance:
            break
        chosen.append(best)
        cols = np.column_stack([cols, column(best)])
        while True:
            s = np.linalg.lstsq(cols, target, rcond=None)[0]
            if (s > 0).all():
                break
            now = x[chosen]
            down = np.flatnonzero(s <= 0)
            step = float(np.min(now[down] / np.maximum(now[down] - s[down], 1e-300)))
            now = now + step * (s - now)
            x[chosen] = now
            stay = now > tolerance
            x[[c for c, k in zip(chosen, stay) if not k]] = 0
            chosen, cols = [c for c, k in zip(chosen, stay) if k], cols[:, stay]
            if not chosen:
                s = np.zeros(0)
                break
        x[:] = 0
        x[chosen] = s
        residual = target - cols @ s
    return x


def solve(counts: np.ndarray, tokens: np.ndarray, window: int = WINDOW, width: int = CLASS, depth: int = DEPTH) \
        -> tuple[np.ndarray, np.ndarray]:
    """(combinations, whole repeats): no class is overdrawn, and the tails left over hold
    about as many tokens as the combinations leave free."""
    combos = combinations(window // width, depth)
    x = nnls(combos, counts)
    combos, x = combos[x > 0], x[x > 0]
    mean = tokens / np.maximum(counts, 1)
    share = 1.0
    while len(x):
        use = lambda r: np.bincount(combos.ravel(), np.repeat(r, depth), len(counts)) * (np.arange(len(counts)) > 0)
        ratio = np.minimum(1, counts / np.maximum(use(x), 1e-9))
        ratio[0] = 1
        repeats = np.floor(share * x * ratio[combos].min(axis=1) + 1e-9).astype(np.int64)
        used = use(repeats)
        free = window * repeats.sum() - (used * mean).sum()
        if (tokens - used * mean)[1:].sum() >= free or not repeats.any():
            return combos[repeats > 0], repeats[repeats > 0]
        share *= 0.99
    return combos, x.astype(np.int64)


# ----------------------------------------------------------------------- pack


@dataclass
class Packing:
    """pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, pid, row;
    tokens: the documents' ids by (pid, row)."""
    pieces: DataFrame
    tokens: DataFrame
    window: int
    kind: str

    def sequences(self, pad: int = 0) -> DataFrame:
        """(sequence_id, ids): the windows themselves, padded unless a power of two long."""
        kind, window = np.dtype(self.kind), self.window

        def assemble(t: pa.Table) -> pa.Table:
            t = t.sort_by("offset")
            ids = np.concatenate([np.frombuffer(x, kind)[s:s + n] for x, s, n in
                                  zip(*(t.column(c).to_pylist() for c in ("ids", "start", "length")))]).astype(np.int64)
            if len(ids) & (len(ids) - 1):
                ids = np.concatenate([ids, np.full(window - len(ids), pad)])
            return pa.table({"sequence_id": t.column("sequence_id").slice(0, 1), "ids": pa.array([ids], pa.list_(pa.int64()))})
        cut = self.pieces.join(self.tokens.select("pid", "row", "ids"), ["pid", "row"])
        return cut.select("sequence_id", "offset", "ids", "start", "length").groupBy("sequence_id") \
            .applyInArrow(assemble, "sequence_id long, ids array<long>")


def _running(df: DataFrame, group: str, order: str, value: str, out: str) -> tuple[DataFrame, int]:
    """(df with `out` = sum of `value` over the rows before in (group, order), the whole
    sum): sums inside each group, and over the groups' totals."""
    parts = df.groupBy(group).agg(F.sum(value).alias("_t"))
    before = parts.select(group, F.coalesce(F.sum("_t").over(
        Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.join(before, group).withColumn(out, F.col("_b") + inside).drop("_b"), parts.agg(F.sum("_t")).first()[0] or 0


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1,
         window: int = WINDOW, width: int = CLASS, depth: int = DEPTH, words_apart: bool = True) -> Packing:
    """Pack all documents.  words_apart: the tokenizer lowers letters, drops white space and
    never looks across it or from a letter to a punctuation mark, so that words can be
    encoded one by one (true of the default's rules); otherwise whole texts are encoded."""
    spark = docs.sparkSession
    prepare(spark)
    path = tokenizer or default_tokenizer()
    sel = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tokens = materialise(_tokenised(sel, path, words_apart, end_id, window, width), "tokenised")
    kind = Encoder(path, words_apart).kind

    # whole windows: sequences 0, 1, ...
    fulls = tokens.groupBy("pid").agg(F.sum(F.size("full_crcs")).alias("n")).select("pid", F.col("n").cast("long"))
    over = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    first_full = fulls.select("pid", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("at"))
    n_full = fulls.agg(F.sum("n")).first()[0] or 0
    whole = tokens.where(F.size("full_crcs") > 0).select("doc_id", "pid", "row", "doc_tokens", "full_before", "full_crcs") \
        .join(first_full, "pid").select("*", F.posexplode("full_crcs").alias("i", "ids_crc32"))
    span = lambda df, start, length, seq, offset: df.select(
        "doc_id", F.expr(start).cast("long").alias("start"), F.expr(length).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        F.expr(seq).cast("long").alias("sequence_id"), F.expr(offset).cast("long").alias("offset"), "pid", "row")
    whole = span(whole, f"i * {window}L", str(window), "at + full_before + i", "0")

    # the histogram, and the repeats of each combination
    tails = tokens.where("cls > 0").select("doc_id", "pid", "row", "doc_tokens", "tail", "cls", "rank", "tail_crc")
    cells = materialise(tails.groupBy("pid", "cls").agg(F.count("*").alias("n"), F.sum("tail").alias("size")), "cells")
    counts, sizes = np.zeros(window // width + 1, np.int64), np.zeros(window // width + 1, np.int64)
    for c, n, size in cells.groupBy("cls").agg(F.sum("n"), F.sum("size")).collect():  # a row a class
        counts[c], sizes[c] = n, size
    combos, repeats = solve(counts, sizes, window, width, depth)
    used = np.bincount(combos.ravel(), np.repeat(repeats, depth), len(counts)).astype(np.int64)
    used[0] = 0
    n_solved = int(repeats.sum())

    # ranks within a class name the combination's slot that a tail fills
    w = Window.partitionBy("cls").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    at = cells.select("pid", "cls", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    ranked = tails.join(at, ["pid", "cls"]).withColumn("rank", F.col("before") + F.col("rank")).drop("before")
    quota = F.element_at(F.array(*[F.lit(int(u)) for u in used]).cast("array<long>"), F.col("cls") + 1)
    placed = materialise(_slots(ranked.where(F.col("rank") < quota), combos, repeats, n_full), "slots")
    by_slot = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    solved = materialise(placed.withColumn("offset", F.coalesce(F.sum("tail").over(by_slot), F.lit(0)).cast("long")), "solved")

    # holes and the line of residual tails
    holes = solved.where("last and offset + tail < %d" % window).select(
        "sequence_id", (F.col("offset") + F.col("tail")).alias("from"), (window - F.col("offset") - F.col("tail")).alias("free"))
    holes, n_free = _running(holes.withColumn("lot", F.floor(F.col("sequence_id") / 8192)), "lot", "sequence_id", "free", "at")
    rest, n_line = _running(ranked.where(F.col("rank") >= quota), "pid", "row", "tail", "at")
    filled = _cut_line(rest, tokens, holes, n_free, n_line, n_full + n_solved, window, kind)

    solved = span(solved.withColumnRenamed("tail_crc", "ids_crc32"), "doc_tokens - tail", "tail", "sequence_id", "offset")
    return Packing(whole.unionByName(solved).unionByName(filled), tokens, window, kind.str)


def _slots(tails: DataFrame, combos: np.ndarray, repeats: np.ndarray, first: int) -> DataFrame:
    """tails with the sequence and slot that their rank within the class comes to."""
    seq_of = first + np.cumsum(repeats) - repeats
    lists: dict[int, list[tuple]] = {}
    for c, (combo, n) in enumerate(zip(combos.tolist(), repeats.tolist())):
        parts = [p for p in combo if p]
        for slot, p in enumerate(parts):
            lists.setdefault(p, []).append((n, int(seq_of[c]), slot, slot + 1 == len(parts)))
    names = [f.name for f in tails.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {p: [np.array(x) for x in zip(*rows)] for p, rows in lists.items()}
        for b in batches:
            cls, rank = (b.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("cls", "rank"))
            seq, slot, last = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int32), np.zeros(len(cls), bool)
            for p in np.unique(cls).tolist():
                here = np.flatnonzero(cls == p)
                n, first_seq, slots, ends = table[p]
                upto = np.cumsum(n)
                i = np.searchsorted(upto, rank[here], "right")
                seq[here] = first_seq[i] + rank[here] - (upto - n)[i]
                slot[here], last[here] = slots[i], ends[i]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq), pa.array(slot), pa.array(last)],
                                             [*names, "sequence_id", "slot", "last"])
    kinds = ", ".join(f"{n} {t}" for n, t in tails.dtypes)
    return tails.mapInArrow(run, f"{kinds}, sequence_id long, slot int, last boolean")


def _cut_line(rest: DataFrame, tokens: DataFrame, holes: DataFrame, n_free: int, n_line: int, first: int, window: int, kind) -> DataFrame:
    """Pieces of the residual tails: cut where holes, windows and the last window's powers
    of two begin.  A stretch of the line holds the tails that begin in it and the holes
    that they can reach."""
    last = n_free + max(0, n_line - n_free) // window * window  # where the last, partial window begins
    n_windows = (last - n_free) // window
    left, ends, p = max(0, n_line - last), [], last
    while left:
        size = 1 << (left.bit_length() - 1)
        ends.append((p, size))
        p, left = p + size, left - size
    id_type = dict(rest.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, pid int, row long"
    tail_at = (F.col("doc_tokens") - F.col("tail")) * kind.itemsize
    with_ids = tokens.select("pid", "row", F.substring("ids", (tail_at + 1).cast("int"), (F.col("tail") * kind.itemsize).cast("int")).alias("ids"))
    docs = rest.join(with_ids, ["pid", "row"]).withColumn("stretch", F.floor(F.col("at") / STRETCH).cast("long"))
    reach = holes.withColumn("stretch", F.explode(F.sequence(
        F.greatest(F.lit(0), F.floor((F.col("at") - window) / STRETCH)).cast("long"),
        F.floor((F.col("at") + F.col("free") - 1) / STRETCH).cast("long"))))

    def cut(t: pa.Table, h: pa.Table) -> pa.Table:
        h = h.sort_by("at")
        h_at, h_seq, h_from = (h.column(c).to_numpy().astype(np.int64) for c in ("at", "sequence_id", "from"))
        cols = [t.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "tail", "at", "ids", "pid", "row")]
        out = []
        for doc_id, doc_tokens, tail, at, ids, pid, row in zip(*cols):
            ids, p = np.frombuffer(ids, kind), at
            while p < at + tail:
                if p < n_free:
                    i = int(np.searchsorted(h_at, p, "right")) - 1
                    upto = int(h_at[i + 1]) if i + 1 < len(h_at) else n_free
                    seq, offset = int(h_seq[i]), int(h_from[i]) + p - int(h_at[i])
                elif p < last:
                    i = (p - n_free) // window
                    upto, seq, offset = n_free + (i + 1) * window, first + i, (p - n_free) % window
                else:
                    i = max(j for j, (a, _) in enumerate(ends) if a <= p)
                    a, size = ends[i]
                    upto, seq, offset = a + size, first + n_windows + i, p - a
                n = min(upto, at + tail) - p
                out.append((doc_id, doc_tokens - tail + p - at, n, crc(ids[p - at:p - at + n]), doc_tokens, seq, offset, pid, row))
                p += n
        kinds = (t.schema.field("doc_id").type, *[pa.int64()] * 6, pa.int32(), pa.int64())
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "pid", "row")
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 9, kinds)], names=list(names))
    return docs.groupBy("stretch").cogroup(reach.groupBy("stretch")).applyInArrow(cut, schema)

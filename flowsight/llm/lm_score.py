"""Language-model scores from log-frequency Bloom filters.

Training counts every word exactly (a table in the shared folder), and every bigram
seen at least twice, whatever its words: the kept bigrams grow with the corpus.  All
their counts are read from log-frequency Bloom filters: a count of c is the level
1 + floor(log_b(c / 2)), and the pairs (bigram, 1) .. (bigram, level) are members; a
count is read by probing levels until one is missing.  Bigrams whose relative
frequency is at least ``1 / bigram_rate`` are in one filter that is broadcast.  The
others are dealt by key hash to filters of bounded size, one a shard; texts are
taken in chunks, and a chunk's distinct bigrams, held-out ones too, go to the shards
once, in packed blocks with their counts in training texts: a shard adds up the
counts, fills its filter and reads it for the bigrams of the blocks.  The levels read
come back to the chunk, where the sums are made.
The read count is the lower end of its level, so that with the absolute discount the
mass of a history's bigrams stays below one and the rest of it is spread by the
smoothed unigram:

    P(w | h) = max(count(h, w) - d, 0) / c(h) + left(h) * P1(w)
    P1(w)    = (c(w) + 0.1) / (N + 0.1 (V + 1))

Broadcast sizes are bounded by the rates, whatever the corpus: at most
``word_rate`` words have a relative frequency of 1 / word_rate or more, and at most
``bigram_rate`` bigrams one of 1 / bigram_rate.  A chunk's distinct rare words are
dealt to shards of the exact counts and met there as words; in the bigrams they are
62-bit digests.  A bigram or word reaches its shard once a chunk, however often the
chunk has it, so no key is hot.

Cases: null and empty texts are one end token; with no training text every
probability is 1 (0.1 / 0.1); rows count as training if ``held_out`` is false or
null; repeated rows are each scored (and each learnt from); an empty table gives no
rows; extra columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsight.llm.common import groups_of, materialise, parts_for, prepare, release, texts_of

#: The end token; no word is empty.
END = b""
ADD = 0.1
DISCOUNT = 0.75
LEVEL_BASE = 1.5
FALSE_POSITIVES = 1e-9
FLUSH_WORDS = 250_000
#: Bigrams seen less often are not kept; the first level of the read counts.
LEAST = 2
#: Tokens whose bigrams make a shard, and distinct words of a shard of their counts.
SHARD_TOKENS = 2_000_000
SHARD_WORDS = 250_000
#: Bytes of text in a chunk.
CHUNK_BYTES = 3 << 20
#: Keys probed at a time: their places stay in the processor's cache.
PROBED = 1 << 15
#: A probe asks one 64-bit cell for this many bits; with CELL_SHARE bits of the filter
#: a probe, a key that is not a member passes it once in 2^7.5 times.
CELL_BITS = 6
CELL_SHARE = 15
#: The patterns of bits that are asked for.
PATTERNS = np.bitwise_or.reduce(np.uint64(1) << np.argsort(
    np.random.default_rng(6).random((1 << 14, 64)), axis=1)[:, :CELL_BITS].astype(np.uint64), axis=1)


def tokens_of(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class LogFrequencyFilter:
    """Quantised counts of uint64 keys behind membership probes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, least: float, base: float = LEVEL_BASE,
                 error: float = FALSE_POSITIVES):
        self.least, self.base = float(least), base
        level = self.level(counts)
        self.top = int(level.max()) if len(level) else 0
        self.probes = max(1, round(-np.log2(error) / 7.5))
        self.cells = np.zeros(max(64, -(-int(level.sum()) * self.probes * CELL_SHARE // 64)), np.uint64)
        for k in range(1, self.top + 1):
            a, b = self._starts(keys[level >= k], k)
            for _ in range(self.probes):
                np.bitwise_or.at(self.cells, self._place(a), self._pattern(a))
                a = self._next(a, b)

    @classmethod
    def stored(cls, cells: bytes, bits: int, top: int, least: float, base: float = LEVEL_BASE,
               error: float = FALSE_POSITIVES) -> LogFrequencyFilter:
        """A filter from its cells."""
        f = cls(np.zeros(0, np.uint64), np.zeros(0), least, base, error)
        f.cells, f.top = np.frombuffer(cells, np.uint64, bits // 64), top
        return f

    @property
    def bits(self) -> int:
        return 64 * len(self.cells)

    def level(self, counts: np.ndarray) -> np.ndarray:
        return 1 + np.floor(np.log(counts / self.least) / np.log(self.base) + 1e-9).astype(np.int64)

    def value(self, level: np.ndarray) -> np.ndarray:
        """The least count of a level; 0 for level 0."""
        return np.where(level > 0, self.least * self.base ** (level - 1.0), 0.0)

    @staticmethod
    def _starts(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            x = _mix(keys + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))
        return x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

    def _place(self, a: np.ndarray) -> np.ndarray:
        """The cell of a key's state, one of fewer than 2^32."""
        return (a.astype(np.uint64) * np.uint64(len(self.cells)) >> np.uint64(32)).view(np.int64)

    @staticmethod
    def _pattern(a: np.ndarray) -> np.ndarray:
        """The bits of a key's state, by its lower digits; the cell is by its upper ones."""
        return PATTERNS[a & np.uint32(len(PATTERNS) - 1)]

    @staticmethod
    def _next(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A congruential step: no b makes a key's places fall together, as a plain
        sum of steps would in small filters."""
        with np.errstate(over="ignore"):
            return a * np.uint32(0x9E3779B1) + b

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level 1, 2, .. are probed until one is missing; a key leaves a level at its
        first missing pattern."""
        level = np.zeros(len(keys), np.uint8)
        for first in range(0, len(keys), PROBED):
            part = keys[first:first + PROBED]
            live = np.arange(len(part))
            for k in range(1, self.top + 1):
                a, b = self._starts(part[live], k)
                for _ in range(self.probes):
                    asked = self._pattern(a)
                    hit = self.cells[self._place(a)] & asked == asked
                    if not hit.all():
                        live, a, b = live[hit], a[hit], b[hit]
                    a = self._next(a, b)
                if not len(live):
                    break
                level[first + live] = k
        return level

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Quantised counts."""
        return self.value(self.levels(keys))


# --------------------------------------------------------------------- chunks

def _packed(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x)


def _unpacked(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def _planes(x: np.ndarray, width: int = 8) -> bytes:
    """The bytes of whole numbers, the lowest ones first, compressed."""
    return _packed(np.ascontiguousarray(x, f"<i{width}").view(np.uint8).reshape(-1, width).T.tobytes())


def _numbers(block: bytes, width: int = 8) -> np.ndarray:
    x = np.frombuffer(_unpacked(block), np.uint8).reshape(width, -1).T
    return np.ascontiguousarray(x).view(f"<i{width}").ravel().astype(np.int64, copy=False)


class _Numbers(dict):
    """Numbers of the frequent words; a chunk's other words get the next ones."""

    def __init__(self, words: dict[bytes, int]):
        super().__init__(words)
        self.after = len(words) + 1
        self.rare: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = self.after + len(self.rare)
        self.rare.append(word)
        return n

    def taken(self) -> list[bytes]:
        """The rare words so far; they are forgotten."""
        rare, self.rare = self.rare, []
        for x in rare:
            del self[x]
        return rare


def _chunks(rows: DataFrame, words: dict[bytes, int], kind: str) -> DataFrame:
    """Texts in chunks of about CHUNK_BYTES: ids, marks, sizes (tokens), the tokens'
    numbers and how many they are.  Number len(words) is the start of a text; the chunk's rare words
    follow it, in the order of ``rare`` and of their digests.  Must be written before use."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers(shared.value)
        get = numbers.__getitem__
        chunk = TaskContext.get().partitionId() << 40
        for b in batches:
            for a, group in groups_of(texts_of(b.column(1)), CHUNK_BYTES):
                flat: list[bytes] = []
                sizes = []
                for t in group:
                    d = tokens_of(t)
                    flat += d
                    sizes.append(len(d))
                w = np.fromiter(map(get, flat), np.int64, len(flat))
                rare = numbers.taken()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk]), *[pa.array([b.column(i).slice(a, len(group)).to_pylist()], pa.list_(b.schema.field(i).type))
                                          for i in (0, 2)],
                     pa.array([_planes(np.array(sizes))], pa.binary()), pa.array([_planes(w, 4)], pa.binary()),
                     pa.array([_packed(b"\n".join(rare))], pa.binary()),
                     pa.array([_planes(np.array([_number(x) for x in rare], np.int64))], pa.binary()), pa.array([len(flat)])],
                    ["chunk", "ids", "held", "sizes", "numbers", "rare", "digests", "tokens"])
                chunk += 1
    return rows.select("doc_id", "text", "held_out").mapInArrow(
        run, f"chunk long, ids array<{kind}>, held array<boolean>, sizes binary, numbers binary, rare binary, digests binary, tokens long")


def _pairs(sizes: np.ndarray, w: np.ndarray, start: int) -> np.ndarray:
    """Bigrams of a chunk, history << 32 | word."""
    h = np.roll(w, 1)
    h[np.cumsum(sizes) - sizes] = start
    return h << 32 | w


def _global(pairs: np.ndarray, digests: bytes, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Histories and words by numbers that hold for all chunks."""
    number = np.concatenate([np.arange(start + 1), _numbers(digests)])
    return number[pairs >> 32], number[pairs & 0xFFFFFFFF]


def _runs(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([np.ones(len(x[:1]), bool), x[1:] != x[:-1]]))


def _deal(shards: int, h: np.ndarray, w: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Shard and indices of its bigrams, those of frequent words first."""
    shard = (_pair_keys(h, w) % np.uint64(shards)).astype(np.min_scalar_type(2 * shards))
    order = np.argsort(shard * 2 + ((h < 0) | (w < 0)), kind="stable")  # small numbers are sorted by their digits
    shard = shard[order]
    at = _runs(shard)
    for s, a, z in zip(shard[at].tolist(), at.tolist(), [*at.tolist()[1:], len(order)]):
        yield s, order[a:z]


def _pack(h: np.ndarray, w: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Dealt bigrams: the ascending ones of frequent words as differences, the rest
    as they are."""
    n = int(((h >= 0) & (w >= 0)).sum())
    return _planes(np.diff(h[:n] << 32 | w[:n], prepend=0)), _planes(h[n:]), _planes(w[n:])


def _unpack(known: bytes, h: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray]:
    p = np.cumsum(_numbers(known))
    return np.concatenate([p >> 32, _numbers(h)]), np.concatenate([p & 0xFFFFFFFF, _numbers(w)])


# ------------------------------------------------------------------- training

def _word_counts(rows: DataFrame) -> DataFrame:
    """(word, c) over the training rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()),
                                               pa.array(list(seen.values()), pa.int64())], ["word", "c"])
        for b in batches:
            for t in texts_of(b.column(0)):
                seen.update(tokens_of(t))
                if len(seen) > FLUSH_WORDS:
                    yield out()
                    seen.clear()
        yield out()
    return rows.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _number(word: bytes) -> int:
    """A rare word's (negative) number in the bigrams."""
    return -1 - (int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") >> 2)


def _pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _mix(w.astype(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)))


def _read(counts: np.ndarray) -> np.ndarray:
    """What the filters read for exact counts of at least LEAST."""
    return LEAST * LEVEL_BASE ** np.floor(np.log(counts / LEAST) / np.log(LEVEL_BASE) + 1e-9)


def _kept(chunks: DataFrame, start: int, pair_words: int, least: float, shards: int) -> DataFrame:
    """The bigrams seen at least LEAST times, per shard: per history the discounted
    mass of its bigrams (h, used); the frequent ones (h, w, c); and what the filter of
    the others reads for the distinct bigrams of each chunk, in the order they were
    dealt (shard, chunk, levels)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, held, sizes, w, digests in zip(*(b.column(i).to_pylist() for i in range(5))):
                sizes = _numbers(sizes)
                # in ascending order, a bigram's places in training texts first
                p = np.sort(_pairs(sizes, _numbers(w, 4), start) << 1 | np.repeat(np.array(held, bool), sizes))
                first = _runs(p >> 1)
                c = np.add.reduceat(1 - (p & 1), first)
                h, w = _global(p[first] >> 1, digests, start)
                out = [(s, chunk, *_pack(h[at], w[at]), _planes(c[at], 4)) for s, at in _deal(shards, h, w)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["shard", "chunk", "known", "h", "w", "c"])

    def meet(t: pa.Table) -> pa.Table:
        keys, h, w, c, sizes = _blocks(t)
        order = np.argsort(keys)
        keys = keys[order]
        first = _runs(keys)
        keys = keys[first]
        c = np.add.reduceat(c[order], first, dtype=np.int64)
        at, seen = order[first][c >= LEAST], c[c >= LEAST]
        h, w = h[at], w[at]
        top = (seen >= least) & _in_filter(h, w, start, pair_words)
        f = LogFrequencyFilter(keys[c >= LEAST][~top], seen[~top].astype(float), LEAST)
        levels = np.empty(len(order), np.uint8)
        levels[order] = np.repeat(f.levels(keys), np.diff(first, append=len(order)))
        hist, back = np.unique(h, return_inverse=True)
        used = np.bincount(back, _read(seen) - DISCOUNT, minlength=len(hist)).astype(float)
        none = [pa.nulls(len(hist), pa.int64())] * 2
        mass = pa.table([pa.array(hist), *none, pa.array(used)], ["h", "w", "c", "used"])
        often = pa.table({"h": h[top], "w": w[top], "c": seen[top].astype(np.int64)})
        read = pa.table({"shard": t.column("shard"), "chunk": t.column("chunk"),
                         "levels": pa.array([_packed(x.tobytes()) for x in np.split(levels, np.cumsum(sizes)[:-1])], pa.binary())})
        return pa.concat_tables([mass, often, read], promote_options="default") \
            .select(["h", "w", "c", "used", "shard", "chunk", "levels"])
    return chunks.select("chunk", "held", "sizes", "numbers", "digests") \
        .mapInArrow(run, "shard long, chunk long, known binary, h binary, w binary, c binary").groupBy("shard") \
        .applyInArrow(meet, "h long, w long, c long, used double, shard long, chunk long, levels binary")


def _blocks(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Keys, histories, words and counts of a shard's blocks, and the blocks' sizes."""
    c = [_numbers(x.as_py(), 4).astype(np.int32) for x in t.column("c")]
    sizes = [len(x) for x in c]
    c = np.concatenate(c)
    h, w, keys = (np.empty(len(c), kind) for kind in (np.int64, np.int64, np.uint64))
    a = 0
    for n, *block in zip(sizes, *(t.column(x) for x in ("known", "h", "w"))):
        z = a + n
        h[a:z], w[a:z] = _unpack(*(x.as_py() for x in block))
        keys[a:z] = _pair_keys(h[a:z], w[a:z])
        a = z
    return keys, h, w, c, sizes


def _in_filter(h: np.ndarray, w: np.ndarray, start: int, pair_words: int) -> np.ndarray:
    """Bigrams of the broadcast filter's words; with rates that leave frequent bigrams
    to rarer words, these stay in the shards."""
    return ((h == start) | ((h >= 0) & (h < pair_words))) & (w >= 0) & (w < pair_words)


class Model:
    """What is broadcast: frequent words with their counts, the mass that each leaves
    as a history for the unigram (the start of a text last), and the filter of the
    frequent bigrams."""

    def __init__(self, counts: dict[bytes, int], n: int, v: int, n_texts: int, pair_words: int):
        # the first pair_words of the (descending) counts are those of the filter
        self.words = {w: i for i, w in enumerate(counts)}
        self.n, self.v, self.pair_words = n, v, pair_words
        self.count = np.append(np.array(list(counts.values()), float), n_texts)
        self.left = np.ones(len(self.count))
        self.start = len(counts)
        self.filter = LogFrequencyFilter(np.zeros(0, np.uint64), np.zeros(0), LEAST)

    def p1(self, c):
        return (c + ADD) / (self.n + ADD * (self.v + 1))

    def levels(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Levels of bigrams in the broadcast filter."""
        out = np.zeros(len(h), np.uint8)
        at = np.flatnonzero(_in_filter(h, w, self.start, self.pair_words))
        out[at] = self.filter.levels(_pair_keys(h[at], w[at]))
        return out

    def log_p(self, count: np.ndarray, left: np.ndarray, h: np.ndarray, w: np.ndarray, level: np.ndarray) -> np.ndarray:
        """log10 P(w | h) - log10 P1(w) by counts and left masses of all numbers."""
        seen = np.maximum(self.filter.value(level) - DISCOUNT, 0.0)
        return np.log10(left[h] + seen / np.maximum(count[h], 1.0) / self.p1(count[w]))


def _left(used, count):
    return np.clip(1 - used / np.maximum(count, 1), 1e-9, 1.0)


def _rare_words(counts: DataFrame, kept: DataFrame, least: float, shards: int) -> DataFrame:
    """(word_shard, word, c, left) of the words that are not broadcast."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = np.array([_number(x) for x in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(number % shards), b.column(0), pa.array(number), b.column(1)],
                                             ["word_shard", "word", "number", "c"])
    words = counts.where(F.col("c") < least).mapInArrow(run, "word_shard long, word binary, number long, c long")
    used = kept.where("h < 0 and used is not null").groupBy(F.col("h").alias("number")).agg(F.sum("used").alias("used"))
    left = F.greatest(1 - F.coalesce("used", F.lit(0.0)) / F.col("c"), F.lit(1e-9))
    return words.join(used, "number", "left").select("word_shard", "word", "c", left.alias("left"))


# -------------------------------------------------------------------- scoring

def _word_answers(chunks: DataFrame, rare_words: DataFrame, shards: int) -> DataFrame:
    """Per chunk and shard of words: which of the chunk's rare words are known (at),
    their counts and left masses."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, rare, digests in zip(*(b.column(i).to_pylist() for i in range(3))):
                shard, rare = _numbers(digests) % shards, _unpacked(rare).split(b"\n")
                order = np.argsort(shard, kind="stable")
                used, first = np.unique(shard[order], return_index=True)
                out = [(s, chunk, _packed(b"\n".join([rare[i] for i in order[a:z].tolist()])), _planes(np.diff(order[a:z], prepend=0)))
                       for s, a, z in zip(used.tolist(), first.tolist(), [*first.tolist()[1:], len(order)])]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["word_shard", "chunk", "words", "at"])

    def meet(asked: pa.Table, table: pa.Table) -> pa.Table:
        word = {x: i for i, x in enumerate(table.column("word").to_pylist())}
        c, left = (np.append(table.column(x).to_numpy(), 0) for x in ("c", "left"))
        out = []
        for chunk, words, at in zip(*(asked.column(x).to_pylist() for x in ("chunk", "words", "at"))):
            i = np.array([word.get(x, -1) for x in _unpacked(words).split(b"\n")], np.int64)
            at = np.cumsum(_numbers(at))[i >= 0]
            i = i[i >= 0]
            out.append((chunk, _planes(np.diff(at, prepend=0)), _planes(c[i]), _packed(left[i].astype("<f8").tobytes())))
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["chunk", "at", "c", "left"]) if out else \
            pa.table([pa.array([], k) for k in kinds], ["chunk", "at", "c", "left"])
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    asked = chunks.select("chunk", "rare", "digests").mapInArrow(run, "word_shard long, chunk long, words binary, at binary")
    return asked.groupBy("word_shard").cogroup(rare_words.groupBy("word_shard")) \
        .applyInArrow(meet, "chunk long, at binary, c binary, left binary")


def _sums(chunks: DataFrame, answers: DataFrame, model: Model, shards: int, kind: str) -> DataFrame:
    """Per text its sums, made in its chunk."""
    shared = chunks.sparkSession.sparkContext.broadcast(model)

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        m = shared.value
        sizes, w, digests = (chunk.column(x)[0].as_py() for x in ("sizes", "numbers", "digests"))
        sizes, w, rare = _numbers(sizes), _numbers(w, 4), len(_numbers(digests))
        count = np.concatenate([m.count, np.zeros(rare)])
        left = np.concatenate([m.left, np.ones(rare)])
        levels = {}
        for a in answers.to_pylist():
            if a["levels"] is not None:
                levels[a["shard"]] = np.frombuffer(_unpacked(a["levels"]), np.uint8)
                continue
            at = m.start + 1 + np.cumsum(_numbers(a["at"]))
            count[at], left[at] = _numbers(a["c"]), np.frombuffer(_unpacked(a["left"]), "<f8")
        pairs, back = np.unique(_pairs(sizes, w, m.start), return_inverse=True)
        h, v = _global(pairs, digests, m.start)
        level = m.levels(h, v)
        for s, at in _deal(shards, h, v):
            level[at] = np.maximum(level[at], levels[s])  # a bigram is in one of the filters
        gain = m.log_p(count, left, pairs >> 32, pairs & 0xFFFFFFFF, level)[back]
        first = np.cumsum(sizes) - sizes
        base = np.add.reduceat(np.log10(m.p1(count))[w], first)
        return pa.table([chunk.column("ids").combine_chunks().flatten(), chunk.column("held").combine_chunks().flatten(), pa.array(sizes),
                         pa.array(np.add.reduceat(known_words(count)[w], first)), pa.array(np.full(len(sizes), m.n)),
                         pa.array(base), pa.array(base + np.add.reduceat(gain, first))],
                        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def known_words(count: np.ndarray) -> np.ndarray:
        return (count > 0).astype(np.int64)
    return chunks.drop("rare", "tokens").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
          word_rate: int = 500_000, bigram_rate: int = 100_000) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score.  ``held_out`` is an expression over doc_id; rows where it is true are
    scored but not learnt from."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    kind = dict(rows.dtypes)["doc_id"]
    counts = materialise(_word_counts(rows.where(~F.col("held_out"))), "lm-counts")
    r = counts.agg(F.sum("c"), F.count("*"), F.max(F.when(F.length("word") == 0, F.col("c")))).first()
    n, v, n_texts = int(r[0] or 0), int(r[1]), int(r[2] or 0)
    often = max(1, n / word_rate)
    frequent = counts.where(F.col("c") >= often).orderBy(F.desc("c"), "word").collect()  # at most word_rate words
    words = {bytes(x.word): x.c for x in frequent}
    least = max(LEAST, n / bigram_rate)
    model = Model(words, n, v, n_texts, sum(c >= least for c in words.values()))
    chunks = materialise(_chunks(rows, model.words, kind), "lm-chunks")
    tokens = chunks.agg(F.sum("tokens")).first()[0] or 0
    shards, word_shards = parts_for(tokens, SHARD_TOKENS), parts_for(v, SHARD_WORDS)
    kept = materialise(_kept(chunks, model.start, model.pair_words, least, shards), "lm-pairs")
    release(rows.sparkSession)
    top = kept.where("c is not null").select("h", "w", "c").collect()  # at most bigram_rate bigrams
    h, w, c = (np.array([x[i] for x in top], np.int64) for i in range(3))
    model.filter = LogFrequencyFilter(_pair_keys(h, w), c.astype(float), LEAST)
    used = kept.where("h >= 0 and used is not null").groupBy("h").agg(F.sum("used").alias("used")).collect()
    for u in used:  # at most word_rate words and the start
        model.left[u.h] = _left(u.used, model.count[u.h])
    known = materialise(_word_answers(chunks, _rare_words(counts, kept, often, word_shards), word_shards), "lm-words")
    release(rows.sparkSession)
    read = kept.where("levels is not null").select("chunk", "shard", "levels")
    return _sums(chunks, read.unionByName(known, allowMissingColumns=True), model, shards, kind)

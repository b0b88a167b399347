"""Removal of repeated passages with a compressed FM-index per shard.

A window is ``window`` consecutive words of a text; a word goes if a window that
covers it also starts anywhere else, in the same text or another.

Windows are dealt to shards by content, so that equal windows meet and no text is
searched in every shard: a window's anchor is the least hashed ``gram`` words in it
(leftmost on ties), and the shard follows the anchor's hash.  Neighbouring windows
share anchors, so a text falls into segments of windows with one anchor.  Anchors
seen once in the corpus cannot belong to a repeated window and are left out (first
shuffle: hashes only).  Each shard builds an FM-index over the distinct words
sequences of its segments and streams the segments through it: backward search over
the wavelet matrix gives every window's number of places, and windows with two or
more are marked.  Words are compared as such; hashes only decide what meets.

A shard holds about ``shard_segments`` segments.  Anchors that stand in more
segments than that (a line in a third of all texts) never reach a shard: equal
segments become one row with a weight (partial sums before the shuffle), and the
windows of distinct segments are counted by a 256-bit digest of their words.  Texts
with the same words are sent once, with their number as a weight.

Cases: null and empty texts have no words; fewer words than a window lose nothing;
repeated rows are copies of each other like any texts; an empty table gives no rows;
extra columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.llm.common import groups_of, map_batches, materialise, parts_for, prepare, texts_of
from flowsight.llm.fm_index import FMIndex

#: Bytes hashed at a time, and words whose anchors are searched at a time.
BYTES = 1 << 20
WORDS = 1 << 22
INDEX_BITS = 24
#: Bytes of text cut into segments at a time.
GROUP_BYTES = 1 << 23
_POWER = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""
    with np.errstate(over="ignore"):
        while len(_POWER[0]) < n:
            for i, m in ((0, _ODD), (1, _ODD_INVERSE)):
                step = np.uint64(pow(m, len(_POWER[i]), 1 << 64))
                _POWER[i] = np.concatenate([_POWER[i], _POWER[i] * step])
    return _POWER


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word of a text of words and single spaces."""
    if not text:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64)
    buf = np.frombuffer(text, np.uint8)
    gaps = np.flatnonzero(buf == 32)
    start, end = np.concatenate([[0], gaps + 1]), np.append(gaps, len(buf))
    out = np.empty(len(start), np.uint64)
    a = 0
    with np.errstate(over="ignore"):
        while a < len(start):
            b = max(a + 1, int(np.searchsorted(end, start[a] + BYTES, side="right")))
            lo, hi = int(start[a]), int(end[b - 1])
            power, inverse = _powers(hi - lo + 1)
            part = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf[lo:hi].astype(np.uint64) + np.uint64(1)) * power[:hi - lo])])
            s, e = start[a:b] - lo, end[a:b] - lo
            out[a:b] = (part[e] - part[s]) * inverse[s]
            a = b
    return start, end, _mix(out)


def _rolled(x: np.ndarray, k: int, join) -> np.ndarray:
    """join over every k neighbours, by doubling; join(left, right, right's width)."""
    out, done, part, width = None, 0, x, 1
    n = len(x) - k + 1
    while k:
        if k & 1:
            piece = part[done:done + n]
            out = piece if out is None else join(out, piece, width)
            done += width
        k >>= 1
        if k:
            part = join(part[:-width], part[width:], width)
            width *= 2
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(_rolled(words, k, lambda a, b, w: a * np.uint64(pow(_ODD, w, 1 << 64)) + b))


def segments(words: np.ndarray, lengths: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Over concatenated texts: first and last window (word index) of every segment,
    the word index of its anchor and the anchor's hash."""
    own = np.repeat(np.arange(len(lengths)), lengths)
    found = []
    for a in range(0, max(0, len(words) - window + 1), WORDS):
        part = words[a:a + WORDS + window - 1]
        g = gram_hashes(part, gram)
        low = np.uint64((1 << INDEX_BITS) - 1)
        key = (g & ~low) | np.arange(len(g), dtype=np.uint64)
        least = _rolled(key, window - gram + 1, lambda x, y, _: np.minimum(x, y))
        at = (least & low).astype(np.int64)
        inside = own[a:a + len(at)] == own[a + window - 1:a + window - 1 + len(at)]
        w = np.flatnonzero(inside)
        if not len(w):
            continue
        cut = np.concatenate([[True], (np.diff(at[w]) != 0) | (np.diff(w) != 1)])
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(w)) - 1
        anchor = at[w[first]]
        found.append((w[first] + a, w[last] + a, anchor + a, g[anchor]))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _plain(text: bytes) -> bytes:
    return b" ".join(text.split())


def _key(plain: bytes) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.sha256(plain).digest()[:16], np.int64).tolist())


def _prepared(group: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Non-empty plain texts joined; word starts, ends, hashes; words per text."""
    joined = b" ".join([t for t in group if t])
    start, end, h = word_hashes(joined)
    return joined, start, end, h, np.array([t.count(b" ") + 1 if t else 0 for t in group], np.int64)


# --------------------------------------------------------------- text passes

def _anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(row, k1, k2, hashes, places): one row per text with a whole window; its
    anchors' hashes, each once, with the word positions where it stands.  Written before
    use, so that ``row`` is fixed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for _, group in groups_of([_plain(t) for t in texts_of(b.column(0))], GROUP_BYTES):
                _, _, _, h, n = _prepared(group)
                first, _, at, hashes = segments(h, n, window, gram)
                begin = np.cumsum(n) - n
                # a segment's text is the one its first window starts in
                own = np.searchsorted(begin, first, side="right") - 1 if len(first) else first
                while len(own) and (n[own] == 0).any():
                    own = np.where(n[own] == 0, own - 1, own)
                place = at - begin[own] if len(own) else at
                order = np.lexsort((place, hashes, own))
                own, hashes, place = own[order], hashes[order], place[order]
                head = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 0) | (np.diff(hashes) != 0)])[:len(own)])
                inner = pa.array(np.append(head, len(own)), pa.int32())
                have, count = np.unique(own[head], return_counts=True)
                outer = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
                keys = [_key(group[i]) for i in have.tolist()]
                places = pa.ListArray.from_arrays(inner, pa.array(place, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + len(have))), pa.array([k[0] for k in keys], pa.int64()),
                     pa.array([k[1] for k in keys], pa.int64()),
                     pa.ListArray.from_arrays(outer, pa.array(hashes[head].view(np.int64))),
                     pa.ListArray.from_arrays(outer, places)], ["row", "k1", "k2", "hashes", "places"])
                row += len(have)
    return docs.select("text").mapInArrow(run, "row long, k1 long, k2 long, hashes array<long>, places array<array<long>>")


def _keyed(docs: DataFrame, kind: str) -> DataFrame:
    """(doc_id, k1, k2, n_words, z): words of every text, compressed."""
    def one(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3)
        plain = [_plain(t) for t in texts_of(b.column(1))]
        keys = [_key(t) for t in plain]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
             pa.array([t.count(b" ") + 1 if t else 0 for t in plain], pa.int64()),
             pa.array([c.compress(t) for t in plain], pa.binary())], ["doc_id", "k1", "k2", "n_words", "z"])
    return map_batches(docs.select("doc_id", "text"), one, f"doc_id {kind}, k1 long, k2 long, n_words long, z binary")


def _suspects(anchors: DataFrame, crowd: int) -> DataFrame:
    """(k1, k2, cold, hot): places of the anchors that stand in several segments of
    the corpus; hot ones in more than ``crowd``."""
    each = anchors.select("row", F.explode(F.arrays_zip("hashes", "places")).alias("a")) \
        .select("row", F.col("a.hashes").alias("h"), F.col("a.places").alias("p"))
    seen = each.groupBy("h").agg(F.sum(F.size("p")).alias("c")).where("c > 1")
    per_row = each.join(seen, "h").groupBy("row").agg(
        F.flatten(F.collect_list(F.when(F.col("c") <= crowd, F.col("p")))).alias("cold"),
        F.flatten(F.collect_list(F.when(F.col("c") > crowd, F.col("p")))).alias("hot"))
    # texts with the same words have the same anchors: any row speaks for them
    one = anchors.groupBy("k1", "k2").agg(F.min("row").alias("row"))
    return per_row.join(one, "row").select("k1", "k2", "cold", "hot")


PACKED = ("shard int, k1 binary, k2 binary, first binary, copies binary, z binary, "
          "hot_k1 long, hot_k2 long, hot_copies long, hot_firsts array<long>")


def _cut(suspects: DataFrame, shards: int, window: int, gram: int) -> DataFrame:
    """Suspect segments of distinct texts.  Shards from 0 on: packed by shard.  Shard
    -1: one row per text and distinct segment with a hot anchor; ``hot_firsts`` its
    places, ``z`` the digests of its windows, joined."""
    names = [x.split()[0] for x in PACKED.split(", ")]
    kinds = [pa.int32(), *[pa.binary()] * 5, *[pa.int64()] * 3, pa.list_(pa.int64())]

    def one(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        d, c = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        cols = {f.name: b.column(i) for i, f in enumerate(b.schema)}
        k1, k2, copies = (cols[x].to_numpy(zero_copy_only=False) for x in ("k1", "k2", "copies"))
        cold, hot = cols["cold"].to_pylist(), cols["hot"].to_pylist()
        texts = [d.decompress(z) for z in cols["z"].to_pylist()]
        for base, group in groups_of(texts, GROUP_BYTES):
            joined, start, end, h, n = _prepared(group)
            begin = np.cumsum(n) - n
            first, last, at, hashes = segments(h, n, window, gram)
            own = np.searchsorted(begin, first, side="right") - 1
            shard = np.full(len(first), -2, np.int64)
            for places, code in ((cold, 0), (hot, -1)):
                marks = np.concatenate([np.zeros(0, np.int64), *[np.array(places[base + i], np.int64) + begin[i]
                                                                 for i in range(len(group)) if places[base + i]]])
                chosen = np.isin(at, marks)
                shard[chosen] = (_mix(hashes[chosen]) % np.uint64(shards)).astype(np.int64) if code == 0 else -1
            out = []
            order = np.argsort(shard, kind="stable")
            order = order[np.searchsorted(shard[order], 0):]
            edges = [*np.flatnonzero(np.diff(shard[order], prepend=-9)).tolist(), len(order)]
            for x, y in zip(edges[:-1], edges[1:]):
                sel = order[x:y]
                part = base + own[sel]
                body = b"\n".join([joined[s:e] for s, e in zip(start[first[sel]].tolist(), end[last[sel] + window - 1].tolist())])
                out.append((int(shard[sel[0]]), *[v.astype(np.int64).tobytes() for v in
                            (k1[part], k2[part], first[sel] - begin[own[sel]], copies[part])], c.compress(body), None, None, None, None))
            alike: dict[tuple[int, bytes], list[int]] = {}
            for i in np.flatnonzero(shard == -1).tolist():
                alike.setdefault((int(own[i]), joined[start[first[i]]:end[last[i] + window - 1]]), []).append(i)
            for (text, _), sel in alike.items():
                w = range(int(first[sel[0]]), int(last[sel[0]]) + 1)
                z = b"".join([hashlib.sha256(joined[start[k]:end[k + window - 1]]).digest() for k in w])
                out.append((-1, None, None, None, None, z, int(k1[base + text]), int(k2[base + text]),
                            int(copies[base + text]), (first[sel] - begin[text]).tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names)
    return map_batches(suspects, one, PACKED)


def search_shard(texts: list[bytes], copies: np.ndarray, window: int) -> np.ndarray:
    """For every segment the bit mask of its windows that stand in several places
    of the shard."""
    seen: dict[bytes, int] = {}
    which = np.array([seen.setdefault(t, len(seen)) for t in texts], np.int64)
    weight = np.bincount(which, copies, minlength=len(seen)).astype(np.int64)
    length = np.array([t.count(b" ") + 1 for t in seen], np.int64)
    words = b" ".join(seen).split()
    number = {w: i for i, w in enumerate(dict.fromkeys(words), 1)}
    seqs = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    index = FMIndex(seqs, length, weight, len(number) + 1, window)
    mask = np.where(weight > 1, (np.int64(1) << (length - window + 1)) - 1, 0)  # copies: every window repeats
    single = np.flatnonzero(weight == 1)
    if len(single):
        begin = np.cumsum(length) - length
        n = length[single]
        take = np.repeat(begin[single], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hits = np.flatnonzero(index.matches(seqs[take], n) > 1)
        own = np.repeat(np.arange(len(single)), n)[hits]
        bit = hits - (np.cumsum(n) - n)[own]
        np.bitwise_or.at(mask, single[own], np.int64(1) << bit)
    return mask[which]


def _searched(packed: DataFrame, window: int) -> DataFrame:
    """(k1, k2, firsts, mask) of the segments with repeated windows."""
    def run(t: pa.Table) -> pa.Table:
        d = zstandard.ZstdDecompressor()
        texts = [s for z in t.column("z").to_pylist() for s in d.decompress(z).split(b"\n")]
        cols = {n: np.frombuffer(b"".join(t.column(n).to_pylist()), np.int64) for n in ("k1", "k2", "first", "copies")}
        mask = search_shard(texts, cols["copies"], window)
        hit = mask != 0
        firsts = pa.ListArray.from_arrays(pa.array(np.arange(hit.sum() + 1), pa.int32()), pa.array(cols["first"][hit]))
        return pa.table([pa.array(cols["k1"][hit]), pa.array(cols["k2"][hit]), firsts, pa.array(mask[hit])],
                        names=["k1", "k2", "firsts", "mask"])
    return packed.where("shard >= 0").select("shard", "k1", "k2", "first", "copies", "z").groupBy("shard") \
        .applyInArrow(run, "k1 long, k2 long, firsts array<long>, mask long")


def _hot_segments(packed: DataFrame) -> DataFrame:
    """(k1, k2, firsts, mask) of the segments with hot anchors.  Equal segments are one
    row with a weight before their windows are counted, and a segment that repeats as a
    whole has all its windows repeated; only the windows of the others are looked up."""
    hot = packed.where("shard = -1").select(F.col("hot_k1").alias("k1"), F.col("hot_k2").alias("k2"),
                                            F.col("hot_firsts").alias("firsts"), "z",
                                            (F.size("hot_firsts") * F.col("hot_copies")).alias("c"))
    distinct = hot.groupBy("z").agg(F.sum("c").alias("c"))

    def one(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        z, c = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)
        n = [len(x) // 32 for x in z]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[j:j + 32] for x in z for j in range(0, len(x), 32)], pa.binary()), pa.array(np.repeat(c, n)),
             pa.array([s for x, k in zip(z, n) for s in [hashlib.sha256(x).digest()] * k], pa.binary()),
             pa.array([j for k in n for j in range(k)], pa.int32())], ["w", "c", "s", "i"])
    windows = map_batches(distinct, one, "w binary, c long, s binary, i int")
    often = windows.groupBy("w").agg(F.sum("c").alias("n")).where("n > 1").select("w")
    partly = windows.where("c = 1").join(often, "w").groupBy("s").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i"))).alias("mask"))
    size = (F.length("z") / 32).cast("int")
    whole = distinct.where("c > 1").select(
        F.unhex(F.sha2("z", 256)).alias("s"),
        (F.call_function("shiftleft", F.lit(1).cast("long"), size) - 1).alias("mask"))
    return hot.withColumn("s", F.unhex(F.sha2("z", 256))).join(partly.unionByName(whole), "s") \
        .select("k1", "k2", "firsts", "mask")


def _covered(n: int, marks: list[dict], window: int) -> np.ndarray:
    """True for the words covered by marked windows."""
    first = np.array([f for m in marks for f in m["firsts"]], np.int64)
    mask = np.repeat(np.array([m["mask"] for m in marks], np.int64), [len(m["firsts"]) for m in marks])
    change = np.zeros(n + 1, np.int64)
    for bit in range(int(mask.max()).bit_length()):
        s = first[(mask >> bit) & 1 == 1] + bit
        np.add.at(change, s, 1)
        np.add.at(change, s + window, -1)
    return np.cumsum(change[:-1]) > 0


def _kept(joined: DataFrame, window: int, kind: str, with_text: bool) -> DataFrame:
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def one(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        removed, digest, spans, kept_text = [], [], [], []
        for n, z, marks in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
            text, gone, found = d.decompress(z), 0, []
            if marks:
                out = _covered(n, marks, window)
                gone = int(out.sum())
                edge = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
                found = [{"start": int(x), "stop": int(y)} for x, y in edge.reshape(-1, 2)]
                text = b" ".join([w for w, x in zip(text.split(), out.tolist()) if not x])
            removed.append(gone)
            spans.append(found)
            digest.append(hashlib.sha256(text).hexdigest())
            if with_text:
                kept_text.append(text.decode())
        cols = [b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, span)]
        if with_text:
            cols.append(pa.array(kept_text, pa.string()))
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"][:len(cols)])
    return map_batches(joined.select("doc_id", "n_words", "z", "marks"), one,
                       f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, "
                       "spans array<struct<start: long, stop: long>>" + ", kept_text string" * with_text)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, gram: int = 16,
                   shard_segments: int = 10_000, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (of the words that stay,
    joined by single spaces), spans (removed intervals of words) and, on request,
    kept_text."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(src.dtypes)["doc_id"]
    anchors = materialise(_anchors(src, window, gram), "anchors")
    suspects = materialise(_suspects(anchors, shard_segments), "suspects")
    shards = parts_for(suspects.agg(F.sum(F.size("cold"))).first()[0] or 0, shard_segments)
    keyed = _keyed(src, kind)
    distinct = keyed.groupBy("k1", "k2").agg(F.first("z").alias("z"), F.count("*").alias("copies"))
    packed = materialise(_cut(distinct.join(suspects, ["k1", "k2"]), shards, window, gram), "segments")
    marks = _searched(packed, window).unionByName(_hot_segments(packed))
    per_key = marks.groupBy("k1", "k2").agg(F.collect_list(F.struct("firsts", "mask")).alias("marks"))
    return _kept(keyed.join(per_key, ["k1", "k2"], "left"), window, kind, with_text)

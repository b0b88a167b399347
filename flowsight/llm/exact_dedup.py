"""Exact deduplication against immutable snapshots.

Every snapshot keeps its distinct text digests in hash buckets and, per bucket,
one static binary-fuse filter.  The digests of an incoming batch are first
grouped among themselves (copies inside the batch), then screened by the
filters; positives join the snapshot's exact buckets, and the bytes of every
group with more than one row are compared before it counts as equal.

Memory: a bucket holds ``bucket_rows`` distinct digests on average (the bucket
count follows the row count), a filter about 1.2 bytes a digest.  Copies
collapse to one row per digest before any bucket, so a text shared by a third
of all rows is one row there.

Cases: null text counts as empty; a null doc_id is never larger than another,
and a group of null ids keeps a null id; identical rows (same id, same text)
are all returned and exactly one of them is kept; an empty table gives no rows;
extra columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.llm.common import id_key, map_batches, materialise, parts_for, prepare, texts_of

# ---------------------------------------------------------------- binary fuse


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser (xor-shift multiply) over uint64 keys."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _slots(keys: np.ndarray, seed: int, seg: int, n_seg: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots in consecutive segments and the 8-bit fingerprint of each key."""
    h = _mix(keys, seed)
    g = _mix(h, seed + 1)
    first = (h >> np.uint64(32)) % np.uint64(n_seg)
    low = np.uint64(seg - 1)
    pos = np.stack([(first + np.uint64(i)) * np.uint64(seg) + ((g >> np.uint64(20 * i)) & low)
                    for i in range(3)]).astype(np.int64)
    return pos, (h & np.uint64(0xFF)).astype(np.uint8)


def fuse_build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, start segments, table) of a 3-wise binary fuse
    filter over distinct uint64 keys; peeling runs in vectorised rounds."""
    keys = np.unique(keys)
    n = len(keys)
    seg = 1 << max(2, min(18, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 4)))
    n_seg = max(1, -(-int(n * factor) // seg) - 2)
    for seed in range(1, 1000):
        if seed % 20 == 0:
            n_seg += max(1, n_seg // 10)
        size = (n_seg + 2) * seg
        pos, fp = _slots(keys, seed, seg, n_seg)
        count = np.bincount(pos.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        ids = np.arange(n)
        for p in pos:
            np.bitwise_xor.at(owner, p, ids)
        rounds, left = [], n
        alone = np.flatnonzero(count == 1)
        while len(alone):
            who, at = np.unique(owner[alone], return_index=True)
            rounds.append((who, alone[at]))
            left -= len(who)
            touched = pos[:, who]
            for p in touched:
                np.subtract.at(count, p, 1)
                np.bitwise_xor.at(owner, p, who)
            t = np.unique(touched.ravel())
            alone = t[count[t] == 1]
        if left == 0:
            out = np.zeros(size, np.uint8)
            for who, slot in reversed(rounds):
                p = pos[:, who]
                rest = out[p[0]] ^ out[p[1]] ^ out[p[2]] ^ out[slot]  # own slot cancels
                out[slot] = fp[who] ^ rest
            return seed, seg, n_seg, out.tobytes()
    raise RuntimeError("no binary fuse filter after 1000 seeds")


def fuse_probe(f: tuple[int, int, int, bytes], keys: np.ndarray) -> np.ndarray:
    """True where a key may be in the filter; never false for a member."""
    seed, seg, n_seg, data = f
    pos, fp = _slots(keys, seed, seg, n_seg)
    t = np.frombuffer(data, np.uint8)
    return (t[pos[0]] ^ t[pos[1]] ^ t[pos[2]]) == fp


def _keys(digests: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests.to_pylist()), np.uint64)


# ------------------------------------------------------------------ operators


def digests(docs: DataFrame, id_col: str, text_col: str, with_text: bool = False) -> DataFrame:
    """(doc_id, digest[, ztext]): SHA-256 of the text with A-Z lowered."""
    return _digested(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), with_text)


def _digested(sel: DataFrame, with_text: bool = False) -> DataFrame:
    """(carry, text) -> (carry, digest[, ztext])."""
    carry, kind = sel.dtypes[0]

    def one(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        low = [t.lower() for t in texts_of(b.column(1))]
        cols = [b.column(0), pa.array([hashlib.sha256(t).digest() for t in low], pa.binary())]
        if with_text:
            z = zstandard.ZstdCompressor(level=1)
            cols.append(pa.array([z.compress(t) for t in low], pa.binary()))
        yield pa.RecordBatch.from_arrays(cols, [carry, "digest", "ztext"][:len(cols)])
    return map_batches(sel, one, f"{carry} {kind}, digest binary" + ", ztext binary" * with_text)


def distinct_digests(rows: DataFrame) -> DataFrame:
    """One row per digest: rows behind it and the largest id."""
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))


def snapshot_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """(bucket, seed, seg, n_seg, data): one static filter per hash bucket of a
    snapshot's distinct digests."""
    def build(t: pa.Table) -> pa.Table:
        seed, seg, n_seg, data = fuse_build(_keys(t.column("digest").combine_chunks()))
        return pa.table({"bucket": t.column("bucket")[:1].combine_chunks(), "seed": pa.array([seed], pa.int32()),
                         "seg": pa.array([seg], pa.int32()), "n_seg": pa.array([n_seg], pa.int32()),
                         "data": pa.array([data], pa.binary())})
    return (snapshot.select(_bucket(buckets), "digest").groupBy("bucket")
            .applyInArrow(build, "bucket int, seed int, seg int, n_seg int, data binary"))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket")


def screen(batch: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """Digests of the batch that a snapshot filter lets through."""
    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"digest": pa.array([], pa.binary())})
        f = right.to_pylist()[0]
        hit = fuse_probe((f["seed"], f["seg"], f["n_seg"], f["data"]), _keys(left.column("digest").combine_chunks()))
        return pa.table({"digest": left.column("digest").filter(pa.array(hit)).cast(pa.binary())})
    return (batch.select(_bucket(buckets), "digest").groupBy("bucket")
            .cogroup(filters.groupBy("bucket")).applyInArrow(probe, "digest binary"))


def exact_dedup(docs: DataFrame, is_new, id_col: str = "doc_id", text_col: str = "text",
                bucket_rows: int = 100_000) -> DataFrame:
    """One row per input row: doc_id, keep_id (largest id of the equal texts),
    group_size, kept, text_sha256 (lower-case hex of the lowered text),
    in_batch.  ``is_new`` is a column expression over ``doc_id`` that is true
    for the rows of the incoming batch; the others form the snapshot."""
    prepare(docs.sparkSession)
    rows = materialise(digests(docs, id_col, text_col)
                       .withColumn("in_batch", F.coalesce(is_new, F.lit(True)))
                       .groupBy("digest", "doc_id", "in_batch").agg(F.count("*").alias("copies")), "digests")

    def side(new: bool) -> DataFrame:
        return rows.where(F.col("in_batch") == new).groupBy("digest").agg(
            F.sum("copies").alias("n"), F.max("doc_id").alias("top"))
    batch, snap = materialise(side(True), "batch"), materialise(side(False), "snapshot")
    buckets = parts_for(snap.count(), bucket_rows)
    filters = materialise(snapshot_filters(snap, buckets), "filters")
    positives = screen(batch, filters, buckets)
    # exact buckets: positives against the snapshot's own digests
    met = positives.join(snap.select("digest", F.col("n").alias("snap_n"), F.col("top").alias("snap_top")), "digest")
    new_groups = batch.join(met, "digest", "left").select(
        "digest", (F.col("n") + F.coalesce("snap_n", F.lit(0))).alias("n"), F.greatest("top", "snap_top").alias("top"))
    old_groups = snap.join(met.select("digest"), "digest", "left_anti").select("digest", "n", "top")
    groups = materialise(new_groups.unionByName(old_groups), "groups")
    _check_bytes(docs, groups, id_col, text_col)
    first = (F.col("doc_id").eqNullSafe(F.col("top"))) & (F.col("copy") == 1)
    dup = rows.groupBy("digest", "doc_id").agg(F.max("in_batch").alias("in_batch"), F.sum("copies").alias("copies"))
    return (dup.join(groups, "digest")
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("doc_id", F.col("top").alias("keep_id"), F.col("n").cast("long").alias("group_size"),
                    first.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "in_batch"))


def _check_bytes(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> None:
    """Compare the bytes behind every digest that stands for several rows.  The
    compressed text is an injective image of the text, so a group is equal when
    all its rows have one image; copies collapse before the shuffle."""
    texts = digests(docs, id_col, text_col, with_text=True).select("digest", "ztext")
    several = groups.where("n > 1").select("digest")
    images = texts.join(several, "digest", "left_semi").groupBy("digest", "ztext").agg(F.count("*").alias("c"))
    clash = images.groupBy("digest").agg(F.count("*").alias("c")).where("c > 1").take(1)
    if clash:
        raise RuntimeError("different texts share one SHA-256 digest")


def keep_latest(docs: DataFrame, is_new, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all their columns, that ``exact_dedup`` keeps.  Of rows
    with one id and equal texts the one whose text sorts first stays."""
    kept = exact_dedup(docs, is_new, id_col, text_col, **options).where("kept") \
        .select(id_key(F.col("doc_id")).alias("id"), F.unhex("text_sha256").alias("digest"))
    rows = _digested(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                                 F.col(text_col).cast("string").alias("text")))
    return (rows.withColumn("id", id_key(F.col("row").getField(id_col)))
            .join(kept, ["id", "digest"], "left_semi")
            .groupBy("id", "digest")
            .agg(F.min_by("row", F.coalesce(F.col("row").getField(text_col), F.lit(""))).alias("row")).select("row.*"))

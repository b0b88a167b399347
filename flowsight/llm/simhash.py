"""SimHash near-duplicates found through pivot distance tables.

Every distinct fingerprint gets its Hamming distances to a fixed set of seeded
reference fingerprints (pivots), block by block.  With ``max_bits`` differing
bits over ``max_bits + 2`` blocks at least two blocks are equal, hence all their
pivot distances: the pairs of blocks' distance vectors are the bucket keys, and
no linked pair is missed.  In a bucket, pairs whose distances to some pivot
differ by more than ``max_bits`` are discarded (triangle inequality), the
survivors are verified bit by bit.

Copies collapse to one fingerprint before any join.  A bucket with more than
``bucket_cap`` fingerprints emits no pairs: two fingerprints within 2r bits share
a point within r bits of both, so each member emits the points within r bits of
its free (unequal) bits, and all members at one point link to the least of them.
That is exact and linear in the bucket.

Cases: null and empty texts have fingerprint zero and link like any other;
fewer words than a shingle make one shingle; null ids take part, ids of a
component are compared without nulls; repeated rows are each returned; an empty
table gives no rows; extra columns are ignored.
"""
from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsight.llm.common import connected_components, id_key, map_batches, materialise, prepare, texts_of

N_PIVOTS = 16
#: Hashes whose bits are counted at a time: bounds the memory of a huge text.
CHUNK = 1 << 14


def fingerprint(text: bytes, shingle_words: int = 3) -> int:
    """64-bit SimHash: a bit is set if set in over half the shingles' XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, 42)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = end - length
    n = len(words) - shingle_words + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42)
                          for a, b in zip(start[:n].tolist(), end[shingle_words - 1:].tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        bits = np.unpackbits(hashes[i:i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""
    return _printed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), shingle_words)


def _printed(sel: DataFrame, shingle_words: int) -> DataFrame:
    """(carry, text) -> (carry, fp)."""
    carry, kind = sel.dtypes[0]

    def one(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp = np.array([fingerprint(t, shingle_words) for t in texts_of(b.column(1))], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], [carry, "fp"])
    return map_batches(sel, one, f"{carry} {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    n = max_bits + 2
    cut = [64 * i // n for i in range(n + 1)]
    return list(zip(cut[:-1], cut[1:]))


def pivot_table(fps: DataFrame, max_bits: int, seed: int = 7) -> DataFrame:
    """fps(fp, ...) + ``near``: per block the array of Hamming distances to the
    pivots, and ``total``: the distances over all bits."""
    rng = random.Random(seed)
    pivots = [rng.getrandbits(64) for _ in range(N_PIVOTS)]

    def dist(lo: int, hi: int) -> Column:
        mask = ((1 << (hi - lo)) - 1) << lo
        return F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p))).bitwiseAND(F.lit(_signed(mask))))
                         .cast("byte") for p in pivots])
    return fps.withColumn("near", F.array(*[dist(lo, hi) for lo, hi in _blocks(max_bits)])) \
        .withColumn("total", dist(0, 64))


def _keyed(table: DataFrame, max_bits: int) -> DataFrame:
    """One row per fingerprint and pair of blocks: key from the pivot distances."""
    pairs = list(combinations(range(max_bits + 2), 2))
    keys = F.array(*[F.struct(F.lit(i).alias("pair"), F.xxhash64(F.lit(i), F.col("near")[a], F.col("near")[b]).alias("key"))
                     for i, (a, b) in enumerate(pairs)])
    return table.select("fp", "total", F.explode(keys).alias("k")).select("fp", "total", "k.pair", "k.key")


def _free_bits(max_bits: int) -> list[list[int]]:
    blocks = _blocks(max_bits)
    return [[bit for j, (lo, hi) in enumerate(blocks) if j not in pair for bit in range(lo, hi)]
            for pair in combinations(range(len(blocks)), 2)]


def _crowded_links(crowded: DataFrame, max_bits: int) -> DataFrame:
    """Links of buckets over the cap: see the module text."""
    free = _free_bits(max_bits)
    radius = max_bits // 2
    flips = F.array(*[F.array(*[F.lit(_signed(sum(1 << b for b in c))) for r in range(radius + 1)
                                for c in combinations(bits, r)]) for bits in free])
    at = crowded.withColumn("flip", F.explode(flips[F.col("pair")])) \
        .withColumn("point", F.col("fp").bitwiseXOR(F.col("flip"))).select("key", "pair", "point", "fp")
    # a key is a hash of distance vectors: members of one bucket that differ in the
    # equal blocks never share a point, so the point alone separates them
    least = at.groupBy("key", "pair", "point").agg(F.min("fp").alias("a"))
    return at.join(least, ["key", "pair", "point"]).where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def links(table: DataFrame, max_bits: int, bucket_cap: int = 256) -> DataFrame:
    """Distinct pairs (a, b) of different fingerprints that differ in at most
    ``max_bits`` bits; crowded buckets give links that connect the same sets."""
    keyed = materialise(_keyed(table, max_bits), "simhash-keys")
    crowd = keyed.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > bucket_cap).select("key")
    cold = keyed.join(crowd, "key", "left_anti")
    x = cold.select("key", F.col("fp").alias("a"), F.col("total").alias("da"))
    y = cold.select("key", F.col("fp").alias("b"), F.col("total").alias("db"))
    far = F.exists(F.zip_with("da", "db", lambda p, q: F.abs(p - q) > max_bits), lambda v: v)
    pairs = (x.join(y, "key").where("a < b").where(~far)
             .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b").distinct())
    return pairs.unionByName(_crowded_links(keyed.join(crowd, "key", "left_semi"), max_bits))


def groups(rows: DataFrame, max_bits: int, bucket_cap: int = 256) -> DataFrame:
    """rows(doc_id, fp) -> one row per fingerprint: fp, component_id (smallest id of
    its component), group_size and keep_fp, the least fingerprint that has that id."""
    if max_bits not in (0, 2, 4):
        raise ValueError("max_bits must be 0, 2 or 4")
    uniq = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    table = materialise(pivot_table(uniq, max_bits), "simhash-pivots")
    roots = connected_components(links(table, max_bits, bucket_cap))
    members = materialise(
        table.select("fp", "first", "n").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .withColumn("root", F.coalesce("root", "fp")), "simhash-members")
    top = F.min(F.struct(F.col("first").isNull(), F.col("first").alias("id"), F.col("fp").alias("fp")))
    label = members.groupBy("root").agg(top.alias("top"), F.sum("n").alias("group_size"))
    return members.join(label, "root").select("fp", F.col("top.id").alias("component_id"), "group_size",
                                              F.col("top.fp").alias("keep_fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                    max_bits: int = 2, bucket_cap: int = 256) -> DataFrame:
    """Per document: doc_id, fingerprint (16 lower-case hex digits), component_id
    (smallest id reachable over links, its own included) and group_size."""
    prepare(docs.sparkSession)
    rows = materialise(fingerprints(docs, id_col, text_col, shingle_words), "simhash-rows")
    return rows.join(groups(rows, max_bits, bucket_cap), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
             max_bits: int = 2, bucket_cap: int = 256) -> DataFrame:
    """The rows of ``docs``, all their columns, with the smallest id of their
    component (a null id only where it has no other); of rows with that id the one
    with the least fingerprint and then the first text stays."""
    prepare(docs.sparkSession)
    rows = materialise(_printed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                                            F.col(text_col).cast("string").alias("text")), shingle_words), "simhash-docs")
    named = groups(rows.select(F.col("row").getField(id_col).alias("doc_id"), "fp"), max_bits, bucket_cap)
    keep = named.where("fp = keep_fp").select(id_key(F.col("component_id")).alias("id"), "fp")
    return (rows.withColumn("id", id_key(F.col("row").getField(id_col))).join(keep, ["id", "fp"], "left_semi")
            .groupBy("id", "fp")
            .agg(F.min_by("row", F.coalesce(F.col("row").getField(text_col), F.lit(""))).alias("row")).select("row.*"))

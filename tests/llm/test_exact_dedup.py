"""Exact deduplication and its binary-fuse filters."""
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_cases import AWKWARD
from flowsight.llm import exact_dedup as ed
from flowsight.llm.queries import held_out


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 100, 5000, 60_000])
def test_fuse_filter_has_every_member_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    f = ed.fuse_build(keys)
    assert ed.fuse_probe(f, keys).all()
    other = rng.integers(1 << 63, (1 << 64) - 1, 100_000, dtype=np.uint64)
    assert ed.fuse_probe(f, other).mean() < 0.01
    if n >= 5000:
        assert len(f[3]) < 1.35 * n


def low(t):
    return (t or "").encode().lower()


def brute(rows):
    members = defaultdict(list)
    for i, t in rows:
        members[low(t)].append(i)
    out = []
    for t, ids in members.items():
        known = [i for i in ids if i is not None]
        top = max(known) if known else None
        kept = False
        for i in ids:
            out.append((i, top, len(ids), i == top and not kept, hashlib.sha256(t).hexdigest()))
            kept |= i == top
    return Counter(out)


def got(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


@pytest.mark.parametrize("new", ["crc32(cast(cast(doc_id as string) as binary)) % 2 = 1", "true", "false"])
@pytest.mark.parametrize("bucket_rows", [100_000, 2])
def test_awkward_rows(awkward, new, bucket_rows):
    assert got(ed.exact_dedup(awkward, F.expr(new), bucket_rows=bucket_rows)) == brute([(i, t) for i, t, _ in AWKWARD])


def test_empty_table(empty):
    assert ed.exact_dedup(empty, held_out(2, 1)).count() == 0
    assert ed.keep_latest(empty, held_out(2, 1)).count() == 0


def test_kept_rows_keep_their_columns(awkward):
    kept = ed.keep_latest(awkward, held_out(2, 1))
    assert kept.columns == awkward.columns
    want = Counter(i for (i, _, _, k, _), n in brute([(i, t) for i, t, _ in AWKWARD]).items() if k for _ in range(n))
    assert Counter(r.doc_id for r in kept.collect()) == want


def test_large_group_of_copies(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("Same TEXT"))
                                    .otherwise(F.concat(F.lit("t"), F.col("id") % 2500)).alias("text"))
    assert got(ed.exact_dedup(docs, held_out(2, 1))) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_colliding_digests_fail_loudly(spark, monkeypatch):
    class Fake:
        def __init__(self, t):
            pass

        def digest(self):
            return b"0" * 32
    groups = spark.createDataFrame([(bytearray(b"0" * 32), 2, 1)], "digest binary, n long, top long")
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    fake = ed.digests(docs, "doc_id", "text", with_text=True).withColumn("digest", F.lit(bytearray(b"0" * 32)))
    monkeypatch.setattr(ed, "digests", lambda *a, **k: fake)
    with pytest.raises(RuntimeError):
        ed._check_bytes(docs, groups, "doc_id", "text")

"""Lexical search against scoring every document of every query."""
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_cases import AWKWARD
from flowsight.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(t):
    return TERM.findall((t or "").translate(LOW))


def brute(docs, items, k=10):
    """docs: (id, text), items: (id, text)."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    pooled = defaultdict(set)
    for i, t in items:
        pooled[i].update(terms(t))
    out = []
    for item, ts in pooled.items():
        hits = []
        for i, c in counts:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in ts if t in c)
            if s > 0:
                hits.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, h[3], -h[0]) for r, h in enumerate(sorted(hits, key=lambda h: h[:3])[:k])]
    return sorted(out, key=repr)


def got(docs, items, k=10):
    return sorted((tuple(r) for r in ls.ranked(docs, items, k).collect()), key=repr)


def test_terms_equal_the_pattern():
    for t in ["", "a-B_c9", "É é x y", "\x00\x7f{}~", "日本 語", "ñ's"]:
        assert [w.decode() for w in ls.terms_of(t.encode())] == terms(t)


def test_range_maxima():
    x = np.random.default_rng(0).integers(0, 99, (37, 3))
    t = ls.range_maxima(x)
    for lo in range(37):
        for hi in range(lo + 1, 38):
            j = (hi - lo).bit_length() - 1
            assert (np.maximum(t[j, lo], t[j, hi - (1 << j)]) == x[lo:hi].max(axis=0)).all()


@pytest.mark.parametrize("table_bytes", [ls.TABLE_BYTES, 2000])
def test_best_first_equals_full_scoring(monkeypatch, table_bytes):
    monkeypatch.setattr(ls, "TABLE_BYTES", table_bytes)
    monkeypatch.setattr(ls, "FIRST_BATCH", 2)
    rng = np.random.default_rng(3)
    docs = [(int(i), " ".join(f"w{min(int(x), 40)}" for x in rng.zipf(1.3, rng.integers(0, 60)))) for i in rng.permutation(500)]
    docs += [(1000 + i, docs[0][1]) for i in range(60)]  # ties
    items = [(q, " ".join(f"w{x}" for x in rng.integers(1, 42, 12))) for q in range(8)] + [(9, docs[0][1])]
    numbers = {t: i for i, t in enumerate(sorted({t.encode() for _, x in items for t in terms(x)}))}
    builder, shards = ls.ShardBuilder(), []
    for j, (i, t) in enumerate(docs):
        builder.add(i, t.encode())
        if j % 200 == 199:
            shards.append(builder.pack())
    shards.append(builder.pack())
    n = sum(s["n_docs"] for s in shards)
    total = sum(s["n_terms"] for s in shards)
    df = Counter(t.encode() for _, x in docs for t in set(terms(x)))
    w = np.array([ls.weight(n, df[t]) for t in numbers], np.int64)
    queries = [np.array([numbers[t.encode()] for t in dict.fromkeys(terms(x))]) for _, x in items]
    best = [[] for _ in items]
    for s in shards:
        ls.search_shard(s, numbers, w, queries, n, total, best, 10)
    out = [(items[q][0], r + 1, d, s) for q, hits in enumerate(best) for r, (s, d) in enumerate(hits)]
    assert sorted(out, key=repr) == brute(docs, items)


def test_awkward_rows_and_two_blocks(spark, awkward, empty, monkeypatch):
    monkeypatch.setattr(ls, "BLOCK_BYTES", 4000)
    items = spark.createDataFrame([(1, "one three", 0), (1, "FOUR one", 0), (2, None, 0), (3, "", 0), (None, "élan", 0),
                                   (4, "absent", 0), (5, "x" * 5000, 0), (6, "word id endoftext", 0)],
                                  "item_id long, text string, score int")
    rows = [(i, t) for i, t, _ in AWKWARD]
    want = brute(rows, [(r.item_id, r.text) for r in items.collect()])
    assert got(awkward.repartition(3), items) == want
    assert got(empty, items) == [] and got(awkward, items.limit(0)) == []


def test_string_ids(spark):
    docs = spark.createDataFrame([("", "a b"), ("z", "a b"), (None, "a b"), ("y", "c")], "doc_id string, text string")
    items = docs.select(F.lit("q").alias("item_id"), F.lit("a").alias("text")).limit(1)
    assert [r.doc_id for r in ls.ranked(docs, items).orderBy("rank").collect()] == ["", "z", None]

"""SimHash links and components against brute force."""
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from llm_cases import AWKWARD, SF01, documents
from flowsight.llm import simhash as sh


def brute_fingerprint(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    sh_ = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh_]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, bits=2):
    """Smallest id per component over (id, fingerprint) pairs."""
    uniq = sorted({f for _, f in fps})
    root = {f: f for f in uniq}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(uniq):
        for b in uniq[i + 1:]:
            if bin(a ^ b).count("1") <= bits:
                root[find(a)] = find(b)
    low = {}
    for i, f in fps:
        if i is not None:
            low[find(f)] = min(low.get(find(f), i), i)
    return {f: low.get(find(f)) for f in uniq}


def test_whole_table(spark):
    docs = documents(spark, SF01)
    fps = [(d.doc_id, brute_fingerprint(d.text)) for d in docs.collect()]
    low = components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in sh.near_duplicates(docs).collect()}
    assert got == {i: (f"{f:016x}", low[f]) for i, f in fps}


def test_awkward_and_empty(spark, awkward, empty):
    fps = [(i, brute_fingerprint(t)) for i, t, _ in AWKWARD]
    low = components(fps)
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in sh.near_duplicates(awkward).collect())
    assert got == Counter((i, f"{f:016x}", low[f]) for i, f in fps)
    assert sh.near_duplicates(empty).count() == 0 and sh.keep_one(empty).count() == 0
    kept = sh.keep_one(awkward)
    assert kept.columns == awkward.columns
    tops = {low[f] for _, f in fps}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(tops)


@pytest.mark.parametrize("cap", [256, 3, 1])
def test_links_connect_what_brute_force_connects(spark, cap):
    rng = random.Random(cap)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {0, (1 << 64) - 1}
    for _ in range(300):
        f = rng.choice(centres)
        for _ in range(rng.randrange(5)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    signed = [(sh._signed(f),) for f in sorted(fps)]
    table = sh.pivot_table(spark.createDataFrame(signed, "fp long"), 2)
    found = {(r.a, r.b) for r in sh.links(table, 2, cap).collect()}
    mask = (1 << 64) - 1
    assert all(0 < bin((a ^ b) & mask).count("1") <= 2 for a, b in found)
    near = {(a, b) for a, in signed for b, in signed if a < b and bin((a ^ b) & mask).count("1") <= 2}
    if cap == 256:
        assert found == near
    from flowsight.llm.common import connected_components
    same = lambda pairs: {r.node: r.root for r in connected_components(
        spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    assert same(found) == same(near)


def test_components_of_paths_and_hubs(spark):
    from flowsight.llm.common import connected_components
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}


def test_no_python_in_pair_search(spark):
    table = sh.pivot_table(spark.range(10).select(F.col("id").alias("fp")), 2)
    plan = sh.links(table, 2)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Arrow" not in plan

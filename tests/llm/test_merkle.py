"""Merkle manifest: tree, proofs and folding against a plain recursion."""
import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flowsight.llm import merkle

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree_of(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [h(nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
        out.append(nodes)
    return out


def brute(rows):
    """rows: dicts with the fields of the manifest."""
    groups = defaultdict(list)
    for r in rows:
        leaf = h([field(r[c]) for c in merkle.FIELDS])
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        text = r["text"] if r["text"] is None or not hit else r["text"].translate(LOW)
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf,
                                  h([field({**r, "text": text}[c]) for c in merkle.FIELDS]), r["doc_id"]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree_of([x[2] for x in sorted(groups[g], key=lambda x: x[:4])]) for g in order}
    top = tree_of([trees[g][-1][0] for g in order])
    out = []
    for place, g in enumerate(order):
        for i, (*_, leaf, changed, doc) in enumerate(sorted(groups[g], key=lambda x: x[:4])):
            proof, node = [], changed
            for levels, j in ((trees[g], i), (top, place)):
                for nodes in levels[:-1]:
                    lo, slot = j // 8 * 8, j % 8
                    run = nodes[lo:lo + 8]
                    proof += run[:slot] + run[slot + 1:]
                    node, j = h(run[:slot] + [node] + run[slot + 1:]), j // 8
            out.append((doc, leaf, trees[g][-1][0], top[-1][0], h(proof), node, node == top[-1][0]))
    return sorted(out, key=repr)


def check(df, levels=merkle.BLOCK_LEVELS):
    got = [tuple(r) for r in merkle.manifest(df, levels=levels).collect()]
    assert sorted(got, key=repr) == brute([r.asDict() for r in df.collect()])
    return got


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 600])
def test_sizes_of_a_tree(spark, n):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"),
                               F.lit(None).cast("long").alias("n_chars"), F.concat(F.lit("Text "), "id").alias("text"))
    got = check(df, levels=1 if n < 100 else 2)
    assert {r[6] for r in got} <= {True, False} and len(got) == n
    assert sum(not r[6] for r in got) == sum(zlib.crc32(str(i).encode()) % 3 == 0 for i in range(n))


def test_many_groups_form_a_tree_of_their_own(spark):
    df = spark.range(150).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"),
                                 F.when(F.col("id") % 2 == 0, F.concat(F.lit("é"), (F.col("id") % 100).cast("string"))).alias("lang"),
                                 F.lit(3).alias("n_chars"), F.lit("Aé").alias("text"))
    check(df, levels=1)


def test_awkward_rows(spark, awkward, empty):
    wide = lambda d: d.withColumns({"lang": F.when(F.col("doc_id") % 3 > 0, F.col("source")),
                                    "n_chars": F.length("text").cast("long"), "pos": F.lit(1), "tree": F.lit("x"),
                                    "digest": F.lit("y"), "block": F.lit(None).cast("string")})
    check(wide(awkward))
    assert merkle.manifest(wide(empty)).count() == 0


def test_same_manifest_after_repartition(spark, awkward):
    df = awkward.withColumns({"lang": F.col("source"), "n_chars": F.lit(1)})
    rows = lambda d: sorted(map(repr, merkle.manifest(d).collect()))
    assert rows(df) == rows(df.repartition(7))


def test_resumed_state_equals_whole_hash():
    kids = [h([str(i)]) for i in range(8)]
    p = merkle.Parent(kids)
    assert p.digest == h(kids)
    for i in range(8):
        assert p.fold(i, "x" * 64) == h(kids[:i] + ["x" * 64] + kids[i + 1:])

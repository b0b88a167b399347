"""Source mixing: targets, low-discrepancy schedule, whole and deterministic results."""
import random

import pytest
from pyspark.sql import functions as F

from llm_cases import AWKWARD, SF01, documents
from flowsight.llm import mixing as mx


def brute_targets(sizes):
    """Reshare the excess by weight until no target is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * left / total > 3 * sizes[s]}
        if not over:
            target.update({s: weight[s] * left / total for s in free})
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
        free -= over
    return target


@pytest.mark.parametrize("seed", range(5))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 10, 500, 100_000]) for i in range(rng.randrange(1, 9))}
    sizes[None] = 40
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mx.source_targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want)


def test_points_and_ranks(spark):
    n = 500
    bounds = [0, 1, (1 << 52) // 3, (1 << 52) // 7 * 5, 1 << 51, (1 << 52) - 1, 1 << 52]
    point = [int(f"{t:052b}"[::-1], 2) for t in range(n)]
    df = spark.range(n).withColumn("p", mx.bit_reverse(F.col("id")))
    for k, b in enumerate(bounds):
        df = df.withColumn(f"b{k}", F.lit(b).cast("long")).withColumn(f"d{k}", mx._digits(f"b{k}"))
        df = df.withColumn(f"r{k}", mx._points_below("id", f"d{k}", f"b{k}"))
    for r in df.collect():
        assert r.p == point[r.id]
        for k, b in enumerate(bounds):
            assert r[f"r{k}"] == sum(p < b for p in point[:r.id])


def test_slots_are_ranked_and_spread(spark):
    sizes = spark.createDataFrame([("a", 4000), ("b", 1000), ("c", 50), (None, 700)], "source string, source_size long")
    plan, slots = mx.schedule(mx.source_targets(sizes), 64, 16)
    rows = slots.orderBy("slot").collect()
    want = {r.source: r.slots for r in plan.collect()}
    seen = {s: 0 for s in want}
    for i, r in enumerate(rows, 1):
        assert r["rank"] == seen[r.source]
        seen[r.source] += 1
        if i % 32 == 0:  # every stretch of the schedule has the sources' shares
            assert all(abs(seen[s] - want[s] * i / sum(want.values())) < 6 for s in want)
    assert all(abs(seen[s] - want[s]) < 6 for s in want)


@pytest.mark.parametrize("options", [{}, {"block_tokens": 50, "bucket_rows": 10}])
def test_taken_words_follow_targets(spark, options):
    r = mx.mix(documents(spark, SF01), **options).toPandas()
    assert len(r) == 1000 and (r.taken <= 3 * r["size"]).all() and (r.taken >= 0).all()
    per = r.groupby("source").agg({"size": "sum", "source_size": "first", "target": "first", "taken": "sum"})
    assert (per["size"] == per.source_size).all()
    assert (abs(per.taken - per.target) <= 0.01 * per.target + 100).all()
    want = brute_targets(per.source_size.to_dict())
    assert all(abs(per.target[s] - want[s]) < 1e-6 * want[s] for s in want)


def test_reruns_agree_whatever_the_partitions(spark):
    docs = documents(spark, SF01)
    a = sorted(map(tuple, mx.mix(docs).collect()))
    assert a == sorted(map(tuple, mx.mix(docs.repartition(13)).collect()))


def test_awkward_and_empty(spark, awkward, empty):
    r = sorted(((x.doc_id, x["size"], x.source) for x in mx.mix(awkward).collect()), key=str)
    assert r == sorted(((i, len((t or "").encode().split()), s) for i, t, s in AWKWARD), key=str)
    assert mx.mix(empty).count() == 0
    none = awkward.withColumn("text", F.lit(" ")).withColumn("source", F.lit(None).cast("string"))
    assert {(x["size"], x.taken, x.target) for x in mx.mix(none).collect()} == {(0, 0, 0.0)}


def test_no_python_in_the_plan(spark):
    plan = mx.mix(documents(spark, SF01))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))

"""Hidden Markov models: Baum-Welch against path enumeration and plain loops, ranking against the flattened model."""
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsight.operators import hmm as H
from flowsight.operators import metrics as M
from flowsight.operators import ml
from flowsight.operators import windows as W


def enumerated(seqs, m):
    """Log likelihood and expected counts by all state paths."""
    k, n = m.emit.shape
    like, first, steps, emits = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros((k, n))
    for s in seqs:
        weights = []
        for path in itertools.product(range(k), repeat=len(s)):
            p = m.init[path[0]]
            for a, b in zip(path, path[1:]):
                p *= m.trans[a, b]
            for q, o in zip(path, s):
                p *= m.emit[q, o] if o >= 0 else 1.0
            weights.append((path, p))
        total = sum(p for _, p in weights)
        like += np.log(total)
        for path, p in weights:
            first[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                steps[a, b] += p / total
            for q, o in zip(path, s):
                if o >= 0:
                    emits[q, o] += p / total
    return np.concatenate([[like], first, steps.ravel(), emits.ravel()])


def test_expected_counts_equal_all_paths(monkeypatch):
    rng = np.random.default_rng(1)
    m = H.first_model(np.array([0.5, 0.3, 0.2]), 2, seed=3)
    seqs = [rng.integers(-1, 3, n) for n in (1, 6, 3, 5, 2)] + [np.zeros(0, np.int64)]
    want = enumerated([s for s in seqs if len(s)], m)
    assert np.allclose(H.expected(seqs, m), want)
    monkeypatch.setattr(H, "CELLS", 6)  # one sequence a block
    assert np.allclose(H.expected(seqs, m), want)


def chain(streams=120, length=60, seed=5):
    """Regimes that last; one emits 1 mostly, the other 0 or 2 (2 = attack)."""
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(streams):
        z = int(rng.integers(2))
        for t in range(length):
            z = z if rng.random() < 0.93 else 1 - z
            s = int(rng.choice(3, p=[0.1, 0.85, 0.05] if z == 0 else [0.5, 0.1, 0.4]))
            rows.append((u * 1000 + t, f"u{u}", t * 1_000_000, s))
    return rows


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(chain(), "id long, src_ip string, us long, s int").checkpoint()


def test_rounds_equal_a_plain_loop_whatever_the_partitions(spark, events):
    x = H.stretches(events, "s", stretch=25)
    assert x.agg(F.max(F.size("seq")), F.sum(F.size("seq"))).first()[:] == (25, 7200)
    seqs = [np.array(r.seq) for r in x.collect()]
    m = H.first_model(np.array([0.3, 0.45, 0.25]), 2)
    got, likes = H.fit(x, 3, rounds=4, tol=0.0, start=m)
    again, _ = H.fit(x.repartition(11), 3, rounds=4, tol=0.0, start=m)
    for _ in range(4):
        m = H._updated(m, H.expected(seqs, m))
    assert np.allclose(got.trans, m.trans) and np.allclose(got.emit, m.emit) and np.allclose(again.emit, m.emit)
    assert all(b > a for a, b in zip(likes, likes[1:]))


def test_ranks_held_out_streams_better_than_the_flattened_model(spark, events):
    part = F.pmod(F.xxhash64("src_ip"), F.lit(3)) == 0
    m, likes = H.fit(H.stretches(events.where(~part), "s"), 3, states=2, rounds=40)
    assert all(b >= a - 1e-6 for a, b in zip(likes, likes[1:]))
    p = H.predict(H.stretches(events.where(part), "s", stretch=40, context=20), m, [2])
    assert p.count() == events.where(part).count() == p.select("id").distinct().count()
    label = events.withColumn("label", F.when(F.col("s") == 2, "Attack").otherwise("Normal"))
    seqs, cols = ml.sequence_features(W.make_sequences(label, ["s"], 20, "label", binary=True), 1, 20)
    seqs = seqs.withColumn("target", F.col("target").cast("string")).checkpoint()
    flat = ml.evaluate(ml.train(seqs.where(~part), cols, "target", "logistic"), seqs.where(part), "target")
    from pyspark.ml.functions import vector_to_array
    flat = flat.select("id", "target", vector_to_array("probability")[1].alias("flat"))
    both = flat.join(p, "id").checkpoint()
    auc = {c: M.roc_auc(both, c, F.col("target") == "1").first().auc for c in ("p_next", "flat")}
    auc["flat"] = max(auc["flat"], 1 - auc["flat"])
    assert auc["p_next"] > 0.7 and auc["p_next"] > auc["flat"], auc


def test_empty_and_awkward_streams(spark):
    kinds = "id long, src_ip string, us long, s int"
    none = H.stretches(spark.createDataFrame([], kinds), "s")
    m, likes = H.fit(none, 3)
    assert likes[0] == 0.0 and H.predict(none, m, [2]).count() == 0
    rows = [(1, "a", 0, None), (2, "a", 1, 2), (3, None, 2, 1), (4, "b", None, 1), (5, "b", 7, 0)]
    x = H.stretches(spark.createDataFrame(rows, kinds), "s")
    got = {r.id: r.p_next for r in H.predict(x, m, [0, 1, 2]).collect()}
    assert sorted(got) == [1, 2, 5] and all(abs(v - 1) < 1e-9 for v in got.values())

"""Toxicity field: forward-backward against enumeration, held-out quality, spans."""
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsight.llm import toxicity as tx
from flowsight.llm.queries import held_out

SF1 = "/root/testdata/sf0.1"


def test_marginals_and_pairs_by_enumeration():
    rng = np.random.default_rng(0)
    f = tx.Field(trans=rng.normal(size=(2, 2)), start=0.7)
    lengths = np.array([4, 1, 6, 2])
    start = np.cumsum(lengths) - lengths
    u = rng.normal(size=lengths.sum())
    p, pairs = tx.forward_backward(u, start, tx.lockstep(start, lengths), f, pairs=True)
    want, want_pairs = np.zeros(len(u)), np.zeros((2, 2))
    for s, n in zip(start, lengths):
        total, marg, pair = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            e = f.start * path[0] + sum(u[s + i] * z for i, z in enumerate(path)) + sum(f.trans[a, b] for a, b in zip(path, path[1:]))
            w = np.exp(e)
            total += w
            marg += w * np.array(path)
            for a, b in zip(path, path[1:]):
                pair[a, b] += w
        want[s:s + n] = marg / total
        want_pairs += pair / total
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)


def test_chains_end_with_sentences():
    start, length = tx.chains([["a", "b.", "c"], [], ["d"], ["e!", "f?", "g"]])
    assert start.tolist() == [0, 2, 3, 4, 5, 6] and length.tolist() == [2, 1, 1, 1, 1, 1]


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"{SF1}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, tx.train(docs, labels, ~held_out(3, 1), sample_rows=600)


def test_held_out_quality(fitted):
    docs, labels, f = fitted
    r = tx.score(docs, f).where(held_out(3, 1)).join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    pos, neg = r[r.toxic == 1].score.to_numpy(), r[r.toxic == 0].score.to_numpy()
    auc = ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())
    tp = int(((r.toxic == 1) & (r.predicted == 1)).sum())
    assert auc > 0.95 and tp / (r.predicted == 1).sum() > 0.9 and tp / len(pos) > 0.85
    assert r.score.between(0, 1).all()


def test_spans_cover_the_offending_words(spark, fitted):
    _, _, f = fitted
    texts = ["the erthha and of this. you are a stupid worthless idiot and the that. of the", "the erthha and of this"]
    rows = {r.doc_id: r for r in tx.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), f).collect()}
    caught = " ".join(texts[0][s.start:s.stop] for s in rows[0].spans)
    assert {"stupid", "worthless", "idiot"} <= set(caught.replace(".", "").split()) and len(caught) < 50
    assert rows[0].score > rows[1].score and not rows[1].spans


def test_scores_do_not_depend_on_batches_or_other_columns(spark, fitted):
    docs, _, f = fitted
    some = docs.where("doc_id < 300")
    a = {r.doc_id: r.score for r in tx.score(some, f).collect()}
    b = {r.doc_id: r.score for r in tx.score(some.repartition(7).withColumn("lang", F.lit("x")), f).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_awkward_empty_and_no_labels(spark, fitted, awkward, empty):
    _, labels, f = fitted
    r = tx.score(awkward, f).collect()
    assert len(r) == awkward.count() and all(0 <= x.score <= 1 for x in r)
    kept = tx.keep_clean(awkward, f)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()
    assert tx.score(empty, f).count() == 0 and tx.keep_clean(empty, f).count() == 0
    odd = spark.createDataFrame([(1, 0, None), (1, 0, 0), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    assert {x.score for x in tx.score(awkward, tx.train(awkward, odd, F.lit(True))).collect()} == {0.0}
    assert {x.score for x in tx.score(awkward, tx.train(awkward, labels.limit(0), F.lit(True))).collect()} == {0.0}
    assert {x.score for x in tx.score(awkward, tx.train(empty, labels, F.lit(True))).collect()} != {None}


def test_same_score_for_long_text_in_slices(spark, fitted, monkeypatch):
    _, _, f = fitted
    rng = random.Random(2)
    text = " ".join(rng.choice(["the", "stupid", "erth.", "of", "réeuxment"]) for _ in range(4000))
    one = tx.Tagger(f)
    p = one.marginals([tx.tokenise(text), tx.tokenise("")])
    assert len(p[0]) == 4000 and len(p[1]) == 0 and one.score(p[1]) < 0.5 < one.score(p[0])

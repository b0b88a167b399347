"""Language-model scores against brute force."""
import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_cases import AWKWARD, SF01, documents
from flowsight.llm import lm_score as lm
from flowsight.llm.queries import held_out


def tokens(t):
    return [*(t or "").encode().lower().split(), b""]


def brute(rows):
    """(doc_id, held_out, n_tokens, n_known, N, base) per row."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    p = lambda w: math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1)))
    return [(i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(map(p, tokens(t)))) for i, t in rows]


def check(df, rows):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect()), key=str)
    assert got == sorted(((*x[:5], round(x[5], 6)) for x in brute(rows)), key=str)


@pytest.mark.parametrize("rates", [(500_000, 100_000), (300, 200)])
def test_base_scores_of_the_whole_table(spark, rates):
    docs = documents(spark, SF01)
    out = lm.score(docs, held_out(10, 0), word_rate=rates[0], bigram_rate=rates[1])
    check(out, [(d.doc_id, d.text) for d in docs.collect()])


def test_awkward_and_empty(spark, awkward, empty):
    check(lm.score(awkward, held_out(10, 0)), [(i, t) for i, t, _ in AWKWARD])
    assert lm.score(empty, held_out(10, 0)).count() == 0
    nothing_learnt = lm.score(awkward, F.lit(True)).collect()
    assert all((r.n_known, r.train_tokens, r.base_score, r.score) == (0, 0, 0.0, 0.0) for r in nothing_learnt)


def test_filter_reads_the_lower_end_of_each_level():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 62, 4000)).astype(np.uint64)
    counts = rng.integers(5, 5000, len(keys)).astype(float)
    f = lm.LogFrequencyFilter(keys, counts, 5)
    read = f.counts(keys)
    assert (read <= counts + 1e-6).all() and (counts < read * f.base * (1 + 1e-6)).all()
    other = rng.integers(1 << 62, 1 << 63, 200_000).astype(np.uint64)
    assert (f.counts(other) > 0).mean() < 1e-4
    assert not lm.LogFrequencyFilter(keys[:0], counts[:0], 2).counts(other[:3]).any()


def test_score_beats_the_base_where_bigrams_repeat(spark):
    docs = documents(spark, SF01)
    r = lm.score(docs, held_out(10, 0)).groupBy("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).collect()
    assert all(x.s > x.b for x in r)
    rep = spark.createDataFrame([(i, "alpha beta gamma delta " * 5) for i in range(60)], "doc_id long, text string")
    out = lm.score(rep, held_out(10, 0)).collect()
    assert all(x.score > 0.5 * x.base_score for x in out)


def brute_model(rows):
    """(vocabulary, histories, log10 P(w | h)) of all bigrams seen twice; rows of (id,
    [None, *tokens]), None stands for the start and the unknown word."""
    train = [w for i, w in rows if zlib.crc32(str(i).encode()) % 10]
    c = Counter(x for w in train for x in w)
    pairs = Counter(p for w in train for p in zip(w, w[1:]))
    n = sum(c.values()) - c[None]
    read = {p: 2 * 1.5 ** math.floor(math.log(k / 2) / math.log(1.5) + 1e-9) for p, k in pairs.items() if k >= 2}
    used = Counter()
    for (h, _), r in read.items():
        used[h] += r - 0.75

    def log_p(h, w):
        left = max(1 - used[h] / c[h], 1e-9) if c[h] else 1.0
        p1 = ((c[w] if w is not None else 0) + 0.1) / (n + 0.1 * len(c))
        return math.log10((max(read[h, w] - 0.75, 0) / c[h] if (h, w) in read else 0) + left * p1)
    return c, used, log_p


@pytest.mark.parametrize("rates", [(500_000, 100_000), (2_000, 500)])
@pytest.mark.parametrize("sizes", [(4_000_000, 1_000_000, 3 << 20), (20_000, 700, 50_000)])
def test_every_repeated_bigram_counts(spark, monkeypatch, rates, sizes):
    """Scores by brute force over all bigrams seen twice, whatever the rates and
    however many shards and chunks; what is compared sums to one for every history."""
    for name, x in zip(("SHARD_TOKENS", "SHARD_WORDS", "CHUNK_BYTES"), sizes):
        monkeypatch.setattr(lm, name, x)
    some = [(d.doc_id, d.text) for d in documents(spark, SF01).limit(600).collect()]
    some += some[:3]
    rows = [(i, [None, *tokens(t)]) for i, t in some]
    fixed = spark.createDataFrame(some, "doc_id long, text string")
    got = lm.score(fixed, held_out(10, 0), word_rate=rates[0], bigram_rate=rates[1]).collect()
    c, used, log_p = brute_model(rows)
    want = sorted((i, round(sum(map(log_p, w, w[1:])), 4)) for i, w in rows)
    assert sorted((r.doc_id, round(r.score, 4)) for r in got) == want
    for h in [None, *sorted(used.keys() - {None})[:: max(1, len(used) // 20)]]:
        assert abs(sum(10 ** log_p(h, w) for w in [None, *(c.keys() - {None})]) - 1) < 1e-6


def test_a_stored_filter_reads_the_same():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 62, 3000)).astype(np.uint64)
    f = lm.LogFrequencyFilter(keys, rng.integers(2, 900, len(keys)).astype(float), 2)
    again = lm.LogFrequencyFilter.stored(f.cells.tobytes(), f.bits, f.top, 2)
    assert (again.levels(keys) == f.levels(keys)).all() and f.levels(keys).min() == 1


def test_a_filter_is_filled_in_the_memory_of_its_cells():
    """Building takes no byte a bit: a key here has ten levels, 75 bytes of cells."""
    keys = np.random.default_rng(3).integers(0, 1 << 62, 100_000).astype(np.uint64)
    counts = np.full(len(keys), 2 * 1.5 ** 9)
    tracemalloc.start()
    try:
        f = lm.LogFrequencyFilter(keys, counts, 2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert f.top == 10 and peak < 250 * len(keys)


def test_false_answers_of_a_filter_are_rare():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 1 << 62, 50_000).astype(np.uint64)
    f = lm.LogFrequencyFilter(keys, rng.integers(2, 50, len(keys)).astype(float), 2, error=1e-4)
    assert (f.levels(keys) > 0).all()
    assert (f.levels(rng.integers(1 << 62, 1 << 63, 500_000).astype(np.uint64)) > 0).mean() < 3e-4


def test_shards_follow_all_tokens_where_few_are_learnt(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 50)
    kept, shards = lm._kept, []
    monkeypatch.setattr(lm, "_kept", lambda *x: shards.append(x[-1]) or kept(*x))
    docs = spark.createDataFrame([(i, "a b c d e f g h i") for i in range(30)], "doc_id long, text string")
    assert lm.score(docs, F.lit(True)).count() == 30
    assert shards == [6]


def test_a_chunk_reads_all_its_bigrams_where_they_are_counted(spark, monkeypatch):
    """One answer per chunk and shard, for held-out bigrams too; a level per distinct bigram."""
    monkeypatch.setattr(lm, "CHUNK_BYTES", 120)
    texts = [(i, f"x y z x y {i} {i % 3} w{i % 5} w{i % 2}") for i in range(40)]
    rows = spark.createDataFrame([(i, t, i % 4 == 0) for i, t in texts], "doc_id long, text string, held_out boolean").coalesce(1)
    words = {b"x": 0, b"y": 1}
    chunks = lm._chunks(rows, words, "bigint").cache()
    answers = lm._kept(chunks, 2, 2, 1e9, 3).where("levels is not null").collect()
    asked = {c.chunk: lm._pairs(lm._numbers(c.sizes), lm._numbers(c.numbers, 4), 2) for c in chunks.collect()}
    assert len(asked) > 3 and len({(a.chunk, a.shard) for a in answers}) == len(answers)
    train = Counter(p for i, t in texts if i % 4 for p in zip([None, *tokens(t)], tokens(t)))
    level = {p: 1 + math.floor(math.log(c / 2) / math.log(1.5) + 1e-9) for p, c in train.items() if c >= 2}
    got, want = Counter(), Counter()
    for a in answers:
        got.update((a.chunk, k) for k in lm._unpacked(a.levels))
    for c in chunks.collect():
        texts_of = dict(texts)
        distinct = {p for i in c.ids for p in zip([None, *tokens(texts_of[i])], tokens(texts_of[i]))}
        assert len(distinct) == len(np.unique(asked[c.chunk]))
        want.update((c.chunk, level.get(p, 0)) for p in distinct)
    chunks.unpersist()
    assert got == want

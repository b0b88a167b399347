"""Repeated-passage removal against brute force over all windows."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from llm_cases import AWKWARD, SF01, documents
from flowsight.llm import substring_dedup as sd


def brute(rows, window=35):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    count = Counter(tuple(w[k:k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if count[tuple(w[k:k + window])] > 1:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    for r in df.collect():
        assert r.n_removed == sum(x.stop - x.start for x in r.spans) and all(x.stop - x.start >= 35 for x in r.spans)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_hashes_follow_words_only():
    a, b = b"one two one three", b"xx one two one three yy"
    ha, hb = sd.word_hashes(a)[2], sd.word_hashes(b)[2]
    assert ha[0] == ha[2] == hb[1] and ha[0] != ha[1] and (ha == hb[1:5]).all()
    s, e, _ = sd.word_hashes(b)
    assert [b[x:y] for x, y in zip(s, e)] == b.split()
    assert (sd.gram_hashes(ha, 3)[0] == sd.gram_hashes(hb, 3)[1]) and len(sd.word_hashes(b"")[2]) == 0


@pytest.mark.parametrize("size", [1 << 20, 7])
def test_long_words_and_small_steps(monkeypatch, size):
    text = b" ".join([b"a" * 50, b"b", b"a" * 50, b"c" * 9, b"b"])
    want = sd.word_hashes(text)[2]
    monkeypatch.setattr(sd, "BYTES", size)
    assert (sd.word_hashes(text)[2] == want).all() and want[0] == want[2] and want[1] == want[4]


def test_segments_cover_every_window_once(monkeypatch):
    rng = np.random.default_rng(4)
    for words in (1 << 22, 50):
        monkeypatch.setattr(sd, "WORDS", words)
        lengths = np.array([0, 100, 34, 35, 0, 200, 36])
        h = rng.integers(0, 6, lengths.sum()).astype(np.uint64)
        first, last, at, _ = sd.segments(h, lengths, 35, 16)
        seen = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
        begin = np.cumsum(lengths) - lengths
        want = [b + k for b, n in zip(begin, lengths) for k in range(n - 34)]
        assert sorted(seen) == want and ((at >= last) & (at + 16 <= first + 35)).all()


def test_whole_table(spark):
    docs = documents(spark, SF01)
    rows = [(d.doc_id, d.text) for d in docs.collect()]
    assert got(sd.remove_repeats(docs)) == brute(rows)


@pytest.mark.parametrize("crowd", [10_000, 40, 3])
def test_planted_passages_shards_and_hot_anchors(spark, crowd):
    rng = random.Random(crowd)
    vocab = [f"w{i}" for i in range(60)] + ["é", "日本"]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passages = [line(n) for n in (34, 35, 36, 60, 120)]
    rows = []
    for i in range(150):
        parts = [line(rng.randrange(40)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages).split()
            a = rng.randrange(3)
            parts.insert(rng.randrange(len(parts) + 1), " ".join(p[a:]))
        rows.append((i, "  \n".join(parts)))
    rows += [(200, passages[4] + " " + passages[4]), (201, "x " * 500), (202, "x " * 36), (203, "x y " * 300), (204, "x " * 35),
             (205, "x\ty\n" * 40)]
    rows += [(300 + i, rows[7][1]) for i in range(30)] + [(7, rows[7][1].replace("  \n", " "))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(sd.remove_repeats(docs, shard_segments=crowd)) == brute(rows)


def test_awkward_and_empty(spark, awkward, empty):
    assert got(sd.remove_repeats(awkward)) == brute([(i, t) for i, t, _ in AWKWARD])
    assert sd.remove_repeats(empty).count() == 0
    kept = {r.doc_id: r.kept_text for r in sd.remove_repeats(awkward, with_text=True).collect()}
    assert kept[3] == "One two three four" and kept[7] == "" and kept[2] == ""

"""Packing: exact round trip of ids, windows without gaps, little padding."""
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_cases import SF001, documents
from flowsight.llm import packing


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(packing.default_tokenizer())


def check(packed, texts, library, window=packing.WINDOW):
    """texts: every document's; returns (tokens, padding)."""
    whole = [np.array(e.ids + [1], "<u4") for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    rows = packed.pieces.collect()
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.pid, r.row].append(r)
        seqs[r.sequence_id].append(r)
    crcs = defaultdict(list)
    for ids in whole:
        crcs[len(ids)].append(ids)
    for pieces in docs.values():
        pieces.sort(key=lambda r: r.start)
        n = pieces[0].doc_tokens
        assert [r.start for r in pieces] == np.cumsum([0] + [r.length for r in pieces[:-1]]).tolist()
        assert sum(r.length for r in pieces) == n and all(r.doc_tokens == n and r.length > 0 for r in pieces)
        same = [i for i, ids in enumerate(crcs[n]) if all(
            zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces)]
        del crcs[n][same[0]]
    assert not any(crcs.values())
    padding = 0
    for pieces in seqs.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0] + [r.length for r in pieces[:-1]]).tolist()
        n = sum(r.length for r in pieces)
        assert n <= window
        padding += window - n if n & (n - 1) else 0
    assert sorted(seqs) == list(range(len(seqs)))
    return sum(map(len, whole)), padding


def test_documents_round_trip(spark, library):
    docs = documents(spark, SF001)
    packed = packing.pack(docs)
    tokens, padding = check(packed, [r.text for r in docs.collect()], library)
    assert padding <= tokens / 1000
    windows = {r.sequence_id: r.ids for r in packed.sequences().collect()}
    assert sum(len(x) for x in windows.values()) == tokens + padding


def test_awkward_rows_and_small_windows(spark, awkward, empty, library, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 100)
    wide = awkward.withColumns({"tail": F.lit(1), "pid": F.lit("x"), "row": F.lit(2), "sequence_id": F.lit(0)})
    packed = packing.pack(wide.repartition(3), window=64, width=4, depth=3)
    check(packed, [r.text for r in awkward.collect()], library, window=64)
    assert packing.pack(empty).pieces.count() == 0


def test_words_apart_equal_whole_texts(library):
    rng = random.Random(5)
    alphabet = ["a", "B", "é", "é", "́", " ", "  ", "\t", "\x0b", "\x0c", "\r\n", "\x85", "\xa0", " ", "\x1c", "\x00",
                "'s", "'S", "'", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", ".", "..", ",", "?", "K", "É", "E", "9", "12", "!", "日本", "İ", "Σ", "ß", "</w>", "​", "🏳️‍🌈"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)]
    enc = packing.Encoder(packing.default_tokenizer(), True)
    for t, got, want in zip(texts, enc.encode([t.encode() for t in texts], 1), library.encode_batch(texts, add_special_tokens=False)):
        assert got.tolist() == want.ids + [1], repr(t)
    whole = packing.Encoder(packing.default_tokenizer(), False)
    assert whole.encode([b"a  b"], 7)[0].tolist() == enc.encode([b"a  b"], 7)[0].tolist()


def test_combinations_fill_the_window():
    combos = packing.combinations(12, 3)
    assert (combos.sum(axis=1) == 12).all() and len({tuple(c) for c in combos.tolist()}) == len(combos)
    assert len(combos) == sum(a + b <= 12 and b <= a and (c := 12 - a - b) <= b for a in range(13) for b in range(13) if a + b <= 12)


def test_least_squares_is_optimal_and_never_overdraws():
    rng = np.random.default_rng(1)
    combos = packing.combinations(16, 4)
    for _ in range(10):
        counts = np.concatenate([[0], rng.integers(0, 1000, 16)])
        x = packing.nnls(combos, counts)
        made = np.bincount(combos.ravel(), np.repeat(x, 4), 17) * (np.arange(17) > 0)
        gradient = np.where(combos > 0, (counts - made)[combos], 0).sum(axis=1)
        assert (x >= 0).all() and (gradient < 1e-4).all() and np.abs(gradient[x > 0]).max() < 1e-4
        kept, repeats = packing.solve(counts, counts * (np.arange(17) * 4 - 1.5), window=64, width=4)
        used = np.bincount(kept.ravel(), np.repeat(repeats, 4), 17) * (np.arange(17) > 0)
        assert (used <= counts).all() and (kept.sum(axis=1) == 16).all()
    assert packing.solve(np.zeros(17, np.int64), np.zeros(17, np.int64), window=64, width=4)[1].sum() == 0

"""Q-gram lemma filtering against brute-force alignment of every piece."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_cases import SF01, documents
from flowsight.llm import decontaminate as dc


def best_edits(piece, text):
    """Least edits of the whole piece against any stretch of the text."""
    prev = [0] * (len(text) + 1)
    for i, p in enumerate(piece, 1):
        row = [i]
        for j, t in enumerate(text, 1):
            row.append(min(prev[j - 1] + (p != t), prev[j] + 1, row[-1] + 1))
        prev = row
    return min(prev)


def norm(t):
    return "".join(map(chr, dc.codes_of(t)[0])) if t else ""


def test_codes_keep_positions():
    c, at = dc.codes_of("  Ab\t\n É x ")
    assert "".join(map(chr, c)) == " ab É x " and list(at) == [0, 2, 3, 4, 7, 8, 9, 10]
    assert len(dc.codes_of("")[0]) == 0


def test_grams_are_equal_where_text_is():
    c = np.frombuffer("abcabcabcabcabc".encode("utf-32-le"), np.uint32)
    for q in (1, 2, 3, 5, 10):
        g = dc.grams(c, q)
        assert len(g) == len(c) - q + 1
        for i in range(len(g)):
            for j in range(len(g)):
                assert (g[i] == g[j]) == (list(c[i:i + q]) == list(c[j:j + q]))


def test_every_piece_within_budget_is_found():
    rng = random.Random(3)
    letters = "abcdeé "
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    items = [(i, norm(word(rng.choice([40, 60, 90]))).strip()) for i in range(12)]
    index = dc.PieceIndex(items, 5, 0.1, 40)
    found = expected = 0
    for _ in range(60):
        i, t = rng.choice(items)
        t = list(t[rng.randrange(10):])
        for _ in range(rng.randrange(9)):
            at = rng.randrange(len(t))
            op = rng.randrange(3)
            if op == 0:
                t[at] = rng.choice(letters)
            elif op == 1:
                del t[at]
            else:
                t.insert(at, rng.choice(letters))
        text = norm(word(rng.randrange(40)) + "".join(t) + word(rng.randrange(40)))
        gap = np.full(index.pad, dc.GAP, np.uint32)
        c, _ = dc.codes_of(text)
        got = {m[0] for m in index.matches(np.concatenate([gap, c, gap]))}
        want = {p for p, piece in enumerate(index.pieces)
                if best_edits("".join(map(chr, piece)), text) <= index.budget[p]}
        assert got == want
        found += len(got)
        expected += len(want)
    assert found == expected > 20


def test_whole_table_finds_planted_passages_only(spark):
    docs, bench = documents(spark, SF01), spark.read.parquet(f"{SF01}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(docs, bench).collect()}
    items = [(b.item_id, norm(b.text).strip()) for b in bench.collect()]
    texts = {d.doc_id: norm(d.text) for d in docs.collect()}
    exact = {(d, i) for i, b in items for d, t in texts.items() if b in t}
    assert exact and exact <= got
    index = dc.PieceIndex(items, 10, 0.08, 80)
    for d, i in got - exact:  # anything else holds a piece within its budget
        assert any(best_edits("".join(map(chr, p)), texts[d]) <= k for p, k, o in
                   zip(index.pieces, index.budget, index.owner) if index.items[o] == i)
    kept = {r.doc_id for r in dc.decontaminate(docs, bench).collect()}
    assert kept == set(texts) - {d for d, _ in got}


def test_awkward_empty_and_blocks(spark, awkward, empty):
    bench = spark.createDataFrame([(1, "One two three four"), (2, None), (3, ""), (4, "x" * 300), (5, "élan"), (6, "zzz qqq")],
                                  "item_id long, text string")
    want = {(3, 1), (4, 1), (8, 4), (5, 5), (6, 5)}
    for chars in (4_000_000, 20):
        got = {(r.doc_id, r.item_id) for r in dc.contaminated(awkward, bench, block_chars=chars).collect()}
        assert got == want
    kept = dc.decontaminate(awkward, bench)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 5
    assert dc.contaminated(empty, bench).count() == 0 and dc.decontaminate(empty, bench).count() == 0
    assert dc.contaminated(awkward, bench.limit(0)).count() == 0
    assert dc.decontaminate(awkward, bench.limit(0)).count() == awkward.count()


@pytest.mark.parametrize("copies", [1, 40])
def test_long_text_with_a_passage_at_either_end(spark, copies):
    passage = "the quick brown fox jumps over the lazy dog while seven wizards quietly examine jade boxes"
    body = "lorem ipsum dolor sit amet " * 3000
    docs = spark.createDataFrame([(1, passage.upper() + body), (2, body + passage.replace("o", "0", 2)), (3, body)] * copies,
                                 "doc_id long, text string")
    got = dc.contaminated(docs, spark.createDataFrame([(7, passage)], "item_id long, text string"))
    assert {(r.doc_id, r.n) for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {(1, copies), (2, copies)}
    spans = {r.doc_id: (r.start, r.stop) for r in got.collect()}
    assert spans[1] == (0, len(passage)) and spans[2][1] == len(body) + len(passage)

"""Token counts against the library on whole texts."""
import random

import pytest
from tokenizers import Tokenizer

from llm_cases import AWKWARD, SF01, documents
from flowsight.llm import token_counts as tc


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(tc.default_tokenizer())


def want(tok, text):
    return len(tok.encode(text or "", add_special_tokens=False))


def test_whole_table(spark, tok):
    docs = documents(spark, SF01)
    got = {r.doc_id: r for r in tc.token_counts(docs).collect()}
    for d in docs.collect():
        r = got[d.doc_id]
        assert (r.n_tokens, r.n_bytes) == (want(tok, d.text), len((d.text or "").encode()))
        assert r.over_limit == (r.n_tokens > 1024)


def hostile(rng):
    bits = [" ", "  ", "\n", "\n\n ", "word", "don't", "'s", "é", "日本語", "123", "!!!", "<|endoftext|>", "<|endof", "|>",
            " ", " ", "\t", "a", "\x85", "🙂", "x" * 40, "'", " 's"]
    return "".join(rng.choice(bits) for _ in range(rng.randrange(1, 900)))


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (97, 40), (300, 64)])
def test_small_chunks_splice(spark, tok, chunk, overlap):
    rng = random.Random(chunk)
    texts = [hostile(rng) for _ in range(150)] + ["y" * 700, " " * 500, "a b " * 200, "<|endoftext|>" * 60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tc.token_counts(docs, chunk_chars=chunk, overlap=overlap).collect()}
    assert got == {i: want(tok, t) for i, t in enumerate(texts)}


def test_awkward_and_empty(spark, tok, awkward, empty):
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in tc.token_counts(awkward).collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), want(tok, t)) for i, t, _ in AWKWARD), key=str)
    assert tc.token_counts(empty).count() == 0


def test_other_tokenizer_encodes_whole_texts(spark, awkward):
    import public_tokenizers as p
    path = p.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = sorted(((r.doc_id, r.n_tokens) for r in tc.token_counts(awkward, tokenizer=path).collect()), key=str)
    assert got == sorted(((i, want(t, x)) for i, x, _ in AWKWARD), key=str)

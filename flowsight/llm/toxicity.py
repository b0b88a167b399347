"""Toxicity: a linear-chain conditional random field tags toxic spans.

States are clean and toxic; a chain is a run of words up to a sentence end.
Emissions are weights of the word, its prefixes and suffixes, transitions a 2 x 2
table.  Document labels become token labels first: in a toxic training document the
tokens with a feature that is far more frequent among toxic documents, everything
else clean.  The field is trained by its conditional likelihood (forward-backward
marginals, full-batch Adam).  A document's score is a logistic function of its
tokens' marginals, fitted on training rows the field has not seen; runs of tokens
with a marginal of one half or more are the offending spans.

The classifier is fitted on the driver over a bounded sample: at most
``sample_rows`` labelled rows of either class, taken in the order of a hash of the
id, of texts up to ``sample_chars``.  Scoring maps every document once; nothing is
shuffled.  A worker remembers a bounded number of words' emissions.

Cases: null and empty texts are scored like a text without words; ids labelled
more than once are toxic if any label says so, null labels and ids are ignored in
training; with no labelled row of one class every score is the share of the other
(0 without labels); repeated rows are each scored; an empty table gives no rows;
extra columns are ignored.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsight.llm.common import prepare

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STRIP = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())
ENDS = (".", "!", "?", ".\"", "!\"", "?\"")
CACHE_WORDS = 500_000
#: Marginal from which a token counts in a document's score.
SUSPECT = 0.25
#: Characters scored at a time.
SLICE = 1 << 21
SPAN_TYPE = "array<struct<start: long, stop: long, marginal: double>>"


def features(word: str) -> list[str]:
    """Of a lower-case word without outer punctuation."""
    n = len(word)
    out = ["=" + word, *["^" + word[:k] for k in range(3, min(n, 8))]]
    if n > 3:
        out.append("$" + word[-3:])
    return out


def bare(token: str) -> str:
    return token.lower().strip(STRIP)


def chains(tokens: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every chain over the documents' concatenated tokens; a
    document's first token starts one, and so does what follows a sentence end."""
    starts, at = [], 0
    for doc in tokens:
        if doc:
            starts.append(at)
            starts += [at + i for i, t in enumerate(doc[:-1], 1) if t.endswith(ENDS)]
            at += len(doc)
    s = np.array(starts, np.int64)
    return s, np.diff(np.append(s, at))


@dataclass
class Field:
    """Feature weights, log potentials of the transitions and of a chain's first
    state, and the weights of the document score."""
    weights: dict[str, float] = field(default_factory=dict)
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0
    doc: np.ndarray | None = None
    prior: float = 0.0


def lockstep(start: np.ndarray, length: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(t, first tokens of the chains longer than t) for every t."""
    order = np.argsort(-length, kind="stable")
    s, n = start[order], -length[order]
    live = np.searchsorted(n, -np.arange(-int(n[0]) if len(n) else 0), side="left")
    return [(t, s[:x]) for t, x in enumerate(live.tolist())]


def forward_backward(u: np.ndarray, start: np.ndarray, steps: list[tuple[int, np.ndarray]], f: Field,
                     pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginal of the toxic state of every token, and on request the expected
    number of each transition.  Two states need one number a token: the odds.
    ``steps`` (``lockstep``) moves all chains ahead together."""
    e = np.exp(np.clip(u, -30, 30))  # odds stay within e**-60 and e**60
    t = np.exp(f.trans)
    fwd, bwd = np.empty_like(e), np.ones_like(e)
    fwd[start] = np.exp(f.start) * e[start]
    for k, first in steps[1:]:
        i = first + k
        r = fwd[i - 1]
        fwd[i] = e[i] * (t[0, 1] + r * t[1, 1]) / (t[0, 0] + r * t[1, 0])
    for k, first in reversed(steps[1:]):
        i = first + k
        x = e[i] * bwd[i]
        bwd[i - 1] = (t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x)
    odds = fwd * bwd
    p = odds / (1 + odds)
    if not pairs:
        return p, None
    inner = np.ones(len(u), bool)
    inner[start] = False
    j = np.flatnonzero(inner)
    r, x = fwd[j - 1], e[j] * bwd[j]
    w = np.stack([t[0, 0] * np.ones_like(r), t[0, 1] * x, r * t[1, 0], r * t[1, 1] * x])
    return p, (w / w.sum(axis=0)).sum(axis=1).reshape(2, 2)


@dataclass
class Corpus:
    """Tokenised training texts as numbers: one array of word numbers a text, the words
    in their order, and for every text where a sentence ends."""
    texts: list[np.ndarray]
    words: list[str]
    ends: list[np.ndarray]

    def chains(self) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(t) for t in self.texts], np.int64)
        begin = (np.cumsum(n) - n)[n > 0]
        after = np.flatnonzero(np.concatenate([np.zeros(0, bool), *self.ends])) + 1
        starts = np.unique(np.concatenate([begin, after[after < n.sum()]]))
        return starts, np.diff(np.append(starts, n.sum()))


def corpus_of(texts: list[str]) -> Corpus:
    """Word numbers instead of strings: a token costs four bytes."""
    tokens: dict[str, int] = {}
    arrays = [np.array([tokens.setdefault(t, len(tokens)) for t in tokenise(x)], np.int32) for x in texts]
    words: dict[str, int] = {}
    word_of = np.array([words.setdefault(bare(t), len(words)) for t in tokens], np.int32)
    end_of = np.array([t.endswith(ENDS) for t in tokens], bool)
    empty = np.zeros(0, np.int32)
    return Corpus([word_of[a] if len(a) else empty for a in arrays], list(words),
                  [end_of[a] if len(a) else np.zeros(0, bool) for a in arrays])


def token_labels(corpus: Corpus, toxic: np.ndarray, least: int = 8, odds: float = 2.0) -> list[np.ndarray]:
    """1 for the tokens of toxic documents with a word or prefix feature whose share
    of toxic documents exceeds e**odds times its share of clean ones."""
    n1, n0 = int(toxic.sum()), int(len(toxic) - toxic.sum())
    least = max(least, n1 // 40)
    seen = (Counter(), Counter())
    for words, y in zip(corpus.texts, toxic):
        if y:
            seen[1].update({x for w in np.unique(words).tolist() for x in features(corpus.words[w]) if x[0] in "=^"})
    often = {x for x, c in seen[1].items() if c >= least}
    for words, y in zip(corpus.texts, toxic):
        if not y:
            seen[0].update({x for w in np.unique(words).tolist() for x in features(corpus.words[w]) if x in often})
    marked = {x for x in often
              if np.log((seen[1][x] + .5) / (n1 + 1)) - np.log((seen[0][x] + .5) / (n0 + 1)) >= odds}
    hit = np.array([any(x in marked for x in features(w)) for w in corpus.words], bool)
    return [hit[words] if y else np.zeros(len(words), bool) for words, y in zip(corpus.texts, toxic)]


def train_field(corpus: Corpus, toxic: np.ndarray, rounds: int = 60, rate: float = 0.3,
                l2: float = 1.0, least: int = 5) -> Field:
    """Conditional maximum likelihood with weak token labels."""
    y = np.concatenate([np.zeros(0, bool), *token_labels(corpus, toxic)]).astype(float)
    start, length = corpus.chains()
    steps = lockstep(start, length)
    ids = np.concatenate([np.zeros(0, np.int32), *corpus.texts])
    n_words = len(corpus.words)
    count: Counter = Counter()  # documents that have the feature
    for d in corpus.texts:
        count.update({x for w in np.unique(d).tolist() for x in features(corpus.words[w])})
    names = {x: i for i, x in enumerate(x for x, c in count.items() if c >= least)}
    del count
    rows = [(i, names[x]) for i, w in enumerate(corpus.words) for x in features(w) if x in names]
    word_of, feat = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 2
    del rows
    n_f = len(names)
    theta = np.zeros(n_f + 6)  # features, bias, start, 2 x 2 transitions
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    first = np.zeros(len(ids), bool)
    first[start] = True
    inner = np.flatnonzero(~first)
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
    f = Field()
    for k in range(1, rounds + 1):
        w, bias = theta[:n_f], theta[n_f]
        u = (np.bincount(word_of, w[feat], minlength=n_words) + bias)[ids]
        f.start, f.trans = theta[n_f + 1], theta[n_f + 2:].reshape(2, 2)
        p, pairs = forward_backward(u, start, steps, f, pairs=True)
        rest = p - y
        per = np.bincount(ids, rest, minlength=n_words)
        grad = np.concatenate([np.bincount(feat, per[word_of], minlength=n_f), [rest.sum(), rest[first].sum()],
                               (pairs - seen_pairs).ravel()])
        grad = grad + l2 * theta * (np.arange(len(theta)) != n_f)
        m, v = .9 * m + .1 * grad, .99 * v + .01 * grad * grad
        theta = theta - rate / (1 + k / 20) * (m / (1 - .9 ** k)) / (np.sqrt(v / (1 - .99 ** k)) + 1e-8)
    f.weights = {x: float(theta[i]) for x, i in names.items() if abs(theta[i]) > 1e-3}
    f.weights[""] = float(theta[n_f])
    f.start, f.trans = float(theta[n_f + 1]), theta[n_f + 2:].reshape(2, 2).copy()
    return f


class Tagger:
    """Marginals and document figures of whole texts."""

    def __init__(self, f: Field):
        self.field, self.cache = f, {}

    def emission(self, token: str) -> float:
        get = self.field.weights.get
        return get("", 0.0) + sum(get(x, 0.0) for x in features(bare(token)))

    def marginals(self, tokens: list[list[str]]) -> list[np.ndarray]:
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        cache = self.cache
        for w in set().union(*tokens):
            if w not in cache:
                cache[w] = self.emission(w)
        n = [len(t) for t in tokens]
        u = np.fromiter((cache[w] for t in tokens for w in t), float, sum(n))
        start, length = chains(tokens)
        p, _ = forward_backward(u, start, lockstep(start, length), self.field)
        return np.split(p, np.cumsum(n)[:-1])

    @staticmethod
    def figures(p: np.ndarray) -> list[float]:
        """Inputs of the document score: constant, expected toxic tokens among the
        suspect ones (the many near-zero marginals of a long text say nothing), their
        share, and the most certain token."""
        if not len(p):
            return [1.0, 0.0, 0.0, 0.0]
        some = p[p >= SUSPECT].sum()
        return [1.0, float(np.log1p(some)), float(np.sqrt(some / len(p))), float(p.max())]

    def score(self, p: np.ndarray) -> float:
        if self.field.doc is None:
            return self.field.prior
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.figures(p), self.field.doc), -35, 35))))


def fit_score(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) + l2 * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + (l2 + 1e-9) * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b = b - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return b


def tokenise(text: str) -> list[str]:
    return WORD.findall(text)


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, sample_rows: int,
                  sample_chars: int) -> tuple[list[tuple[str, int]], float]:
    """(text, label) of the sample, and the share of toxic rows among the usable
    labels.  Only ids of the bounded sample meet the documents."""
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")) \
        .where("doc_id is not null and toxic is not null").where(usable) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n = counts.get(0, 0) + counts.get(1, 0)
    prior = counts.get(1, 0) / n if n else 0.0
    h = F.xxhash64("doc_id")
    ids = known.where("toxic = 0").orderBy(h, "doc_id").limit(sample_rows).unionByName(
        known.where("toxic = 1").orderBy(h, "doc_id").limit(sample_rows))
    text = F.col("text").cast("string")
    picked = docs.select("doc_id", text.alias("text")).where(F.length("text") <= sample_chars) \
        .join(F.broadcast(ids), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("d"))
    return [(r.text, r.toxic) for r in picked.orderBy("d", "text").collect()], prior


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample_rows: int = 1500,
          sample_chars: int = 20_000) -> Field:
    """Fit field and document score; ``usable`` selects the label rows that may be
    learnt from (an expression over doc_id)."""
    rows, prior = training_rows(docs, labels, usable, sample_rows, sample_chars)
    y = np.array([t for _, t in rows], float)
    if not len(y) or y.min() == y.max():
        return Field(prior=prior)
    part = np.arange(len(y)) % 3 == 2  # the score is fitted on every third row
    for cls in (0, 1):  # each part needs both classes
        if not (part & (y == cls)).any() or not (~part & (y == cls)).any():
            part = None
            break
    fit, cal = (np.ones(len(y), bool),) * 2 if part is None else (~part, part)
    f = train_field(corpus_of([t for (t, _), x in zip(rows, fit) if x]), y[fit] > 0)
    tagger = Tagger(f)
    x = np.array([tagger.figures(tagger.marginals([tokenise(t)])[0]) for (t, _), c in zip(rows, cal) if c])
    yc = y[cal]
    share = yc.mean()
    f.doc = fit_score(x, yc, np.where(yc > 0, prior / share, (1 - prior) / (1 - share)))
    f.prior = prior
    return f


def spans(text: str, p: np.ndarray, least: float = 0.5) -> list[dict]:
    """Runs of tokens with a marginal of at least ``least``: characters and the
    largest marginal."""
    out, last = [], -2
    for i, m in enumerate(WORD.finditer(text)):
        if p[i] >= least:
            if last == i - 1:
                out[-1]["stop"] = m.end()
                out[-1]["marginal"] = max(out[-1]["marginal"], float(p[i]))
            else:
                out.append({"start": m.start(), "stop": m.end(), "marginal": float(p[i])})
            last = i
    return out


def with_scores(rows: DataFrame, f: Field, text: str, carry: str) -> DataFrame:
    """rows(carry, text) -> (carry, score, spans)."""
    sel = rows.select(carry, F.col(text).cast("string").alias("__text"))
    out = sel.select(carry, F.lit(0.0).alias("score"), F.lit(None).cast(SPAN_TYPE).alias("spans")).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(f)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("marginal", pa.float64())]))
        for b in batches:
            texts = ["" if t is None else t for t in b.column(1).to_pylist()]
            scores, found, group, size = [], [], [], 0
            for i, t in enumerate(texts):
                group.append(t)
                size += len(t)
                if size > SLICE or i == len(texts) - 1:
                    for t2, p in zip(group, tagger.marginals([tokenise(t2) for t2 in group])):
                        scores.append(tagger.score(p))
                        found.append(spans(t2, p) if len(p) and p.max() >= 0.5 else [])
                    group, size = [], 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(found, kind)],
                                             [carry, "score", "spans"])
    return sel.mapInArrow(score, out)


def score(docs: DataFrame, f: Field, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, score, predicted (score >= threshold), spans."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_scores(rows, f, "text", "doc_id").select(
        "doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def keep_clean(docs: DataFrame, f: Field, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all their columns, scored below the threshold."""
    prepare(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    return with_scores(rows, f, "text", "row").where(F.col("score") < threshold).select("row.*")

"""Hidden Markov models of event streams (J14 with the order of events).

A stream (all rows of one key in time order) is cut into stretches of bounded length,
which are the sequences of the model, so a key with a third of all rows is many tasks'
work.  A round of Baum-Welch is one job: scaled forward-backward over Arrow batches of
stretches, expected counts summed per partition, then by index.  The driver sees the
model's own parameters only.

Symbols are whole numbers from 0; a NULL symbol is an event that says nothing about the
state.  Rows without a key or a time belong to no stream.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.operators.sliding import row_blocks

CELLS = 1 << 20   # (sequence, position) cells of one padded block
FLOOR = 1e-12     # least probability of a symbol, for symbols not seen in training


@dataclass(frozen=True)
class Model:
    init: np.ndarray   # states
    trans: np.ndarray  # states x states
    emit: np.ndarray   # states x symbols

    def readings(self) -> np.ndarray:
        """symbols + 1 rows of emission probabilities; the last one, for a missing symbol, is 1."""
        e = np.maximum(self.emit, FLOOR).T
        return np.concatenate([e, np.ones((1, e.shape[1]))])


def first_model(freq: np.ndarray, states: int, seed: int = 42) -> Model:
    """Symbol frequencies disturbed per state, states that last."""
    rng = np.random.default_rng(seed)
    emit = (freq + 1.0 / len(freq)) * rng.uniform(0.2, 1.8, (states, len(freq)))
    trans = np.full((states, states), 0.2 / max(1, states - 1)) * rng.uniform(0.8, 1.2, (states, states))
    np.fill_diagonal(trans, 0.8)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return Model(np.full(states, 1.0 / states), norm(trans), norm(emit))


def _padded(seqs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (positions in ``seqs``, lengths, symbols padded with -1), long ones first."""
    order = sorted((i for i, s in enumerate(seqs) if len(s)), key=lambda i: -len(seqs[i]))
    while order:
        n = max(1, CELLS // len(seqs[order[0]]))
        part, order = order[:n], order[n:]
        lens = np.array([len(seqs[i]) for i in part])
        s = np.full((len(part), lens[0]), -1, np.int64)
        for r, i in enumerate(part):
            s[r, :lens[r]] = seqs[i]
        yield np.array(part), lens, s


def _forward(m: Model, lens: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward probabilities (position, sequence, state) and scales; 0 and 1 past an end."""
    read = m.readings()
    alpha = np.zeros((s.shape[1], len(s), len(m.init)))
    scale = np.ones((s.shape[1], len(s)))
    for t in range(s.shape[1]):
        live = int(np.searchsorted(-lens, -t, side="left"))  # sequences longer than t come first
        a = (m.init if t == 0 else alpha[t - 1, :live] @ m.trans) * read[s[:live, t]]
        scale[t, :live] = a.sum(axis=1)
        alpha[t, :live] = a / scale[t, :live, None]
    return alpha, scale


def expected(seqs: list[np.ndarray], m: Model) -> np.ndarray:
    """Log likelihood, then expected counts: first states, steps, emissions (flat)."""
    k, n = m.emit.shape
    like, first, steps, emits = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros((n + 1, k))
    read = m.readings()
    for _, lens, s in _padded(seqs):
        alpha, scale = _forward(m, lens, s)
        like += float(np.log(scale).sum())
        beta = np.ones((len(s), k))
        for t in range(s.shape[1] - 1, -1, -1):
            live = int(np.searchsorted(-lens, -t, side="left"))
            more = int(np.searchsorted(-lens, -(t + 1), side="left"))
            if more:  # sequences with a next event
                nxt = read[s[:more, t + 1]] * beta[:more] / scale[t + 1, :more, None]
                steps += alpha[t, :more].T @ nxt * m.trans
                beta[:more] = nxt @ m.trans.T
            gamma = alpha[t, :live] * beta[:live]
            for j in range(k):
                emits[:, j] += np.bincount(s[:live, t] % (n + 1), weights=gamma[:, j], minlength=n + 1)
        first += (alpha[0] * beta).sum(axis=0)
    return np.concatenate([[like], first, steps.ravel(), emits[:n].T.ravel()])


def _updated(m: Model, c: np.ndarray) -> Model:
    """The model of largest expected likelihood; a state without weight stays as it was."""
    k, n = m.emit.shape
    share = lambda x, old: np.where(x.sum(-1, keepdims=True) > 0, x / np.maximum(x.sum(-1, keepdims=True), 1e-300), old)
    return Model(share(c[1:1 + k], m.init), share(c[1 + k:1 + k + k * k].reshape(k, k), m.trans),
                 share(c[1 + k + k * k:].reshape(k, n), m.emit))


def _symbols(column: pa.ListArray) -> list[np.ndarray]:
    flat = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    at = column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def stretches(df: DataFrame, symbol: str, key: str = "id", by=("src_ip",), us: str = "us", order=("us", "id"),
              stretch: int = 512, context: int = 0) -> DataFrame:
    """One row per stretch: ids and symbols in order, ``own`` false for the ``context``
    events repeated from the stretch before."""
    cols = dict.fromkeys([key, symbol, us, *by, *order])
    x = row_blocks(df.select(*cols).dropna(subset=[us, *by]), list(by), us, list(order), context, block_rows=stretch)
    rows = F.sort_array(F.collect_list(F.struct("_grank", F.col(key).alias("id"), F.col(symbol).cast("int").alias("s"),
                                                (~F.col("_carry")).alias("own"))))
    x = x.groupBy(*by, "_blk").agg(rows.alias("r"))
    return x.select(F.col("r.id").alias("ids"), F.col("r.s").alias("seq"), F.col("r.own").alias("own"))


def round_counts(seqs: DataFrame, m: Model) -> np.ndarray:
    """Log likelihood and expected counts over all rows' ``seq``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            c = expected(_symbols(b.column(0)), m)
            total = c if total is None else total + c
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

    k, n = m.emit.shape
    out = np.zeros(1 + k + k * k + k * n)
    for r in seqs.select("seq").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    return out


def fit(seqs: DataFrame, n_symbols: int, states: int = 4, rounds: int = 50, tol: float = 1e-5,
        seed: int = 42, start: Model | None = None) -> tuple[Model, list[float]]:
    """Baum-Welch until the log likelihood gains less than ``tol`` of itself: the model and
    the log likelihood before each update.  Without sequences the first model is returned."""
    seqs = seqs.select("seq").checkpoint()  # read once a round
    if start is None:
        freq = np.zeros(n_symbols)
        for r in seqs.select(F.explode("seq").alias("s")).where("s is not null").groupBy("s").count().collect():
            freq[r.s] = r["count"]
        start = first_model(freq / max(freq.sum(), 1.0), states, seed)
    m, likes = start, []
    for _ in range(rounds):
        c = round_counts(seqs, m)
        likes.append(float(c[0]))
        if len(likes) > 1 and likes[-1] - likes[-2] < tol * abs(likes[-2]):
            break
        m = _updated(m, c)
    return m, likes


def predict(seqs: DataFrame, m: Model, positive: list[int], out: str = "p_next") -> DataFrame:
    """(id, p_next): probability, from the events before it, that the event's symbol is one
    of ``positive``; each stretch's own events once."""
    kind = dict(seqs.dtypes)["ids"][len("array<"):-1]
    hit = m.readings()[positive].sum(axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq = _symbols(b.column(1))
            p = [np.zeros(0)] * len(seq)
            for part, lens, s in _padded(seq):
                alpha, _ = _forward(m, lens, s)
                state = np.concatenate([np.broadcast_to(m.init, (1, len(s), len(m.init))), alpha[:-1] @ m.trans])
                for r, i in enumerate(part):
                    p[i] = state[:lens[r], r] @ hit
            own = b.column(2).flatten()
            p = pa.array(np.concatenate([np.zeros(0), *p]))
            yield pa.RecordBatch.from_arrays([b.column(0).flatten().filter(own), p.filter(own)], ["id", out])

    return seqs.select("ids", "seq", "own").mapInArrow(run, f"id {kind}, {out} double")

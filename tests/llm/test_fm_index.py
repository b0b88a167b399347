"""Wavelet ranks, backward search and window counts against brute force."""
import random

import numpy as np
import pytest

from flowsight.llm.fm_index import FMIndex, WaveletMatrix


def test_ranks():
    rng = np.random.default_rng(0)
    for n, sigma in ((1, 2), (64, 3), (1000, 37), (129, 1)):
        seq = rng.integers(0, sigma, n)
        w = WaveletMatrix(seq, max(1, (sigma - 1).bit_length()))
        for v in range(sigma):
            i = np.arange(n + 1)
            got = w.descend(np.full(n + 1, v), i) - w.descend(np.array([v]), np.array([0]))
            assert got.tolist() == [int((seq[:k] == v).sum()) for k in i]


def brute(index, weights, queries, window):
    count = {}
    for s, w in zip(index, weights):
        for i in range(len(s) - window + 1):
            count[tuple(s[i:i + window])] = count.get(tuple(s[i:i + window]), 0) + w
    return [[count.get(tuple(q[i:i + window]), 0) if i + window <= len(q) else 0 for i in range(len(q))] for q in queries]


@pytest.mark.parametrize("seed", range(6))
def test_window_weights(seed):
    rng = random.Random(seed)
    sigma, window = rng.choice([(3, 28), (6, 35), (50, 35), (4, 54)])
    base = [rng.randrange(1, sigma) for _ in range(120)]
    index = []
    for _ in range(40):
        a = rng.randrange(60)
        s = base[a:a + rng.randrange(20, 60)]
        if rng.random() < .5:
            s[rng.randrange(len(s))] = rng.randrange(1, sigma)
        index.append(s)
    index.append([1] * 70)
    weights = [rng.randrange(1, 4) for _ in index]
    other = [base, [2] * 80, [1] * 100, [rng.randrange(1, sigma) for _ in range(90)], [1], []]
    queries = index + other
    fm = FMIndex(np.array([x for s in index for x in s]), np.array([len(s) for s in index]), np.array(weights), sigma, window)
    got = fm.matches(np.array([x for q in queries for x in q]), np.array([len(q) for q in queries]))
    assert got.tolist() == [x for q in brute(index, weights, queries, window) for x in q]

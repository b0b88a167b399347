"""Betweenness and PageRank against brute force on the sf0.001 flow graph."""
import hashlib
from collections import deque

from cases import SF001
from flowsight.operators import graph as G
from flowsight.sources.tables import flows


def brandes(nodes, adj, pivots):
    bc = {v: 0.0 for v in nodes}
    for s in pivots:
        sigma = {v: 0.0 for v in nodes}
        dist = {v: -1 for v in nodes}
        pred = {v: [] for v in nodes}
        sigma[s], dist[s] = 1.0, 0
        order, q = [], deque([s])
        while q:
            v = q.popleft()
            order.append(v)
            for w in adj.get(v, ()):
                if dist[w] < 0:
                    dist[w] = dist[v] + 1
                    q.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    pred[w].append(v)
        delta = {v: 0.0 for v in nodes}
        for w in reversed(order):
            for v in pred[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                bc[w] += delta[w]
    return bc


def test_betweenness_matches_brandes(spark):
    e = G.distinct_edges(flows(spark, SF001))
    edges = [(r["src"], r["dst"]) for r in e.collect()]
    nodes = sorted({x for ed in edges for x in ed})
    adj = {}
    for a, b in edges:
        if a != b:
            adj.setdefault(a, []).append(b)
    n, k = len(nodes), 40
    pivots = sorted(nodes, key=lambda v: (int(hashlib.md5(f"42|{v}".encode()).hexdigest()[:8], 16), v))
    for pick, arg in ((pivots[:k], k), (nodes, None)):  # an estimate from hashed pivots; exact
        want = brandes(nodes, adj, pick)
        scale = 1.0 / ((n - 1) * (n - 2)) * n / len(pick)
        got = {r["node"]: r["betweenness"] for r in G.betweenness(e, k=arg).collect()}
        assert set(got) == set(nodes)
        for v in nodes:
            assert abs(got[v] - want[v] * scale) < 1e-9, v


def test_pagerank_sums_to_one(spark):
    e = G.distinct_edges(flows(spark, SF001))
    pr = G.pagerank(e)
    total = pr.agg({"pr": "sum"}).first()[0]
    assert abs(total - 1.0) < 1e-6


def test_propagate_matches_numpy(spark):
    import numpy as np
    edges = [(0, 1), (2, 1), (1, 2), (3, 0), (2, 2), (0, 1)]
    x = {0: 1.0, 1: 2.0, 2: 4.0, 3: 8.0}
    e = spark.createDataFrame(edges, "src long, dst long")
    xf = spark.createDataFrame(list(x.items()), "node long, v double")
    E = sorted({(a, b) for a, b in edges if a != b})
    n = 4
    A = np.zeros((n, n))
    for a, b in E:
        A[b, a] = 1.0
    xv = np.array([x[i] for i in range(n)])
    indeg = A.sum(axis=1)
    mean1 = np.where(indeg > 0, A @ xv / np.maximum(indeg, 1), 0.0)
    mean2 = np.where(indeg > 0, A @ mean1 / np.maximum(indeg, 1), 0.0)
    d = indeg + 1
    S = (A + np.eye(n)) / np.sqrt(np.outer(d, d))
    got = {r["node"]: r for r in G.propagate(xf, e, ["v"], 2, "mean").collect()}
    sym = {r["node"]: r for r in G.propagate(xf, e, ["v"], 2, "sym").collect()}
    for i in range(n):
        assert abs(got[i]["v_h1"] - mean1[i]) < 1e-12 and abs(got[i]["v_h2"] - mean2[i]) < 1e-12
        assert abs(sym[i]["v_h1"] - (S @ xv)[i]) < 1e-12 and abs(sym[i]["v_h2"] - (S @ S @ xv)[i]) < 1e-12

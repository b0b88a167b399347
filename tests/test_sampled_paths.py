"""Sampled betweenness: shares of every pair against path enumeration, error against the exact form."""
import numpy as np
from pyspark.sql import functions as F

from cases import SF01
from flowsight.operators import graph as G
from flowsight.operators import sampled_paths as P
from flowsight.sources.tables import flows


def shares_by_paths(edges, s, t):
    """Share of shortest s-t paths through each inner node, by breadth-first enumeration."""
    paths, out = [[s]], {}
    seen = {s}
    while paths:
        hit = [p for p in paths if p[-1] == t]
        if hit:
            for p in hit:
                for v in p[1:-1]:
                    out[v] = out.get(v, 0.0) + 1.0 / len(hit)
            return out
        paths = [p + [b] for p in paths for a, b in edges if a == p[-1] and b not in seen]
        seen |= {p[-1] for p in paths}
    return out


def test_shares_of_every_pair(spark):
    rng = np.random.default_rng(7)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 22, (48, 2)) if a != b} | {(30, 31), (31, 32), (32, 33), (33, 34)})
    nodes = sorted({v for e in edges for v in e})
    pairs = [(i, s, t) for i, (s, t) in enumerate((s, t) for s in nodes for t in nodes if s != t)]
    got = P.pair_shares(spark.createDataFrame(pairs, "pair long, s long, t long"), spark.createDataFrame(edges, "src long, dst long")).collect()
    have = {(r.pair, r.node): r.share for r in got}
    assert len(have) == len(got)
    want = {(i, v): x for i, s, t in pairs for v, x in shares_by_paths(edges, s, t).items()}
    assert have.keys() == want.keys() and all(abs(have[k] - want[k]) < 1e-9 for k in want)


def test_within_epsilon_of_the_exact_form(spark):
    e = G.distinct_edges(flows(spark, SF01)).checkpoint()
    got = P.betweenness_sampled(e, epsilon=0.05, batch=2000)
    both = got.join(G.betweenness(e).withColumnRenamed("betweenness", "exact"), "node", "full")
    r = both.agg(F.max(F.abs(F.col("betweenness") - F.col("exact"))).alias("off"), F.max("error").alias("error"),
                 F.count("exact").alias("n"), F.count("betweenness").alias("m"), F.max("exact").alias("top")).first()
    assert r.n == r.m and r.off <= r.error <= 0.05 and 0 < r.top, r
    assert r.off < 0.5 * r.top, r  # the largest values are told apart, not only bounded


def test_a_hub_between_all_pairs(spark):
    hub = [(i, 0) for i in range(1, 30)] + [(0, i) for i in range(1, 30)] + [(50, 51)]
    e = spark.createDataFrame(hub, "src long, dst long")
    got = {r.node: r for r in P.betweenness_sampled(e, 0.05).collect()}
    exact = {r.node: r.betweenness for r in G.betweenness(e).collect()}
    assert got.keys() == exact.keys() and exact[0] > 0.8
    assert all(abs(got[v].betweenness - exact[v]) <= got[v].error <= 0.05 for v in exact)
    assert got[0].pairs > P.betweenness_sampled(e, 0.2).first().pairs


def test_the_bound_shrinks_with_the_sample_and_small_graphs(spark):
    assert P.deviation(0.01, 4000, 100, 0.05) < P.deviation(0.01, 1000, 100, 0.05) < P.deviation(0.2, 1000, 100, 0.05)
    kinds = "src long, dst long"
    for rows in ([], [(1, 2)], [(1, 1)], [(1, None)]):
        assert all(r.betweenness == 0.0 for r in P.betweenness_sampled(spark.createDataFrame(rows, kinds)).collect())
    line = {r.node: r.betweenness for r in P.betweenness_sampled(spark.createDataFrame([(1, 2), (2, 3), (2, 3), (None, 4)], kinds), 0.2).collect()}
    assert abs(line[2] - 0.5) <= 0.2 and line[1] == line[3] == 0.0

"""Models that use order and neighbourhood (rows-only checks; brute force and quality
bounds are in tests/test_hmm.py and tests/test_sage.py)."""
from __future__ import annotations

from pyspark.sql import functions as F

from flowsight.functions.columns import r6
from flowsight.operators import graph as G
from flowsight.operators import hmm, sage
from flowsight.operators import metrics as M
from flowsight.operators.stats import exact_quantiles
from flowsight.plans.registry import register
from flowsight.sources.tables import flows


@register("sequence_hmm")
def q_sequence_hmm(spark, sf):
    """Next-event attack probability by a hidden Markov model of the sources' events.
    A symbol is attack or not and the quarter of the value; learnt from seven of ten
    sources, all events of the others are scored.  Rounds, log likelihood before the first
    and the last round, area under the curve."""
    f = flows(spark, sf).select("id", "us", "src_ip", "value", "label")
    cuts = [exact_quantiles(f, ["value"], p)["value"] for p in (0.25, 0.5, 0.75)]
    quarter = sum(((F.col("value") > c).cast("int") for c in cuts if c is not None), F.lit(0))
    attack = F.col("label") != "Normal"
    f = f.withColumn("s", quarter + F.when(attack, 4).otherwise(0))
    learnt = F.pmod(F.xxhash64("src_ip"), F.lit(10)) < 7
    m, likes = hmm.fit(hmm.stretches(f.where(learnt), "s"), 8, states=4, rounds=30)
    p = hmm.predict(hmm.stretches(f.where(~learnt), "s", context=128), m, [4, 5, 6, 7])
    auc = M.roc_auc(p.join(f.select("id", attack.alias("y")), "id"), "p_next", F.col("y"))
    return auc.select(F.lit(len(likes)).alias("rounds"), r6(F.lit(likes[0])).alias("first"),
                      r6(F.lit(likes[-1])).alias("last"), r6(F.col("auc")).alias("auc"))


@register("node_sage")
def q_node_sage(spark, sf):
    """Majority labels (D12) by two learned aggregations over node features."""
    f = flows(spark, sf)
    g = sage.Graph(G.node_matrix(f, ["value", "confidence"]), G.distinct_edges(f), G.majority_label(f),
                   ["value", "confidence", "out_degree", "in_degree"])
    w, _ = g.fit(rounds=20)
    return g.scored(w).select("node", "split", "label", "predicted", r6(F.col("node_risk")).alias("node_risk"))

"""Isolation forest (J9; Liu, Ting & Zhou 2008) as Spark jobs.

Fit: a seeded hash picks about 2 x psi candidate rows per tree (psi is at most half
the rows), a row number per tree keeps psi of them, and `groupBy(tree).applyInPandas` grows one
tree per group (a group never holds more than the candidates of one tree).
Score: the node table (trees x at most 2 psi - 1 rows, a proven bound) is
shipped to every task and `mapInPandas` walks all trees for a batch of rows at
once.  score_samples = -2^(-E[h(x)] / c(psi)); rows below the contamination
quantile of the training scores are anomalies (-1).
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsight.operators.ordering import HASH_SPACE, hash32
from flowsight.operators.stats import exact_quantile

NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "size long, depth int")


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(pdf: pd.DataFrame, d: int, seed: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    X = np.asarray(pdf["x"].tolist(), dtype=float)
    rng = np.random.default_rng(seed * 1_000_003 + tree)
    limit = int(math.ceil(math.log2(max(len(X), 2))))
    rows = []
    stack = [(np.arange(len(X)), 0, 0)]
    next_id = 1
    while stack:
        idx, node, depth = stack.pop()
        sub = X[idx]
        if depth >= limit or len(idx) <= 1:
            rows.append((tree, node, -1, 0.0, -1, -1, len(idx), depth))
            continue
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if cand.size == 0:
            rows.append((tree, node, -1, 0.0, -1, -1, len(idx), depth))
            continue
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        left, right = next_id, next_id + 1
        next_id += 2
        rows.append((tree, node, f, t, left, right, len(idx), depth))
        mask = sub[:, f] < t
        stack.append((idx[mask], left, depth + 1))
        stack.append((idx[~mask], right, depth + 1))
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])


def fit_iforest(df: DataFrame, cols: list[str], trees: int = 200, psi: int = 256, seed: int = 42,
                key: str = "id") -> tuple[DataFrame, int]:
    """Returns (node table, psi actually used)."""
    n = df.count()
    psi = max(1, min(psi, n // 2))
    x = df.select(key, F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("x"))
    # every row draws `draws` trees by hash and keeps each draw with one probability, so
    # that a tree has about 2 psi candidates; the same rule at every size
    want = 2 * psi * trees
    draws = max(1, math.ceil(want / max(n, 1)))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_j").cast("string"), F.col(key).cast("string")))
    number = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    x = (x.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
         .where(number(9) < F.lit(int(want / max(n * draws, 1) * HASH_SPACE)))
         .withColumn("tree", (number(1) % trees).cast("int")).drop("_j").dropDuplicates(["tree", key]))
    w = Window.partitionBy("tree").orderBy(hash32("tree", key, seed=seed + 1), key)
    sample = x.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= psi).select("tree", "x")
    nodes = sample.groupBy("tree").applyInPandas(lambda p: _grow(p, len(cols), seed), NODE_SCHEMA)
    return nodes, psi


def _complete(t: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, threshold, path length) of trees as complete binary trees, children of i
    at 2 i + 1 and 2 i + 2; below a leaf every way has the leaf's path length."""
    n_trees, width = int(t["tree"].max()) + 1, 2 ** (int(t["depth"].max()) + 1) - 1
    feat = np.zeros((n_trees, width), dtype=np.int64)
    thr, adj = np.zeros((n_trees, width)), np.zeros((n_trees, width))
    for tree, rows in t.groupby("tree"):
        own = {r.node: r for r in rows.itertuples(index=False)}
        stack = [(0, 0)]
        while stack:
            node, at = stack.pop()
            r = own[node]
            if r.feature >= 0:
                feat[tree, at], thr[tree, at] = r.feature, r.threshold
                stack += [(r.left, 2 * at + 1), (r.right, 2 * at + 2)]
                continue
            a = b = at
            while a < width:
                adj[tree, a:b + 1] = r.depth + c_factor(r.size)
                a, b = 2 * a + 1, 2 * b + 2
    return feat, thr, adj


def score_iforest(df: DataFrame, cols: list[str], nodes: DataFrame, psi: int, out: str = "iforest_score") -> DataFrame:
    """score_samples (higher = more normal) for every row."""
    t = nodes.toPandas().sort_values(["tree", "node"])   # bounded: trees x (2 psi - 1)
    feat, thr, adj = _complete(t)
    cpsi, depth = c_factor(psi), int(t["depth"].max())
    bc = df.sparkSession.sparkContext.broadcast((feat, thr, adj, cpsi))
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out, T.DoubleType())])

    def run(batches):
        feat, thr, adj, cpsi = bc.value
        for pdf in batches:
            X = np.ascontiguousarray(pdf[cols].to_numpy(dtype=float)).ravel()
            total = np.zeros(len(pdf))
            first = np.arange(len(pdf)) * len(cols)
            for f, t, a in zip(feat, thr, adj):
                node = np.zeros(len(pdf), dtype=np.int64)
                for _ in range(depth):
                    node = 2 * node + 2 - (X[first + f[node]] < t[node])
                total += a[node]
            pdf[out] = -np.power(2.0, -(total / feat.shape[0]) / cpsi)
            yield pdf

    return df.mapInPandas(run, schema)


def iforest_threshold(scored: DataFrame, contamination: float = 0.05, col: str = "iforest_score") -> float:
    """Offset: the contamination quantile of the training scores."""
    return exact_quantile(scored, col, contamination)

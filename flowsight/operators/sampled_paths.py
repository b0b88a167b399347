"""K4 with a stated error: betweenness from sampled pairs of nodes.

The normalised betweenness of v is the mean, over all ordered pairs (s, t), of the share of
shortest s-t paths that pass v, times n / (n - 2).  Pairs are drawn with replacement by a
seeded hash of their number; all pairs of a batch run one bidirectional breadth-first search
together, so state is the two balls around the ends of at most ``batch`` pairs, whatever the
number of nodes.  After each batch the empirical Bernstein bound, shared among all nodes and
all checks, says how far any node's mean can be off; sampling stops when that is ``epsilon``.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.operators.graph import endpoints, index_nodes


def deviation(variance: float, r: int, n: int, delta: float) -> float:
    """Largest error of n means of r values in [0, 1], none of larger sample variance, but
    with probability ``delta`` (empirical Bernstein, a share of delta a node)."""
    log = math.log(3.0 * n / delta)
    return math.sqrt(2.0 * variance * log / r) + 3.0 * log / r


def _ends(spark, first: int, count: int, n: int, seed: int) -> DataFrame:
    """(pair, s, t): ordered pairs of different node numbers, the same for the same number."""
    x = spark.range(first, first + count).withColumnRenamed("id", "pair")
    s = F.pmod(F.xxhash64("pair", F.lit(seed), F.lit(1)), F.lit(n))
    t = F.pmod(F.xxhash64("pair", F.lit(seed), F.lit(2)), F.lit(n - 1))
    return x.select("pair", s.alias("s"), (t + F.when(t >= s, 1).otherwise(0)).alias("t"))


def _step(front: DataFrame, e: DataFrame, seen: DataFrame) -> DataFrame:
    """Nodes one edge further, path counts added up, without those seen before."""
    return front.join(e, F.col("node") == F.col("a")).groupBy("pair", F.col("b").alias("node")).agg(
        F.sum("sigma").alias("sigma")).join(seen, ["pair", "node"], "left_anti")


def pair_shares(pairs: DataFrame, e: DataFrame) -> DataFrame | None:
    """(pair, node, share): share of the shortest s-t paths through each inner node; a row
    per pair and node on such a path.  ``e``: distinct edges (src, dst) without loops."""
    ways = (e.select(F.col("src").alias("a"), F.col("dst").alias("b")),
            e.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    levels = [[pairs.select("pair", F.col(c).alias("node"), F.lit(1.0).alias("sigma")).checkpoint()] for c in ("s", "t")]
    fronts, sizes = [x[0] for x in levels], [1, 1]
    cuts = []  # (forward level, backward level, rows where pairs met)
    while True:
        side = 0 if sizes[0] <= sizes[1] else 1
        seen = levels[side][0].select("pair", "node")
        for x in levels[side][1:]:
            seen = seen.unionByName(x.select("pair", "node"))
        nxt = _step(fronts[side], ways[side], seen).checkpoint()
        sizes[side] = nxt.count()
        if not sizes[side]:
            break  # whatever is left has no path
        levels[side].append(nxt)
        fronts[side] = nxt
        met = fronts[0].join(fronts[1].select("pair", "node", F.col("sigma").alias("other")), ["pair", "node"]).checkpoint()
        if met.take(1):
            cuts.append((len(levels[0]) - 1, len(levels[1]) - 1, met))
            done = met.select("pair").distinct()
            fronts = [f.join(done, "pair", "left_anti").checkpoint() for f in fronts]
            sizes = [f.count() for f in fronts]
            if not min(sizes):
                break
    if not cuts:
        return None
    shares, start = [], []
    for f, b, met in cuts:
        all_paths = met.groupBy("pair").agg(F.sum(F.col("sigma") * F.col("other")).alias("paths"))
        at = met.join(all_paths, "pair").select(
            "pair", "node", (F.col("sigma") * F.col("other") / F.col("paths")).alias("share")).checkpoint()
        start.append((f, b, at))
        shares.append(at)
    for side in (0, 1):  # from where pairs met back to each end
        front = None
        for i in range(max(x[side] for x in start), 0, -1):
            for x in start:
                if x[side] == i:
                    front = x[2] if front is None else front.unionByName(x[2])
            near = levels[side][i].join(front, ["pair", "node"]).select("pair", F.col("node").alias("b"), "share", F.col("sigma").alias("far"))
            before = levels[side][i - 1]
            front = near.join(ways[side], "b").select("pair", F.col("a").alias("node"), "share", "far") \
                .join(before, ["pair", "node"]).groupBy("pair", "node").agg(
                    F.sum(F.col("share") * F.col("sigma") / F.col("far")).alias("share")).checkpoint()
            shares.append(front)
    out = shares[0]
    for x in shares[1:]:
        out = out.unionByName(x)
    ends = pairs.select("pair", F.col("s").alias("node")).unionByName(pairs.select("pair", F.col("t").alias("node")))
    return out.join(ends, ["pair", "node"], "left_anti")


def betweenness_sampled(edges: DataFrame, epsilon: float = 0.01, delta: float = 0.05, batch: int = 20_000,
                        seed: int = 42) -> DataFrame:
    """(node, betweenness, error, pairs) of every node: each normalised value is within
    ``error`` (at most ``epsilon``) of the exact one, all at once with probability
    1 - delta.  Loops and edges with a NULL end are left out of paths; fewer than three
    nodes: 0, exactly."""
    spark = edges.sparkSession
    e = edges.where("src is not null and dst is not null").select("src", "dst").distinct().checkpoint()
    number, e = index_nodes(e)
    number, e = number.checkpoint(), e.select(F.col("src_idx").alias("src"), F.col("dst_idx").alias("dst")) \
        .where("src <> dst").checkpoint()
    n = number.count()
    scale = n / (n - 2.0) if n > 2 else 0.0
    sums, drawn, error, check = None, 0, 0.0, 0
    # two ways to stop, half of delta each: the sample's deviation, or as many pairs as any variance needs
    enough = math.ceil(math.log(4.0 * n / delta) / (2.0 * (epsilon / scale) ** 2)) if scale else 0
    target = min(enough, math.ceil(4.0 * math.log(12.0 * n / delta) * scale / epsilon)) if scale else 0
    while drawn < target:
        count = min(batch, target - drawn)
        got = pair_shares(_ends(spark, drawn, count, n, seed), e)
        drawn += count
        if got is not None:
            part = got.groupBy("node").agg(F.sum("share").alias("s"), F.sum(F.col("share") * F.col("share")).alias("q"))
            sums = (part if sums is None else sums.unionByName(part).groupBy("node").agg(F.sum("s").alias("s"), F.sum("q").alias("q"))).checkpoint()
        if drawn == target:
            check += 1
            mean = F.col("s") / drawn
            worst = (sums.agg(F.max(F.col("q") / drawn - mean * mean)).first()[0] or 0.0) if sums is not None else 0.0
            error = scale * deviation(max(worst, 0.0), drawn, n, delta / 2.0 ** (check + 1))
            if drawn >= enough:
                error = min(error, epsilon)
            if error > epsilon:
                target = min(enough, 2 * drawn)
    b = F.coalesce(F.col("s"), F.lit(0.0)) * F.lit(scale / max(drawn, 1)) if sums is not None else F.lit(0.0)
    out = number if sums is None else number.join(sums.withColumnRenamed("node", "idx"), "idx", "left")
    return out.select("node", b.alias("betweenness"), F.lit(float(error)).alias("error"), F.lit(drawn).cast("long").alias("pairs"))

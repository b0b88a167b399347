"""Communication-graph analytics as DataFrame jobs (D7-D15, B15, C5, C7, C11,
E14, F2, G2, G3, K1-K3, K5).

A graph is two DataFrames: flows (src, dst, ...) and the derived distinct
edges.  Per-node statistics are hash aggregations over the union of both
endpoint columns; no step visits one address at a time and no step collects the
graph on the driver.  Iterative PageRank cuts its lineage with reliable
checkpoints in the session's checkpoint directory.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.functions.columns import col, finite
from flowsight.operators.ordering import TASK_ROWS, global_row_number, hash32, spread


def endpoints(df: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct addresses at either end."""
    return df.select(F.col(src).alias("node")).union(df.select(F.col(dst).alias("node"))).distinct()


def distinct_edges(df: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """G3.  Pairs meet before they are compared: most differ, and a task that compared its
    share of the input first would hold nearly all of it."""
    pairs = df.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    return spread(pairs, pairs.count(), "src", "dst").distinct()


def node_degrees(edges: DataFrame) -> DataFrame:
    """In + out degree over distinct edges (a self-loop counts twice)."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(
        edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"),
                                    F.count(F.lit(1)).alias("degree"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """K1: degree / (n - 1)."""
    d = node_degrees(edges)
    n = d.count()
    return d.select("node", (F.col("degree") / F.lit(max(n - 1, 1))).alias("degree_centrality"))


def node_features(df: DataFrame, ip: str, cols: list[str]) -> DataFrame:
    """Per address mean, sample std, max and sum of each column, connection
    count; NaN/NULL statistics -> 0."""
    aggs = []
    for c in cols:
        aggs += [F.avg(col(c)).alias(f"{c}_mean"), F.stddev_samp(col(c)).alias(f"{c}_std"),
                 F.max(col(c)).alias(f"{c}_max"), F.sum(col(c)).alias(f"{c}_sum")]
    x = df.groupBy(F.col(ip).alias("node")).agg(*aggs, F.count(F.lit(1)).alias("connection_count"))
    return x.select("node", *[F.coalesce(F.nanvl(F.col(f"`{c}`"), F.lit(0.0)), F.lit(0.0)).alias(c)
                              for c in x.columns if c not in ("node", "connection_count")], "connection_count")


def edge_features(df: DataFrame, src: str, dst: str, cols: list[str]) -> DataFrame:
    """Per directed pair mean of each column and flow count, key 'src->dst'."""
    x = df.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(
        *[F.avg(col(c)).alias(f"{c}_mean") for c in cols], F.count(F.lit(1)).alias("flow_count"))
    return x.withColumn("edge_key", F.concat_ws("->", F.col("src").cast("string"), F.col("dst").cast("string")))


def static_node_features(df: DataFrame, cols: list[str], src: str = "src", dst: str = "dst") -> DataFrame:
    """Out-flows, in-flows, total, and src/dst means of the columns; outgoing
    and incoming statistics combined by a full outer join."""
    out = df.groupBy(F.col(src).alias("node")).agg(
        F.count(F.lit(1)).alias("out_flows"), *[F.avg(col(c)).alias(f"src_{c}_mean") for c in cols])
    inc = df.groupBy(F.col(dst).alias("node")).agg(
        F.count(F.lit(1)).alias("in_flows"), *[F.avg(col(c)).alias(f"dst_{c}_mean") for c in cols])
    x = out.join(inc, "node", "full")
    names = ["out_flows", "in_flows"] + [f"{p}_{c}_mean" for c in cols for p in ("src", "dst")]
    x = x.select("node", *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(n) for n in names])
    return x.withColumn("total_connections", F.col("out_flows") + F.col("in_flows"))


def flow_edges(df: DataFrame, cols: list[str], src: str = "src", dst: str = "dst") -> DataFrame:
    """One edge per flow with the columns as attributes (missing -> 0)."""
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst"),
                     *[F.coalesce(F.nanvl(col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c)
                       for c in cols])


def node_matrix(df: DataFrame, cols: list[str], src: str = "src", dst: str = "dst",
                by: list[str] = ()) -> DataFrame:
    """Per node, the sum of the columns over outgoing flows divided by
    (out + in degree), plus out and in degree; non-finite -> 0 / +-1e6.
    `by` adds grouping columns (e.g. a snapshot window id)."""
    by = list(by)
    out = df.groupBy(*by, F.col(src).alias("node")).agg(
        *[F.sum(F.coalesce(F.nanvl(col(c).cast("double"), F.lit(0.0)), F.lit(0.0))).alias(f"_s{i}")
          for i, c in enumerate(cols)], F.count(F.lit(1)).alias("out_degree"))
    inc = df.groupBy(*by, F.col(dst).alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    x = out.join(inc, by + ["node"], "full").fillna(0, ["out_degree", "in_degree"])
    conn = F.col("out_degree") + F.col("in_degree")
    conn = F.when(conn == 0, F.lit(1)).otherwise(conn)
    feats = [finite(F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) / conn).alias(c) for i, c in enumerate(cols)]
    return x.select(*by, "node", *feats, F.col("out_degree").cast("double").alias("out_degree"),
                    F.col("in_degree").cast("double").alias("in_degree"))


def majority_label(df: DataFrame, src: str = "src", label: str = "label") -> DataFrame:
    """Most frequent label over each node's outgoing flows (ties: smallest
    label).  Nodes that are never a source get no row (NULL label)."""
    c = df.groupBy(F.col(src).alias("node"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("node").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"))


def node_risk(df: DataFrame, src: str = "src", dst: str = "dst", risk: str = "risk_score") -> DataFrame:
    """Highest risk over flows at either end."""
    ends = df.select(F.col(src).alias("node"), F.col(risk).alias("r")).union(
        df.select(F.col(dst).alias("node"), F.col(risk).alias("r")))
    return ends.groupBy("node").agg(F.max("r").alias("risk"))


def risk_subgraph(nodes: DataFrame, edges: DataFrame, min_risk: float) -> tuple[DataFrame, DataFrame]:
    """Nodes with risk >= min_risk and the edges between kept nodes."""
    keep = nodes.filter(F.col("risk") >= min_risk)
    k = keep.select(F.col("node").alias("_k"))
    e = (edges.join(k, edges["src"] == k["_k"], "left_semi")
              .join(k, edges["dst"] == k["_k"], "left_semi"))
    return keep, e


def graph_stats(flows: DataFrame, src: str = "src", dst: str = "dst", risk: str = "risk_score",
                high: float = 60.0) -> DataFrame:
    """Nodes, distinct edges, average degree, nodes with risk above `high`."""
    e = distinct_edges(flows, src, dst)
    d = node_degrees(e)
    r = node_risk(flows, src, dst, risk)
    nd = d.join(r, "node")
    return nd.agg(F.count(F.lit(1)).alias("n_nodes"), (F.sum("out_degree")).alias("n_edges"),
                  F.avg("degree").alias("avg_degree"), F.count_if(F.col("risk") > high).alias("high_risk_nodes"))


def top_addresses(df: DataFrame, n: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """the n addresses with most appearances (ties: smallest address)."""
    ends = df.select(F.col(src).alias("node")).union(df.select(F.col(dst).alias("node")))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("appearances")) \
               .orderBy(F.desc("appearances"), F.asc("node")).limit(n)


def trim_to_top_nodes(df: DataFrame, n: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """The flows whose two ends are both among the n addresses with most
    appearances (with n addresses or fewer: all flows)."""
    top = top_addresses(df, n, src, dst).select(F.col("node").alias("_t"))
    return df.join(top, F.col(src) == F.col("_t"), "left_semi").join(top, F.col(dst) == F.col("_t"), "left_semi")


def index_nodes(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C11: dense 0-based node index by sorted address (any orderable type), and the
    edge index (src_idx, dst_idx)."""
    nodes = endpoints(edges)
    idx, _ = global_row_number(nodes, "node", ascending=True, out="idx")
    idx = idx.withColumn("idx", F.col("idx") - 1)
    s = idx.select(F.col("node").alias("src"), F.col("idx").alias("src_idx"))
    d = idx.select(F.col("node").alias("dst"), F.col("idx").alias("dst_idx"))
    return idx, edges.join(s, "src").join(d, "dst")


def snapshot_ids(df: DataFrame, us: str = "us", secs: int = 300, min_rows: int = 11) -> DataFrame:
    """Tumbling windows of `secs` aligned to the first event; windows with
    fewer than `min_rows` flows are dropped; an event exactly at the last
    window boundary (when it is the latest event) belongs to no window."""
    st = df.agg(F.min(us).alias("lo"), F.max(us).alias("hi")).first()
    lo, hi, w = st["lo"], st["hi"], secs * 1_000_000
    x = df.withColumn("window_id", F.expr(f"({us} - {lo}) div {w}"))
    if (hi - lo) % w == 0:
        x = x.filter(F.col(us) != F.lit(hi))
    big = x.groupBy("window_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows)
    return x.join(big.select("window_id"), "window_id", "left_semi")


def clustering(edges: DataFrame) -> DataFrame:
    """K2: local clustering coefficient on the undirected simple graph:
    2T / (d (d - 1)), 0 when d < 2.  Edges are oriented from the lower-degree
    end to the higher (ties by id), which bounds every node's out-list by
    O(sqrt(E)); triangles are closed with a semi join on the oriented edges."""
    und = edges.filter(F.col("src") != F.col("dst")).select(
        F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    deg = und.select(F.col("a").alias("n")).union(und.select(F.col("b").alias("n"))) \
             .groupBy("n").agg(F.count(F.lit(1)).alias("d"))
    da = deg.select(F.col("n").alias("a"), F.col("d").alias("da"))
    db = deg.select(F.col("n").alias("b"), F.col("d").alias("db"))
    o = und.join(da, "a").join(db, "b")
    lower_a = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    o = o.select(F.when(lower_a, F.col("a")).otherwise(F.col("b")).alias("u"),
                 F.when(lower_a, F.col("b")).otherwise(F.col("a")).alias("v"))
    wedges = o.alias("x").join(o.alias("y"), F.col("x.u") == F.col("y.u")) \
              .filter(F.col("x.v") < F.col("y.v")) \
              .select(F.col("x.u").alias("u"), F.col("x.v").alias("v"), F.col("y.v").alias("w"))
    w2 = wedges.select("u", "v", "w", F.least("v", "w").alias("p"), F.greatest("v", "w").alias("q"))
    t1 = w2.join(und, (F.col("p") == F.col("a")) & (F.col("q") == F.col("b")), "left_semi")
    tri = t1.select(F.explode(F.array("u", "v", "w")).alias("n")).groupBy("n").agg(
        F.count(F.lit(1)).alias("t"))
    x = deg.join(tri, "n", "left").fillna(0, ["t"])
    nodes = endpoints(edges).withColumnRenamed("node", "n")
    x = nodes.join(x, "n", "left").fillna(0, ["t", "d"])
    cc = F.when(F.col("d") < 2, F.lit(0.0)).otherwise(2.0 * F.col("t") / (F.col("d") * (F.col("d") - 1)))
    return x.select(F.col("n").alias("node"), cc.alias("clustering"))


def pagerank(edges: DataFrame, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-6,
             checkpoint_every: int = 2) -> DataFrame:
    """K3: PageRank on distinct directed edges with uniform teleport and dangling mass
    spread uniformly, until the L1 change of `checkpoint_every` iterations is below
    n x tol.  Ranks go to the session's checkpoint directory at that interval, which
    also bounds the plan's growth; a hub's contributions are summed before they move
    (partial aggregation), the frames that held earlier ranks are released."""
    e = edges.select("src", "dst").distinct()
    outdeg = e.groupBy("src").agg(F.count(F.lit(1)).alias("od"))
    links = e.join(outdeg, "src").select("src", "dst", (1.0 / F.col("od")).alias("w")).persist()
    nodes = endpoints(e).join(outdeg.select(F.col("src").alias("node"), F.lit(False).alias("dangling")), "node", "left") \
        .select("node", F.coalesce("dangling", F.lit(True)).alias("dangling")).persist()
    n = nodes.count()
    rank = nodes.select("node", "dangling", F.lit(1.0 / max(n, 1)).alias("pr"))
    last = rank
    for i in range(max_iter if n else 0):
        # dangling mass as a scalar subquery: the iteration stays one lazy plan
        dm = rank.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("pr"))), F.lit(0.0))).scalar()
        contrib = links.join(rank.select(F.col("node").alias("src"), "pr"), "src") \
                       .groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("pr") * F.col("w")).alias("c"))
        rank = nodes.join(contrib, "node", "left").select(
            "node", "dangling", (F.lit(alpha) * (F.coalesce(F.col("c"), F.lit(0.0)) + dm / F.lit(float(n)))
                                 + F.lit((1 - alpha) / n)).alias("pr"))
        if (i + 1) % checkpoint_every and i + 1 < max_iter:
            continue
        rank = rank.checkpoint()
        err = rank.alias("a").join(last.alias("b"), "node").agg(
            F.sum(F.abs(F.col("a.pr") - F.col("b.pr")))).first()[0]
        last = rank
        if err < n * tol:
            break
    links.unpersist()
    nodes.unpersist()
    return rank.select("node", "pr")


def attach_centrality(flows: DataFrame, cent: DataFrame, src: str = "src") -> DataFrame:
    """Per-source centralities joined onto flows, 0 when absent."""
    c = cent.withColumnRenamed("node", "_node")
    x = flows.join(c, F.col(src) == F.col("_node"), "left").drop("_node")
    return x.fillna(0, [x for x in cent.columns if x != "node"])


#: Edges that a step of all searches sends to every task, at most, and rows of a step that a
#: task adds up, about.
SENT_EDGES, STEP_ROWS = 500_000, 500_000


def _next_level(level: DataFrame, e: DataFrame) -> DataFrame:
    """(pivot, node, sigma) one edge beyond `level`, path counts added up where all rows of
    a pivot, or of a pivot and node, meet: added up before that, by the nodes they come
    from, a task would hold nearly all pairs."""
    load = level.groupBy("node").agg(F.count(F.lit(1)).alias("_n"))
    near = e.join(load, F.col("src") == F.col("node"))
    sent, rows = near.agg(F.count(F.lit(1)), F.sum("_n")).first()
    rows = rows or 0
    if sent <= SENT_EDGES:  # few rows become many here: not for the adaptive plan to join
        x = level.repartition(max(1, -(-rows // STEP_ROWS)), "pivot").join(F.broadcast(near.select("src", "dst")), F.col("node") == F.col("src"))
    else:
        x = level.join(e, F.col("node") == F.col("src"))
    x = x.select("pivot", F.col("dst").alias("node"), "sigma")
    if sent > SENT_EDGES:
        x = spread(x, rows * TASK_ROWS // STEP_ROWS, "pivot", "node")
    return x.groupBy("pivot", "node").agg(F.sum("sigma").alias("sigma"))


def betweenness(edges: DataFrame, k: int | None = None, normalized: bool = True,
                checkpoint_every: int = 4, seed: int = 42) -> DataFrame:
    """K4: directed betweenness, exact over all nodes by default; with `k` an estimate
    from k pivots chosen by a seeded hash of the node, scaled by n / k.  Brandes'
    accumulation runs for all pivots at once: a level-synchronous BFS as joins of the
    frontier with the edges (path counts summed per (pivot, node)), then dependencies
    pushed back level by level.  State is one row per (pivot, reachable node); lineage is
    checkpointed, and frames are released as their last reader ends."""
    e = edges.filter(F.col("src") != F.col("dst")).select("src", "dst").distinct().cache()
    nodes = endpoints(edges).cache()
    n = nodes.count()
    kk = n if k is None else min(k, n)
    piv = nodes.select(F.col("node").alias("pivot"))
    if kk < n:
        piv = piv.orderBy(hash32("pivot", seed=seed), "pivot").limit(kk)
    held = [e, nodes]
    level = piv.select("pivot", F.col("pivot").alias("node"), F.lit(1.0).alias("sigma"))
    levels = [level.checkpoint()]
    seen = levels[0].select("pivot", "node")
    while True:
        nxt = _next_level(levels[-1], e).join(seen, ["pivot", "node"], "left_anti")
        nxt = nxt.checkpoint() if len(levels) % checkpoint_every == 0 else nxt.cache()
        held.append(nxt)
        if not nxt.take(1):
            break
        levels.append(nxt)
        seen = seen.unionByName(nxt.select("pivot", "node"))
        if len(levels) % checkpoint_every == 0:
            seen = seen.checkpoint()
    # backward: delta(v) = sum over successors w on a shortest path of sigma(v)/sigma(w) (1 + delta(w))
    delta = levels[-1].select("pivot", "node", "sigma", F.lit(0.0).alias("delta"))
    total = None
    for d in range(len(levels) - 1, 0, -1):
        w = delta.select("pivot", F.col("node").alias("dst"), F.col("sigma").alias("sw"), F.col("delta").alias("dw"))
        prev = levels[d - 1]
        contrib = (prev.join(e, F.col("node") == F.col("src")).join(w, ["pivot", "dst"])
                   .groupBy("pivot", "node").agg(F.sum(F.col("sigma") / F.col("sw") * (1.0 + F.col("dw"))).alias("c")))
        lvl = prev.join(contrib, ["pivot", "node"], "left").select(
            "pivot", "node", "sigma", F.coalesce(F.col("c"), F.lit(0.0)).alias("delta"))
        part = lvl.filter(F.col("node") != F.col("pivot")).select("node", "delta")
        total = part if total is None else total.unionByName(part)
        delta = lvl.checkpoint() if d % checkpoint_every == 0 else lvl.cache()
        held.append(delta)
    scale = 1.0
    if normalized:
        scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    if kk < n:
        scale *= n / kk
    agg = (total.groupBy("node").agg(F.sum("delta").alias("b")) if total is not None
           else nodes.select("node", F.lit(0.0).alias("b")))
    out = nodes.join(agg, "node", "left").select(
        "node", (F.coalesce(F.col("b"), F.lit(0.0)) * F.lit(scale)).alias("betweenness")).checkpoint()
    for x in held:
        x.unpersist()
    return out


def centralities(edges: DataFrame, betweenness_pivots: int | None = None) -> DataFrame:
    """K5: degree, PageRank, betweenness and clustering of every node, one row each."""
    x = degree_centrality(edges)
    for more in (pagerank(edges).withColumnRenamed("pr", "pagerank"), betweenness(edges, betweenness_pivots),
                 clustering(edges)):
        x = x.join(more, "node", "full")
    return x.fillna(0.0, [c for c in x.columns if c != "node"])


def build_graph(flows: DataFrame, cols: list[str], src: str = "src", dst: str = "dst", top: int | None = None,
                window_secs: int | None = None, us: str = "us") -> tuple[DataFrame, DataFrame]:
    """K6: (nodes, edges) of the communication graph: node matrix and one edge per flow
    with the columns as attributes, both per snapshot where `window_secs` is given;
    `top` keeps the flows among the addresses with most appearances."""
    x = flows if top is None else trim_to_top_nodes(flows, top, src, dst)
    if window_secs is None:
        return node_matrix(x, cols, src, dst), flow_edges(x, cols, src, dst)
    x = snapshot_ids(x, us, window_secs)
    return (node_matrix(x, cols, src, dst, by=["window_id"]),
            x.select("window_id", F.col(src).alias("src"), F.col(dst).alias("dst"),
                     *[F.coalesce(F.nanvl(col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in cols]))


def propagate(x: DataFrame, edges: DataFrame, cols: list[str], hops: int = 2, norm: str = "mean") -> DataFrame:
    """J13 features: [x, A x, A^2 x] per node, messages flowing along edges
    (src -> dst).  norm='mean': average over in-neighbours (0 without any);
    norm='sym': sum over in-neighbours and the node itself of
    x_u / sqrt(d_u d_v), d = in-degree + 1.  Each hop is one join and one
    partially aggregated groupBy (hubs are combined map-side)."""
    e = edges.filter(F.col("src") != F.col("dst")).select("src", "dst").distinct()
    out = x
    cur = x.select("node", *cols)
    if norm == "sym":
        deg = e.groupBy(F.col("dst").alias("node")).agg((F.count(F.lit(1)) + 1).alias("_d"))
        deg = x.select("node").join(deg, "node", "left").fillna(1, ["_d"])
    for h in range(1, hops + 1):
        if norm == "mean":
            msg = e.join(cur.withColumnRenamed("node", "src"), "src")
            agg = msg.groupBy(F.col("dst").alias("node")).agg(*[F.avg(c).alias(c) for c in cols])
        elif norm == "sym":
            cd = cur.join(deg, "node")
            msg = e.join(cd.withColumnRenamed("node", "src").withColumnRenamed("_d", "_ds"), "src") \
                   .join(deg.withColumnRenamed("node", "dst").withColumnRenamed("_d", "_dd"), "dst")
            selfm = cd.select(F.col("node").alias("dst"), *cols, F.col("_d").alias("_ds"), F.col("_d").alias("_dd"))
            msg = msg.select("dst", *cols, "_ds", "_dd").unionByName(selfm)
            agg = msg.groupBy(F.col("dst").alias("node")).agg(
                *[F.sum(F.col(c) / F.sqrt(F.col("_ds") * F.col("_dd"))).alias(c) for c in cols])
        else:
            raise ValueError(norm)
        nxt = x.select("node").join(agg, "node", "left").fillna(0.0, cols)
        out = out.join(nxt.select("node", *[F.col(c).alias(f"{c}_h{h}") for c in cols]), "node")
        cur = nxt
    return out

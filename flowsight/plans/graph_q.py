"""Graph queries over the flows view with integer node ids (users and event
keys share the id range, so the graph has cycles and self-loops)."""
from __future__ import annotations

from pyspark.sql import functions as F

from flowsight.functions.columns import r6
from flowsight.operators import graph as G
from flowsight.plans.registry import register
from flowsight.plans.sqlparts import with_flows
from flowsight.sources.tables import flows

_E = "e AS (SELECT DISTINCT src, dst FROM flows)"
_NODES = "nodes AS (SELECT src AS node FROM flows UNION SELECT dst FROM flows)"
_DEG = """deg AS (SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree,
  count(*) AS degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node)"""


def _f(spark, sf):
    return flows(spark, sf)


@register("endpoints", with_flows(_NODES) + "SELECT node FROM nodes")
def q_endpoints(spark, sf):
    return G.endpoints(_f(spark, sf))


@register("distinct_edges", with_flows(_E) + "SELECT src, dst FROM e")
def q_edges(spark, sf):
    return G.distinct_edges(_f(spark, sf))


@register("node_degrees", with_flows(_E, _DEG) + "SELECT node, out_degree, in_degree, degree FROM deg")
def q_degrees(spark, sf):
    return G.node_degrees(G.distinct_edges(_f(spark, sf)))


@register("degree_centrality", with_flows(_E, _DEG) + """SELECT node,
  round(degree / ((SELECT count(*) FROM deg) - 1), 6) AS degree_centrality FROM deg""")
def q_degree_centrality(spark, sf):
    d = G.degree_centrality(G.distinct_edges(_f(spark, sf)))
    return d.select("node", r6(F.col("degree_centrality")).alias("degree_centrality"))


_NF = ", ".join(f"round(coalesce(avg({c}), 0), 6) AS {c}_mean, round(coalesce(stddev_samp({c}), 0), 6) AS {c}_std, "
                f"round(coalesce(max({c}), 0), 6) AS {c}_max, round(coalesce(sum({c}), 0), 6) AS {c}_sum"
                for c in ("value", "risk_score"))


@register("node_features", with_flows() + f"SELECT src AS node, {_NF}, count(*) AS connection_count FROM flows GROUP BY src")
def q_node_features(spark, sf):
    x = G.node_features(_f(spark, sf), "src", ["value", "risk_score"])
    return x.select("node", *[r6(F.col(c)).alias(c) for c in x.columns if c not in ("node", "connection_count")],
                    "connection_count")


@register("edge_features", with_flows() + """SELECT src, dst, round(avg(value), 6) AS value_mean,
  count(*) AS flow_count, CAST(src AS VARCHAR) || '->' || CAST(dst AS VARCHAR) AS edge_key
  FROM flows GROUP BY src, dst""")
def q_edge_features(spark, sf):
    x = G.edge_features(_f(spark, sf), "src", "dst", ["value"])
    return x.select("src", "dst", r6(F.col("value_mean")).alias("value_mean"), "flow_count", "edge_key")


@register("static_node_features", with_flows() + """SELECT coalesce(o.node, i.node) AS node,
  coalesce(out_flows, 0) AS out_flows, coalesce(in_flows, 0) AS in_flows,
  coalesce(out_flows, 0) + coalesce(in_flows, 0) AS total_connections,
  round(coalesce(src_value_mean, 0), 6) AS src_value_mean, round(coalesce(dst_value_mean, 0), 6) AS dst_value_mean,
  round(coalesce(src_risk_score_mean, 0), 6) AS src_risk_score_mean,
  round(coalesce(dst_risk_score_mean, 0), 6) AS dst_risk_score_mean
  FROM (SELECT src AS node, count(*) AS out_flows, avg(value) AS src_value_mean, avg(risk_score) AS src_risk_score_mean
        FROM flows GROUP BY src) o
  FULL OUTER JOIN (SELECT dst AS node, count(*) AS in_flows, avg(value) AS dst_value_mean,
        avg(risk_score) AS dst_risk_score_mean FROM flows GROUP BY dst) i ON o.node = i.node""")
def q_static_nodes(spark, sf):
    x = G.static_node_features(_f(spark, sf), ["value", "risk_score"])
    return x.select("node", "out_flows", "in_flows", "total_connections",
                    *[r6(F.col(c)).alias(c) for c in ("src_value_mean", "dst_value_mean", "src_risk_score_mean",
                                                       "dst_risk_score_mean")])


@register("flow_edges", with_flows() + "SELECT src, dst, round(value, 6) AS value, round(risk_score, 6) AS risk_score FROM flows")
def q_flow_edges(spark, sf):
    x = G.flow_edges(_f(spark, sf), ["value", "risk_score"])
    return x.select("src", "dst", r6(F.col("value")).alias("value"), r6(F.col("risk_score")).alias("risk_score"))


_NM = """nm AS (SELECT coalesce(o.node, i.node) AS node, coalesce(o.sv, 0.0) AS sv, coalesce(o.sc, 0.0) AS sc,
  CAST(coalesce(o.od, 0) AS DOUBLE) AS out_degree, CAST(coalesce(i.idg, 0) AS DOUBLE) AS in_degree FROM
  (SELECT {by}src AS node, sum(value) AS sv, sum(confidence) AS sc, count(*) AS od FROM {t} GROUP BY {by}src) o
  FULL OUTER JOIN (SELECT {by}dst AS node, count(*) AS idg FROM {t} GROUP BY {by}dst) i ON o.node = i.node{on})"""


@register("node_matrix", with_flows(_NM.format(by="", t="flows", on="")) + """SELECT node,
  round(sv / CASE WHEN out_degree + in_degree = 0 THEN 1 ELSE out_degree + in_degree END, 6) AS value,
  round(sc / CASE WHEN out_degree + in_degree = 0 THEN 1 ELSE out_degree + in_degree END, 6) AS confidence,
  out_degree, in_degree FROM nm""")
def q_node_matrix(spark, sf):
    x = G.node_matrix(_f(spark, sf), ["value", "confidence"])
    return x.select("node", r6(F.col("value")).alias("value"), r6(F.col("confidence")).alias("confidence"),
                    "out_degree", "in_degree")


@register("majority_label", with_flows() + """SELECT node, arg_min(label, (-n, label)) AS label FROM (
  SELECT src AS node, label, count(*) AS n FROM flows GROUP BY src, label) GROUP BY node""")
def q_majority(spark, sf):
    return G.majority_label(_f(spark, sf))


_NR = """nr AS (SELECT node, max(r) AS risk FROM (SELECT src AS node, risk_score AS r FROM flows
  UNION ALL SELECT dst, risk_score FROM flows) GROUP BY node)"""


@register("node_risk", with_flows(_NR) + "SELECT node, round(risk, 6) AS risk FROM nr")
def q_node_risk(spark, sf):
    return G.node_risk(_f(spark, sf)).select("node", r6(F.col("risk")).alias("risk"))


@register("graph_stats", with_flows(_E, _DEG, _NR) + """SELECT count(*) AS n_nodes, CAST(sum(out_degree) AS BIGINT) AS n_edges,
  round(avg(degree), 6) AS avg_degree, count(*) FILTER (WHERE risk > 60) AS high_risk_nodes
  FROM deg JOIN nr USING (node)""")
def q_graph_stats(spark, sf):
    s = G.graph_stats(_f(spark, sf))
    return s.select("n_nodes", "n_edges", r6(F.col("avg_degree")).alias("avg_degree"), "high_risk_nodes")


@register("risk_subgraph", with_flows(_E, _NR) + """SELECT src, dst FROM e
  WHERE src IN (SELECT node FROM nr WHERE risk >= 95) AND dst IN (SELECT node FROM nr WHERE risk >= 95)""")
def q_risk_subgraph(spark, sf):
    f = _f(spark, sf)
    _, e = G.risk_subgraph(G.node_risk(f), G.distinct_edges(f), 95.0)
    return e


@register("top_addresses", with_flows() + """SELECT node, count(*) AS appearances FROM (
  SELECT src AS node FROM flows UNION ALL SELECT dst FROM flows) GROUP BY node ORDER BY appearances DESC, node LIMIT 20""")
def q_top_addresses(spark, sf):
    return G.top_addresses(_f(spark, sf), 20)


@register("trim_to_top_nodes", with_flows("""top AS (SELECT node FROM (SELECT node, count(*) AS c FROM (
  SELECT src AS node FROM flows UNION ALL SELECT dst FROM flows) GROUP BY node ORDER BY c DESC, node LIMIT 100))""")
          + "SELECT id, src, dst FROM flows WHERE src IN (SELECT node FROM top) AND dst IN (SELECT node FROM top)")
def q_trim(spark, sf):
    return G.trim_to_top_nodes(_f(spark, sf), 100).select("id", "src", "dst")


@register("index_nodes", with_flows(_E, _NODES) + """SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx
  FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)""")
def q_index(spark, sf):
    idx, _ = G.index_nodes(G.distinct_edges(_f(spark, sf)))
    return idx.select("node", "idx")


_SNAP_W = 21600 * 1_000_000
_SNAP = f"""b AS (SELECT min(us) AS lo, max(us) AS hi FROM flows),
sw AS (SELECT f.*, (us - lo) // {_SNAP_W} AS window_id FROM flows f, b
  WHERE NOT (us = hi AND (hi - lo) % {_SNAP_W} = 0)),
big AS (SELECT window_id FROM sw GROUP BY window_id HAVING count(*) >= 11),
snap AS (SELECT * FROM sw WHERE window_id IN (SELECT window_id FROM big))"""


@register("graph_snapshots", with_flows(_SNAP, _NM.format(by="window_id, ", t="snap", on=" AND o.window_id = i.window_id")
                                        .replace("coalesce(o.node, i.node) AS node",
                                                 "coalesce(o.window_id, i.window_id) AS window_id, coalesce(o.node, i.node) AS node")
                                        .replace("SELECT window_id, src AS node", "SELECT window_id, src AS node")
                                        ) + """SELECT window_id, node,
  round(sv / CASE WHEN out_degree + in_degree = 0 THEN 1 ELSE out_degree + in_degree END, 6) AS value,
  out_degree, in_degree FROM nm""")
def q_snapshots(spark, sf):
    s = G.snapshot_ids(_f(spark, sf), "us", 21600, 11)
    x = G.node_matrix(s, ["value", "confidence"], by=["window_id"])
    return x.select("window_id", "node", r6(F.col("value")).alias("value"), "out_degree", "in_degree")


_CL = """und AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM flows WHERE src <> dst),
adj AS (SELECT a AS n, b AS m FROM und UNION ALL SELECT b, a FROM und),
cdeg AS (SELECT n, count(*) AS d FROM adj GROUP BY n),
tri AS (SELECT x.n, count(*) AS t FROM adj x JOIN adj y ON x.n = y.n AND x.m < y.m
  JOIN und u ON u.a = least(x.m, y.m) AND u.b = greatest(x.m, y.m) GROUP BY x.n),
cl AS (SELECT node, CASE WHEN coalesce(d, 0) < 2 THEN 0.0 ELSE 2.0 * coalesce(t, 0) / (d * (d - 1)) END AS clustering
  FROM nodes LEFT JOIN cdeg ON node = cdeg.n LEFT JOIN tri ON node = tri.n)"""


@register("clustering", with_flows(_NODES, _CL) + "SELECT node, round(clustering, 6) AS clustering FROM cl")
def q_clustering(spark, sf):
    c = G.clustering(G.distinct_edges(_f(spark, sf)))
    return c.select("node", r6(F.col("clustering")).alias("clustering"))


#: Steps by which the ranks have settled far below the rounding.
_PR_STEPS = 40


def _pr_ctes(alpha: float = 0.85) -> list[str]:
    parts = [_E, "prn AS (SELECT src AS node FROM e UNION SELECT dst FROM e)",
             "cnt AS (SELECT count(*) AS n FROM prn)",
             "od AS (SELECT src, count(*) AS od FROM e GROUP BY src)",
             "lk AS (SELECT e.src, e.dst, 1.0 / od AS w FROM e JOIN od USING (src))",
             "dang AS (SELECT node FROM prn WHERE node NOT IN (SELECT src FROM od))",
             "pr0 AS MATERIALIZED (SELECT node, 1.0 / (SELECT n FROM cnt) AS pr FROM prn)"]
    for i in range(1, _PR_STEPS + 1):
        p = f"pr{i - 1}"
        parts.append(f"""pr{i} AS MATERIALIZED (SELECT prn.node, {alpha} * (coalesce(c.c, 0.0) + (SELECT coalesce(sum(pr), 0.0)
  FROM {p} WHERE node IN (SELECT node FROM dang)) / (SELECT n FROM cnt)) + {1 - alpha} / (SELECT n FROM cnt) AS pr
  FROM prn LEFT JOIN (SELECT lk.dst AS node, sum(q.pr * lk.w) AS c FROM lk JOIN {p} q ON q.node = lk.src
  GROUP BY lk.dst) c ON prn.node = c.node)""")
    return parts


@register("pagerank", with_flows(*_pr_ctes()) + f"SELECT node, round(pr, 6) AS pagerank FROM pr{_PR_STEPS}")
def q_pagerank(spark, sf):
    """K3 run to a change below the rounding of the comparison (tol 1e-10 a node)."""
    r = G.pagerank(G.distinct_edges(_f(spark, sf)), tol=1e-10)
    return r.select("node", r6(F.col("pr")).alias("pagerank"))


# breadth-first levels from every node, path counts, then dependencies by pairs: the
# share of shortest s-t paths through v is sigma(s,v) sigma(v,t) / sigma(s,t)
_BW = """be AS (SELECT src, dst FROM e WHERE src <> dst),
bn AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
lv AS (SELECT s, v, min(d) AS d FROM (SELECT * FROM walk) GROUP BY s, v),
sg AS (SELECT w.s, w.v, w.d, w.sigma FROM walk w JOIN lv ON w.s = lv.s AND w.v = lv.v AND w.d = lv.d),
bw AS (SELECT a.v AS node, sum(a.sigma * b.sigma / st.sigma) AS b FROM sg a
  JOIN sg b ON a.v = b.s JOIN sg st ON st.s = a.s AND st.v = b.v AND st.d = a.d + b.d
  WHERE a.s <> a.v AND b.v <> a.v AND a.s <> b.v GROUP BY a.v)"""


def _bw_sql() -> str:
    """Level by level; a node counts at its first level only.  Twelve levels reach every
    node of these graphs (a further one adds no row)."""
    levels = ["w0 AS MATERIALIZED (SELECT node AS s, node AS v, 0 AS d, 1.0::DOUBLE AS sigma FROM bn)"]
    for i in range(1, 13):
        seen = " UNION ALL ".join(f"SELECT s, v FROM w{j}" for j in range(i))
        levels.append(f"""w{i} AS MATERIALIZED (SELECT w.s, be.dst AS v, {i} AS d, sum(w.sigma) AS sigma FROM w{i - 1} w
  JOIN be ON be.src = w.v WHERE (w.s, be.dst) NOT IN ({seen}) GROUP BY w.s, be.dst)""")
    walk = "walk AS (" + " UNION ALL ".join(f"SELECT * FROM w{i}" for i in range(13)) + ")"
    be, bn, rest = _BW.split(",\n", 2)
    return ",\n".join([be, bn, *levels, walk, rest])


_BW_OUT = """bo AS (SELECT bn.node, coalesce(b, 0.0) / (((SELECT count(*) FROM bn) - 1) * ((SELECT count(*) FROM bn) - 2.0))
  AS betweenness FROM bn LEFT JOIN bw ON bn.node = bw.node)"""


@register("betweenness", with_flows(_E, _bw_sql(), _BW_OUT) + "SELECT node, round(betweenness, 6) AS betweenness FROM bo")
def q_betweenness(spark, sf):
    """K4, exact over all nodes, normalised."""
    b = G.betweenness(G.distinct_edges(_f(spark, sf)))
    return b.select("node", r6(F.col("betweenness")).alias("betweenness"))


_EPSILON = 0.04


@register("betweenness_sampled", with_flows(_E) + """SELECT node, TRUE AS within_error, TRUE AS error_kept FROM (
  SELECT src AS node FROM e UNION SELECT dst FROM e)""")
def q_betweenness_sampled(spark, sf):
    """K4 from sampled pairs: each node's value against the exact one (``betweenness``, which
    is compared with SQL) and the error asked for."""
    from flowsight.operators.sampled_paths import betweenness_sampled
    e = G.distinct_edges(_f(spark, sf)).checkpoint()
    x = betweenness_sampled(e, _EPSILON).join(G.betweenness(e).withColumnRenamed("betweenness", "exact"), "node", "full")
    return x.select("node", F.coalesce(F.abs(F.col("betweenness") - F.col("exact")) <= F.col("error"), F.lit(False)).alias("within_error"),
                    F.coalesce(F.col("error") <= _EPSILON, F.lit(False)).alias("error_kept"))


@register("centrality_features", with_flows(_E, _DEG, _NODES, _CL, *_pr_ctes()[1:], _bw_sql(), _BW_OUT) + f"""SELECT f.id, f.src,
  round(coalesce(deg.degree / ((SELECT count(*) FROM deg) - 1), 0), 6) AS degree_centrality,
  round(coalesce(p.pr, 0), 6) AS pagerank, round(coalesce(bo.betweenness, 0), 6) AS betweenness,
  round(coalesce(cl.clustering, 0), 6) AS clustering
  FROM flows f LEFT JOIN deg ON f.src = deg.node LEFT JOIN cl ON f.src = cl.node
  LEFT JOIN pr{_PR_STEPS} p ON f.src = p.node LEFT JOIN bo ON f.src = bo.node""")
def q_centrality(spark, sf):
    """All four centralities of the source on every flow."""
    f = _f(spark, sf)
    e = G.distinct_edges(f)
    cent = G.degree_centrality(e)
    for more in (G.pagerank(e, tol=1e-10).withColumnRenamed("pr", "pagerank"), G.betweenness(e), G.clustering(e)):
        cent = cent.join(more, "node", "full")
    x = G.attach_centrality(f.select("id", "src"), cent)
    return x.select("id", "src", *[r6(F.col(c)).alias(c) for c in
                                   ("degree_centrality", "pagerank", "betweenness", "clustering")])


@register("index_address_nodes", with_flows("ae AS (SELECT DISTINCT src_ip AS src, dst_ip AS dst FROM flows)") + """SELECT node,
  row_number() OVER (ORDER BY encode(node)) - 1 AS idx FROM (SELECT src AS node FROM ae UNION SELECT dst FROM ae)""")
def q_index_addresses(spark, sf):
    """C11 on address strings."""
    idx, _ = G.index_nodes(G.distinct_edges(_f(spark, sf), "src_ip", "dst_ip"))
    return idx.select("node", "idx")


@register("build_graph", with_flows(_NM.format(by="", t="flows", on="")) + """SELECT 'node' AS part, node AS a, NULL AS b,
  round(sv / CASE WHEN out_degree + in_degree = 0 THEN 1 ELSE out_degree + in_degree END, 6) AS value FROM nm
  UNION ALL SELECT 'edge', src, dst, round(value, 6) FROM flows""")
def q_build_graph(spark, sf):
    """K6: node matrix and flow edges of the whole graph."""
    nodes, edges = G.build_graph(_f(spark, sf), ["value", "confidence"])
    return nodes.select(F.lit("node").alias("part"), F.col("node").alias("a"), F.lit(None).cast("long").alias("b"),
                        r6(F.col("value")).alias("value")).unionByName(
        edges.select(F.lit("edge").alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"),
                     r6(F.col("value")).alias("value")))

"""Operators that usually follow a fitted model, here with given coefficients and
component scores so that SQL can follow them: I4, B6, B10, J17."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flowsight import dims
from flowsight.functions.columns import r6
from flowsight.operators import clean
from flowsight.operators import ml
from flowsight.operators import risk as K
from flowsight.plans.registry import register
from flowsight.plans.sqlparts import risk_category_sql, with_feats, with_flows
from flowsight.session import ensure_checkpoint_dir, join_path
from flowsight.sources.tables import flow_features, flows
from flowsight.streaming import detector as D

_COLS = ["Tot_Fwd_Pkts", "Pkt_Len_Mean", "SYN_Flag_Cnt", "Absent"]
_SCALER = {"Tot_Fwd_Pkts": (25.5, 14.5), "Pkt_Len_Mean": (4.0, 2.5), "SYN_Flag_Cnt": (0.5, 0.5), "Absent": (0.0, 1.0)}
_MODEL = ml.LinearModel(["Brute_Force", "Normal", "Port_Scan"], _COLS,
                        [[0.9, -0.4, 0.3, 1.0], [-0.2, 0.7, -0.6, 1.0], [0.1, 0.2, 0.8, 1.0]], [0.2, 0.4, -0.3])
#: The stream's feature values: some packet lengths are missing, one column is not there.
_LEN = "CASE WHEN id % 11 = 0 THEN NULL ELSE Pkt_Len_Mean END"
_Z = [f"((coalesce({c}, 0.0) - {_SCALER[n][0]}) / {_SCALER[n][1]})" for c, n in
      (("Tot_Fwd_Pkts", "Tot_Fwd_Pkts"), (f"({_LEN})", "Pkt_Len_Mean"), ("SYN_Flag_Cnt", "SYN_Flag_Cnt"))] + ["0.0"]
_MARGINS = [" + ".join([str(b), *[f"({c}) * {z}" for c, z in zip(cs, _Z)]]) for cs, b in zip(_MODEL.coefficients, _MODEL.intercepts)]
_SCORED = f"""mg AS (SELECT id, {", ".join(f"{m} AS m{i}" for i, m in enumerate(_MARGINS))} FROM feats),
ex AS (SELECT id, exp(m0 - t) AS e0, exp(m1 - t) AS e1, exp(m2 - t) AS e2 FROM (SELECT *, greatest(m0, m1, m2) AS t FROM mg)),
pr AS (SELECT id, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM ex),
pd AS (SELECT id, p1, greatest(p0, p1, p2) AS top, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'Brute_Force'
  WHEN p1 >= p2 THEN 'Normal' ELSE 'Port_Scan' END AS pred, least(greatest((1.0 - p1) * 100.0, 0.0), 100.0) AS risk FROM pr),
gt AS (SELECT *, pred <> 'Normal' AND top < {dims.MIN_ATTACK_CONFIDENCE} AS gate FROM pd)"""


@register("score_given", with_feats(_SCORED) + f"""SELECT id,
  CASE WHEN gate OR (pred <> 'Normal' AND risk < {dims.MIN_ATTACK_RISK}) THEN 'Normal' ELSE pred END AS predicted_attack,
  round(CASE WHEN gate THEN p1 ELSE top END, 6) AS confidence, round(risk, 6) AS risk_score,
  {risk_category_sql("risk")} AS risk_label FROM gt""")
def q_score_given(spark, sf):
    """I4/B10 with a given model and scaler: every row of the stream, its gates, risk and
    category; missing values and a missing column count as 0."""
    base = join_path(ensure_checkpoint_dir(spark), "given-" + uuid.uuid4().hex)
    f = flow_features(spark, sf).select("id", "SYN_Flag_Cnt", F.when(F.col("id") % 11 != 0, F.col("Pkt_Len_Mean")).alias("Pkt_Len_Mean"),
                                        "Tot_Fwd_Pkts")
    f.repartition(4).write.parquet(join_path(base, "in"))
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 2).parquet(join_path(base, "in"))
    out = join_path(base, "out")
    (D.score_stream(stream, _MODEL, _COLS, _SCALER).writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", out + "-ck").outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(out).select("id", "predicted_attack", r6(F.col("confidence")).alias("confidence"),
                                          r6(F.col("risk_score")).alias("risk_score"), "risk_label")


@register("drop_identity", with_flows() + """SELECT id, value, dst_port AS "Source_Port", CAST(0.0 AS DOUBLE) AS absent,
  CASE WHEN id % 7 = 0 THEN 0.0 ELSE confidence END AS partly FROM flows""")
def q_drop_identity(spark, sf):
    """Planted identity columns go, the trained columns come in their order,
    missing ones as 0."""
    f = flows(spark, sf)
    planted = f.select("id", "value", F.col("dst_port").alias("Source_Port"), *[F.col("src_ip").alias(c) for c in dims.IDENTITY_COLUMNS],
                       F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("confidence")).alias("partly"))
    kept = clean.drop_identity_columns(planted)
    aligned = clean.align_features(kept, ["partly", "absent"], keep=[c for c in kept.columns if c != "partly"])
    return aligned


_W = dims.ENSEMBLE_WEIGHTS
_GIVEN = f"""gv AS (SELECT id, least(value / 500.0, 1.0) AS c, CASE WHEN src % 3 <> 0 THEN (src % 100) / 100.0 END AS g,
  CASE WHEN id % 4 <> 0 THEN (id % 10) / 10.0 END AS s, CASE WHEN id % 5 <> 0 THEN value / 100.0 END AS a0 FROM flows),
q99 AS (SELECT quantile_cont(a0, 0.99) AS p99 FROM gv),
gw AS (SELECT *, least(greatest(a0 / p99, 0.0), 1.0) AS a FROM gv, q99),
gr AS (SELECT id, least(greatest((coalesce(c * {_W["classifier"]}, 0.0) + coalesce(g * {_W["gnn"]}, 0.0) + coalesce(s * {_W["temporal"]}, 0.0)
  + coalesce(a * {_W["autoencoder"]}, 0.0)) / ({_W["classifier"]} + CASE WHEN g IS NULL THEN 0.0 ELSE {_W["gnn"]} END
  + CASE WHEN s IS NULL THEN 0.0 ELSE {_W["temporal"]} END + CASE WHEN a IS NULL THEN 0.0 ELSE {_W["autoencoder"]} END)
  * 100.0, 0.0), 100.0) AS risk FROM gw)"""


@register("batch_risk_given", with_flows(_GIVEN) + f"""SELECT id, round(risk, 6) AS risk_score,
  {risk_category_sql("round(risk, 9)")} AS risk_label FROM gr""")
def q_batch_risk_given(spark, sf):
    """J17 with given component scores, some of them missing."""
    f = flows(spark, sf)
    nodes = f.select("src").distinct().where("src % 3 <> 0").select("src", ((F.col("src") % 100) * 1.0).alias("graph"))
    parts = {"classifier": (f.select("id", F.least(F.col("value") / 500.0, F.lit(1.0)).alias("classifier")), "id"),
             "graph": (nodes, "src"),
             "sequence": (f.where("id % 4 <> 0").select("id", ((F.col("id") % 10) / 10.0).alias("sequence")), "id"),
             "anomaly": (f.where("id % 5 <> 0").select("id", (F.col("value") / 100.0).alias("anomaly")), "id")}
    x = K.batch_risk(f.select("id", "src"), parts)
    return x.select("id", r6(F.col("risk_score")).alias("risk_score"), K.risk_category(F.round("risk_score", 9)).alias("risk_label"))

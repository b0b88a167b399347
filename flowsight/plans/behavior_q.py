"""Behavioural detection queries over the `flows` view (E8-E11, B13-B14, C12,
H20, I6, I7).  Window and thresholds are sized for the test data's density:
24 h frames and thresholds 6 / 5 / 3 (defaults 30 s / 60 / 25 / 25)."""
from __future__ import annotations

from pyspark.sql import functions as F

from flowsight.functions.columns import r6
from flowsight.operators import behavior as B
from flowsight.plans.registry import register
from flowsight.plans.sqlparts import safe_ip_sql, verdict_cte, with_flows
from flowsight.sources.tables import flows

SECS, FLOOD, SCAN, BRUTE = 86400, 6, 5, 3
_BASE = ["id", "us", "src_ip", "dst_ip", "dst_port"]
_SCORED = _BASE + ["src_port", "predicted_attack", "confidence", "risk_score", "risk_label"]


def verdicts(spark, sf, cols=_BASE):
    return B.behavioral_verdict(flows(spark, sf).select(*cols), SECS, FLOOD, SCAN, BRUTE)


def merged(spark, sf):
    return B.behavioral_override(verdicts(spark, sf, _SCORED))


_W = SECS * 1_000_000
_FRAME = f"ORDER BY us RANGE BETWEEN {_W - 1} PRECEDING AND CURRENT ROW"
_SAFE = f"({safe_ip_sql('src_ip')} OR {safe_ip_sql('dst_ip')})"
_V = verdict_cte(SECS, FLOOD, SCAN, BRUTE)
_MERGED = f"""merged AS (
  SELECT *, (behavioral_attack IS NOT NULL AND predicted_attack = 'Normal') AS fire,
         greatest(risk_score, 75.0 + behavioral_confidence * 25.0) AS new_risk
  FROM verdict),
final AS (
  SELECT id, src_ip, src_port, dst_ip, dst_port,
    CASE WHEN fire THEN behavioral_attack ELSE predicted_attack END AS predicted_attack,
    CASE WHEN fire THEN behavioral_confidence ELSE confidence END AS confidence,
    CASE WHEN fire THEN new_risk ELSE risk_score END AS risk_score,
    CASE WHEN fire THEN (CASE WHEN new_risk >= 81 THEN 'Critical' ELSE 'High' END) ELSE risk_label END AS risk_label,
    fire AS behavior_override
  FROM merged)"""


@register("drop_safe_flows", with_flows() + f"SELECT id, src_ip, dst_ip FROM flows WHERE NOT {_SAFE}")
def q_drop_safe(spark, sf):
    return B.drop_safe_flows(flows(spark, sf)).select("id", "src_ip", "dst_ip")


_NONROUTE = " OR ".join(f"starts_with({c}, '{p}')" for c in ("src_ip", "dst_ip")
                        for p in __import__("flowsight.dims", fromlist=["x"]).SAFE_IP_PREFIXES)


@register("drop_nonroutable", with_flows() + f"SELECT id, src_ip, dst_ip FROM flows WHERE NOT ({_NONROUTE})")
def q_drop_nonroutable(spark, sf):
    return B.drop_nonroutable(flows(spark, sf)).select("id", "src_ip", "dst_ip")


@register("src_rate", with_flows() + f"""SELECT id, src_ip,
  count(*) OVER (PARTITION BY src_ip {_FRAME}) AS src_rate FROM flows""")
def q_src_rate(spark, sf):
    f = flows(spark, sf).select("id", "us", "src_ip")
    return B.src_rate(f, SECS).select("id", "src_ip", "src_rate")


@register("src_fanout", with_flows() + f"""SELECT id, src_ip,
  count(DISTINCT dst_ip) OVER (PARTITION BY src_ip {_FRAME}) AS src_fanout FROM flows""")
def q_src_fanout(spark, sf):
    f = flows(spark, sf).select("id", "us", "src_ip", "dst_ip")
    return B.src_fanout(f, SECS).select("id", "src_ip", "src_fanout")


@register("auth_rate", with_flows() + f"""SELECT id, dst_ip, dst_port,
  CASE WHEN dst_port IN (21, 22, 23, 3389, 5900)
       THEN count(*) OVER (PARTITION BY dst_ip, dst_port {_FRAME}) END AS auth_count FROM flows""")
def q_auth_rate(spark, sf):
    f = flows(spark, sf).select("id", "us", "dst_ip", "dst_port")
    return B.auth_rate(f, SECS).select("id", "dst_ip", "dst_port", "auth_count")


@register("behavioral_verdict", with_flows(_V) + """SELECT id, src_ip, dst_ip, dst_port,
  src_rate, src_fanout, auth_count, behavioral_attack,
  round(behavioral_confidence, 6) AS behavioral_confidence, behavioral_reason FROM verdict""")
def q_verdict(spark, sf):
    return verdicts(spark, sf).select(
        "id", "src_ip", "dst_ip", "dst_port", "src_rate", "src_fanout", "auth_count",
        "behavioral_attack", r6(F.col("behavioral_confidence")).alias("behavioral_confidence"),
        "behavioral_reason")


@register("merge_verdicts", with_flows(_V, _MERGED) + """SELECT id, predicted_attack,
  round(confidence, 6) AS confidence, round(risk_score, 6) AS risk_score, risk_label,
  behavior_override FROM final""")
def q_merge(spark, sf):
    return merged(spark, sf).select(
        "id", "predicted_attack", r6(F.col("confidence")).alias("confidence"),
        r6(F.col("risk_score")).alias("risk_score"), "risk_label", "behavior_override")


@register("threat_summary", with_flows(_V, _MERGED) + """SELECT predicted_attack, risk_label,
  count(*) AS n_flows, CAST(sum(CASE WHEN behavior_override THEN 1 ELSE 0 END) AS BIGINT) AS n_behavioral,
  round(avg(risk_score), 6) AS avg_risk FROM final GROUP BY predicted_attack, risk_label""")
def q_threat_summary(spark, sf):
    """Flagship: final verdict distribution after the behavioural override."""
    return (merged(spark, sf).groupBy("predicted_attack", "risk_label")
            .agg(F.count(F.lit(1)).alias("n_flows"),
                 F.sum(F.col("behavior_override").cast("long")).alias("n_behavioral"),
                 r6(F.avg("risk_score")).alias("avg_risk")))


@register("route_alerts", with_flows(_V, _MERGED) + """SELECT id, src_ip, predicted_attack, risk_label,
  CASE WHEN risk_label = 'Critical' THEN 'block_and_alert' ELSE 'alert' END AS action
  FROM final WHERE predicted_attack <> 'Normal' AND risk_label IN ('Critical', 'High')""")
def q_route_alerts(spark, sf):
    from flowsight.operators.reports import route_alerts
    return route_alerts(merged(spark, sf)).select("id", "src_ip", "predicted_attack", "risk_label", "action")


@register("block_list", with_flows(_V, _MERGED) + """SELECT src_ip, arg_min(predicted_attack, id) AS attack_type,
  min(id) AS first_id, count(*) AS n_critical
  FROM final WHERE predicted_attack <> 'Normal' AND risk_label = 'Critical' GROUP BY src_ip""")
def q_block_list(spark, sf):
    from flowsight.operators.reports import block_list
    return block_list(merged(spark, sf))

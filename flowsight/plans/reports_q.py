"""Monitoring / report queries over the `flows` view (the live flow table)."""
from __future__ import annotations

from pyspark.sql import functions as F

from flowsight import dims
from flowsight.functions.columns import r6
from flowsight.operators import reports as R
from flowsight.plans.behavior_q import _MERGED, _V, merged
from flowsight.plans.registry import register
from flowsight.plans.sqlparts import sql_list, with_flows
from flowsight.sources.tables import flows

_F = with_flows()


@register("value_counts", _F + "SELECT label, count(*) AS n FROM flows GROUP BY label")
def q_value_counts(spark, sf):
    return R.value_counts(flows(spark, sf), "label")


@register("class_weights", _F + """SELECT label, n_c,
  round(sum(n_c) OVER () / (count(*) OVER () * n_c), 6) AS weight
  FROM (SELECT label, count(*) AS n_c FROM flows GROUP BY label)""")
def q_class_weights(spark, sf):
    w = R.class_weights(flows(spark, sf), "label")
    return w.select("label", "n_c", r6(F.col("weight")).alias("weight"))


@register("flow_stats", _F + """SELECT count(*) AS total,
  count(*) FILTER (WHERE predicted_attack <> 'Normal') AS threats,
  count(*) FILTER (WHERE risk_label = 'Critical') AS critical FROM flows""")
def q_flow_stats(spark, sf):
    return R.flow_stats(flows(spark, sf))


@register("risk_summary", _F + """SELECT round(avg(risk_score), 6) AS avg_risk,
  round(max(risk_score), 6) AS peak_risk, count(*) AS n_flows FROM flows""")
def q_risk_summary(spark, sf):
    r = R.risk_summary(flows(spark, sf))
    return r.select(r6(F.col("avg_risk")).alias("avg_risk"), r6(F.col("peak_risk")).alias("peak_risk"), "n_flows")


@register("attack_distribution", _F + """SELECT predicted_attack, n, round(n / sum(n) OVER (), 6) AS share
  FROM (SELECT predicted_attack, count(*) AS n FROM flows WHERE predicted_attack <> 'Normal'
        GROUP BY predicted_attack)""")
def q_attack_distribution(spark, sf):
    d = R.attack_distribution(flows(spark, sf))
    return d.select("predicted_attack", "n", r6(F.col("share")).alias("share"))


@register("dominant_attack", _F + """SELECT predicted_attack, count(*) AS n FROM flows
  WHERE predicted_attack <> 'Normal' GROUP BY predicted_attack ORDER BY n DESC, predicted_attack LIMIT 1""")
def q_dominant_attack(spark, sf):
    return R.dominant_attack(flows(spark, sf))


_LEVELS = " UNION ALL ".join(f"SELECT '{lvl}' AS risk_label" for lvl in dims.RISK_LEVELS)


@register("risk_level_counts", _F + f"""SELECT l.risk_label, CAST(coalesce(c.n, 0) AS BIGINT) AS n
  FROM ({_LEVELS}) l LEFT JOIN (SELECT risk_label, count(*) AS n FROM flows GROUP BY risk_label) c
  USING (risk_label)""")
def q_risk_level_counts(spark, sf):
    return R.risk_level_counts(flows(spark, sf))


_PHASES = " UNION ALL ".join(f"SELECT {i} AS phase_order, '{p}' AS phase, '{a}' AS attacks"
                             for i, (p, a) in enumerate(dims.KILL_CHAIN))


@register("kill_chain_counts", _F + f"""SELECT p.phase_order, p.phase,
  CAST(count(f.id) AS BIGINT) AS n
  FROM ({_PHASES}) p LEFT JOIN flows f ON contains(p.attacks, f.predicted_attack)
  GROUP BY p.phase_order, p.phase""")
def q_kill_chain(spark, sf):
    return R.kill_chain_counts(flows(spark, sf))


@register("timeline", _F + """SELECT id, predicted_attack, round(risk_score, 6) AS risk_score,
  row_number() OVER (ORDER BY id DESC) - 1 AS seq FROM flows""")
def q_timeline(spark, sf):
    t = R.timeline(flows(spark, sf).select("id", "predicted_attack", "risk_score"))
    return t.select("id", "predicted_attack", r6(F.col("risk_score")).alias("risk_score"), "seq")


_WIN = """win AS (SELECT id, predicted_attack,
  (row_number() OVER (ORDER BY id DESC) - 1) // greatest(1, (SELECT count(*) FROM flows) // 20) + 1 AS window_no
  FROM flows)"""


@register("row_windows", with_flows(_WIN) + "SELECT id, window_no, 'W' || window_no AS window FROM win")
def q_row_windows(spark, sf):
    x, _ = R.row_windows(flows(spark, sf).select("id"))
    return x.select("id", "window_no", "window")


_ATT = " UNION ALL ".join(f"SELECT '{a}' AS attack" for a in dims.ATTACK_LABELS)


@register("attack_density", with_flows(_WIN) + f"""SELECT w.window_no, 'W' || w.window_no AS window, a.attack,
  CAST(sum(CASE WHEN w.predicted_attack = a.attack THEN 1 ELSE 0 END) AS BIGINT) AS n
  FROM win w CROSS JOIN ({_ATT}) a GROUP BY w.window_no, a.attack""")
def q_attack_density(spark, sf):
    return R.attack_density(flows(spark, sf))


_FLOWCOLS = "id, src_ip, src_port, dst_ip, dst_port, predicted_attack, risk_label, round(risk_score, 6) AS risk_score"


def _flowcols(df):
    return df.select("id", "src_ip", "src_port", "dst_ip", "dst_port", "predicted_attack", "risk_label",
                     r6(F.col("risk_score")).alias("risk_score"))


@register("recent_flows", _F + f"SELECT {_FLOWCOLS} FROM flows ORDER BY id DESC LIMIT 50")
def q_recent(spark, sf):
    return _flowcols(R.recent_flows(flows(spark, sf), 50))


@register("top_risk", _F + f"SELECT {_FLOWCOLS} FROM flows ORDER BY risk_score DESC, id DESC LIMIT 15")
def q_top_risk(spark, sf):
    return _flowcols(R.top_risk(flows(spark, sf), 15))


@register("latest_attack", _F + f"""SELECT {_FLOWCOLS} FROM flows WHERE predicted_attack <> 'Normal'
  ORDER BY id DESC LIMIT 1""")
def q_latest_attack(spark, sf):
    return _flowcols(R.latest_attack(flows(spark, sf)))


@register("latest_per_flow", _F + """SELECT src_ip, src_port, dst_ip, dst_port, max(id) AS id,
  arg_max(predicted_attack, id) AS predicted_attack, round(arg_max(risk_score, id), 6) AS risk_score
  FROM flows GROUP BY src_ip, src_port, dst_ip, dst_port""")
def q_latest_per_flow(spark, sf):
    f = flows(spark, sf).select("src_ip", "src_port", "dst_ip", "dst_port", "id", "predicted_attack", "risk_score")
    x = R.latest_per_flow(f)
    return x.select("src_ip", "src_port", "dst_ip", "dst_port", "id", "predicted_attack",
                    r6(F.col("risk_score")).alias("risk_score"))


_UPD = """targets AS (SELECT src_ip, src_port, dst_ip, dst_port, max(id) AS target FROM flows
  GROUP BY src_ip, src_port, dst_ip, dst_port),
upd AS (SELECT src_ip, src_port, dst_ip, dst_port, arg_max(predicted_attack, id) AS n_pa,
  arg_max(risk_score, id) AS n_rs, arg_max(risk_label, id) AS n_rl, arg_max(confidence, id) AS n_cf
  FROM final WHERE behavior_override GROUP BY src_ip, src_port, dst_ip, dst_port),
patch AS (SELECT t.target AS id, n_pa, n_rs, n_rl, n_cf FROM targets t JOIN upd u
  USING (src_ip, src_port, dst_ip, dst_port))"""


@register("update_latest", with_flows(_V, _MERGED, _UPD) + """SELECT f.id,
  CASE WHEN p.id IS NOT NULL THEN n_pa ELSE f.predicted_attack END AS predicted_attack,
  round(CASE WHEN p.id IS NOT NULL THEN n_rs ELSE f.risk_score END, 6) AS risk_score,
  CASE WHEN p.id IS NOT NULL THEN n_rl ELSE f.risk_label END AS risk_label,
  round(CASE WHEN p.id IS NOT NULL THEN n_cf ELSE f.confidence END, 6) AS confidence,
  p.id IS NOT NULL AS updated
  FROM flows f LEFT JOIN patch p ON f.id = p.id""")
def q_update_latest(spark, sf):
    base = flows(spark, sf).select("id", "src_ip", "src_port", "dst_ip", "dst_port",
                                   "predicted_attack", "risk_score", "risk_label", "confidence")
    upd = merged(spark, sf).filter("behavior_override")
    x = R.update_latest(base, upd, ["predicted_attack", "risk_score", "risk_label", "confidence"])
    return x.select("id", "predicted_attack", r6(F.col("risk_score")).alias("risk_score"), "risk_label",
                    r6(F.col("confidence")).alias("confidence"), "updated")


_IP = "69.0.0.1"


@register("flows_touching", _F + f"SELECT id, src_ip, dst_ip FROM flows WHERE src_ip = '{_IP}' OR dst_ip = '{_IP}'")
def q_flows_touching(spark, sf):
    return R.flows_touching(flows(spark, sf), _IP).select("id", "src_ip", "dst_ip")


@register("attention_flag", _F + """SELECT id, CASE WHEN predicted_attack <> 'Normal' THEN 'attack'
  WHEN risk_label = 'Medium' THEN 'warning' ELSE 'none' END AS attention FROM flows""")
def q_attention(spark, sf):
    return R.attention_flag(flows(spark, sf)).select("id", "attention")


@register("alert_view", _F + """SELECT ts AS "Time", src_ip AS "Source", dst_ip AS "Target",
  predicted_attack AS "Attack Type", risk_label AS "Severity", round(risk_score, 6) AS "Risk Score",
  round(confidence, 6) AS "Confidence" FROM flows WHERE predicted_attack <> 'Normal'""")
def q_alert_view(spark, sf):
    v = R.alert_view(R.attack_rows(flows(spark, sf)))
    return v.select("Time", "Source", "Target", "Attack Type", "Severity",
                    r6(F.col("`Risk Score`")).alias("Risk Score"), r6(F.col("Confidence")).alias("Confidence"))


@register("canonicalize_labels", _F + f"""SELECT f.id, f.raw_label, coalesce(d.label, 'Normal') AS label
  FROM flows f LEFT JOIN (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in dims.EVENT_LABEL_MAP.items())}) t(raw, label)) d
  ON f.raw_label = d.raw""")
def q_canonicalize(spark, sf):
    from flowsight.operators.clean import canonicalize_labels
    d = dims.label_map_dim(spark, dims.EVENT_LABEL_MAP)
    return canonicalize_labels(flows(spark, sf).select("id", "raw_label"), d, "raw_label").select(
        "id", "raw_label", "label")


@register("unmapped_labels", _F + f"""SELECT raw_label, count(*) AS n FROM flows
  WHERE raw_label NOT IN ({sql_list(dims.EVENT_LABEL_MAP)}) GROUP BY raw_label""")
def q_unmapped(spark, sf):
    from flowsight.operators.clean import unmapped_labels
    d = dims.label_map_dim(spark, dims.EVENT_LABEL_MAP)
    return unmapped_labels(flows(spark, sf), d, "raw_label")


_TRAINED = ["Normal", "Brute_Force", "Port_Scan", "HTTP_DDoS"]


@register("recode_unknown", _F + f"""SELECT id, CASE WHEN label IN ({sql_list(_TRAINED)}) THEN label
  ELSE 'Normal' END AS label FROM flows""")
def q_recode(spark, sf):
    from flowsight.operators.clean import recode_unknown
    return recode_unknown(flows(spark, sf), _TRAINED, "label").select("id", "label")


@register("traffic_view", _F + """SELECT src_ip, src_port, dst_ip, dst_port, protocol, predicted_attack, risk_label,
  round(risk_score, 6) AS risk_score, round(confidence, 6) AS confidence FROM flows""")
def q_traffic_view(spark, sf):
    """The live stream's projection."""
    v = R.traffic_view(flows(spark, sf)).drop("ts")
    return v.withColumns({c: r6(F.col(c)) for c in ("risk_score", "confidence")})


@register("join_verdicts", with_flows(_V, _MERGED) + """SELECT id, predicted_attack, round(risk_score, 6) AS risk_score,
  risk_label, behavior_override FROM final""")
def q_join_verdicts(spark, sf):
    """Verdicts computed apart joined onto the flows by id, then merged."""
    from flowsight.operators.behavior import merge_verdicts
    from flowsight.plans.behavior_q import verdicts
    v = verdicts(spark, sf).select("id", "behavioral_attack", "behavioral_confidence", "behavioral_reason")
    x = merge_verdicts(flows(spark, sf), v)
    return x.select("id", "predicted_attack", r6(F.col("risk_score")).alias("risk_score"), "risk_label", "behavior_override")

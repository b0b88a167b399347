"""Evaluation, risk and sampling queries (D17-D24, H11-H15, H19, A6, J1, J4) over
deterministic pseudo-predictions derived from the flows view."""
from __future__ import annotations

from pyspark.sql import functions as F

from flowsight import dims
from flowsight.functions.columns import anomaly01, r6
from flowsight.operators import metrics as M
from flowsight.operators import risk as K
from flowsight.operators.stats import exact_quantile
from flowsight.plans.registry import register
from flowsight.plans.sqlparts import risk_category_sql, sql_list, with_flows
from flowsight.sources.tables import flows

_L = dims.ATTACK_LABELS


def predictions(spark, sf):
    f = flows(spark, sf)
    wrong = F.element_at(F.array(*[F.lit(x) for x in _L]), (F.col("id") % len(_L) + 1).cast("int"))
    pred = F.when((F.col("id") * 7) % 10 < 8, F.col("label")).otherwise(wrong)
    vint = F.floor(F.col("value") * 100).cast("long")
    score = ((vint % 50) + F.when(F.col("label") != "Normal", 30).otherwise(0)) / 100.0
    cols = [F.col("id"), F.col("label"), pred.alias("prediction"), score.alias("score")]
    for c in _L:
        cols.append((F.when(pred == c, 0.7).otherwise(0.06) + (vint % 7) / 1000.0).alias(f"p_{c}"))
    return f.select(*cols)


_PRED = f"""pred AS (SELECT id, label,
  CASE WHEN (id * 7) % 10 < 8 THEN label ELSE [{sql_list(_L)}][id % {len(_L)} + 1] END AS prediction,
  ((CAST(floor(value * 100) AS BIGINT) % 50) + CASE WHEN label <> 'Normal' THEN 30 ELSE 0 END) / 100.0 AS score,
  CAST(floor(value * 100) AS BIGINT) % 7 AS v7 FROM flows),
cls AS (SELECT DISTINCT c FROM (SELECT label AS c FROM pred UNION ALL SELECT prediction FROM pred)),
cm AS (SELECT a.c AS actual, p.c AS predicted, CAST(count(x.id) AS BIGINT) AS n
  FROM cls a CROSS JOIN cls p LEFT JOIN pred x ON x.label = a.c AND x.prediction = p.c GROUP BY a.c, p.c),
pc AS (SELECT c AS class,
  (SELECT n FROM cm WHERE actual = c AND predicted = c) AS tp,
  (SELECT sum(n) FROM cm WHERE predicted = c) AS n_pred,
  (SELECT sum(n) FROM cm WHERE actual = c) AS support FROM cls),
rep AS (SELECT class, tp, support,
  CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM pc),
rep2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
  ELSE 0.0 END AS f1 FROM rep)"""
_W = with_flows(_PRED)


@register("confusion_matrix", _W + "SELECT actual, predicted, n FROM cm")
def q_cm(spark, sf):
    return M.confusion_matrix(predictions(spark, sf)).select("actual", "predicted", "n")


@register("confusion_normalized", _W + """SELECT actual, predicted, n,
  round(coalesce(n / nullif(sum(n) OVER (PARTITION BY actual), 0), 0.0), 6) AS rate FROM cm""")
def q_cm_norm(spark, sf):
    c = M.confusion_matrix(predictions(spark, sf), normalize=True)
    return c.select("actual", "predicted", "n", r6(F.col("rate")).alias("rate"))


@register("classification_report", _W + """SELECT class, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM rep2""")
def q_report(spark, sf):
    r = M.classification_report(M.confusion_matrix(predictions(spark, sf)))
    return r.select("class", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")],
                    F.col("support").cast("long").alias("support"))


@register("classification_metrics", _W + """SELECT round(sum(tp) / sum(support), 6) AS accuracy,
  round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro,
  round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM rep2""")
def q_metrics(spark, sf):
    m = M.classification_metrics(M.confusion_matrix(predictions(spark, sf)))
    return m.select(*[r6(F.col(c)).alias(c) for c in m.columns])


@register("binary_metrics", _W + """SELECT tp, fp, fn, tn,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
  round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM (
  SELECT count(*) FILTER (WHERE label <> 'Normal' AND prediction <> 'Normal') AS tp,
         count(*) FILTER (WHERE label = 'Normal' AND prediction <> 'Normal') AS fp,
         count(*) FILTER (WHERE label <> 'Normal' AND prediction = 'Normal') AS fn,
         count(*) FILTER (WHERE label = 'Normal' AND prediction = 'Normal') AS tn FROM pred)""")
def q_binary(spark, sf):
    p = predictions(spark, sf).select((F.col("label") != "Normal").alias("a"),
                                      (F.col("prediction") != "Normal").alias("p"))
    b = M.binary_metrics(p, "a", "p")
    return b.select("tp", "fp", "fn", "tn", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


_AUC = """sc AS (SELECT score, count(*) FILTER (WHERE label <> 'Normal') AS np,
  count(*) FILTER (WHERE label = 'Normal') AS nn FROM pred GROUP BY score)"""


@register("roc_auc", with_flows(_PRED, _AUC) + """SELECT round(sum(np * (nb + 0.5 * nn)) / (sum(np) * sum(nn)), 6) AS auc
  FROM (SELECT *, coalesce(sum(nn) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
  FROM sc)""")
def q_auc(spark, sf):
    a = M.roc_auc(predictions(spark, sf), "score", F.col("label") != "Normal")
    return a.select(r6(F.col("auc")).alias("auc"))


@register("roc_curve", with_flows(_PRED, _AUC) + """SELECT score AS threshold,
  round(sum(np) OVER (ORDER BY score DESC) / sum(np) OVER (), 6) AS tpr,
  round(sum(nn) OVER (ORDER BY score DESC) / sum(nn) OVER (), 6) AS fpr FROM sc""")
def q_roc(spark, sf):
    r = M.roc_curve(predictions(spark, sf), "score", F.col("label") != "Normal")
    return r.select("threshold", r6(F.col("tpr")).alias("tpr"), r6(F.col("fpr")).alias("fpr"))


_OVR = " UNION ALL ".join(
    f"""SELECT '{c}' AS class, sum(np * (nb + 0.5 * nn)) / nullif(sum(np) * sum(nn), 0) AS auc FROM (
  SELECT *, coalesce(sum(nn) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM (
  SELECT (CASE WHEN prediction = '{c}' THEN 0.7 ELSE 0.06 END) + v7 / 1000.0 AS s,
         count(*) FILTER (WHERE label = '{c}') AS np, count(*) FILTER (WHERE label <> '{c}') AS nn
  FROM pred GROUP BY s))""" for c in _L)


@register("roc_auc_ovr", _W + f"""SELECT round(avg(auc), 6) AS roc_auc_ovr, count(*) AS n_classes
  FROM ({_OVR}) WHERE auc IS NOT NULL""")
def q_auc_ovr(spark, sf):
    a = M.roc_auc_ovr(predictions(spark, sf), "label", {c: f"p_{c}" for c in _L})
    return a.select(r6(F.col("roc_auc_ovr")).alias("roc_auc_ovr"), "n_classes")


@register("anomaly_threshold", _W + """SELECT round(quantile_cont(score, 0.95), 6) AS threshold
  FROM pred WHERE label = 'Normal'""")
def q_threshold(spark, sf):
    t = exact_quantile(predictions(spark, sf).filter(F.col("label") == "Normal"), "score", 0.95)
    return spark.range(1).select(r6(F.lit(t)).alias("threshold"))


def components(spark, sf, graph=True):
    f = flows(spark, sf)
    return f.select("id", F.least(F.col("value") / 500.0, F.lit(1.0)).alias("classifier"),
                    (F.col("dst").cast("double") if graph else F.lit(None).cast("double")).alias("graph"),
                    F.when(F.col("label") != "Normal", 0.8).otherwise(0.1).alias("sequence"),
                    (F.col("value") / 100.0).alias("anomaly"))


def _risk_sql(graph: bool) -> str:
    w = dims.ENSEMBLE_WEIGHTS
    tot = sum(w.values()) if graph else w["classifier"] + w["temporal"] + w["autoencoder"]
    g = f" + {w['gnn']} * CAST(dst AS DOUBLE) / 100.0" if graph else ""
    return f"""comp AS (SELECT id, least(value / 500.0, 1.0) AS c, CASE WHEN label <> 'Normal' THEN 0.8 ELSE 0.1 END AS s,
  dst, value / 100.0 AS a FROM flows),
p AS (SELECT quantile_cont(a, 0.99) AS p99 FROM comp),
r AS (SELECT id, least(greatest(({w['classifier']} * c{g} + {w['temporal']} * s +
  {w['autoencoder']} * least(greatest(a / p99, 0.0), 1.0)) / {tot} * 100.0, 0.0), 100.0) AS risk FROM comp, p)"""


@register("risk_score", with_flows(_risk_sql(True)) + f"""SELECT id, round(risk, 6) AS risk_score,
  {risk_category_sql('risk')} AS risk_label FROM r""")
def q_risk(spark, sf):
    x = K.categorize(K.risk_score(components(spark, sf)))
    return x.select("id", r6(F.col("risk_score")).alias("risk_score"), "risk_label")


@register("risk_score_partial", with_flows(_risk_sql(False)) + f"""SELECT id, round(risk, 6) AS risk_score,
  {risk_category_sql('risk')} AS risk_label FROM r""")
def q_risk_partial(spark, sf):
    x = K.categorize(K.risk_score(components(spark, sf, graph=False), graph=None))
    return x.select("id", r6(F.col("risk_score")).alias("risk_score"), "risk_label")


@register("gates", with_flows() + f"""SELECT id,
  CASE WHEN g_pred <> 'Normal' AND risk_score < {dims.MIN_ATTACK_RISK} THEN 'Normal' ELSE g_pred END AS predicted_attack,
  round(g_conf, 6) AS confidence, risk_label,
  round(least(greatest((value / 100.0 - 0.3) / 0.7, 0.0), 1.0), 6) AS anomaly_01 FROM (
  SELECT *, CASE WHEN predicted_attack <> 'Normal' AND confidence < {dims.MIN_ATTACK_CONFIDENCE} THEN 'Normal'
    ELSE predicted_attack END AS g_pred,
  CASE WHEN predicted_attack <> 'Normal' AND confidence < {dims.MIN_ATTACK_CONFIDENCE} THEN 1.0 - confidence
    ELSE confidence END AS g_conf FROM flows)""")
def q_gates(spark, sf):
    f = flows(spark, sf).withColumn("p_normal", 1.0 - F.col("confidence"))
    x = K.low_risk_override(K.confidence_gate(f))
    return x.select("id", "predicted_attack", r6(F.col("confidence")).alias("confidence"), "risk_label",
                    r6(anomaly01(-(F.col("value") / 100.0))).alias("anomaly_01"))


_H = "('0x' || substr(md5('42|' || CAST(id AS VARCHAR)), 1, 8))::BIGINT"


@register("sample_rows", with_flows() + f"SELECT id, label FROM flows WHERE {_H} < {int(0.1 * (1 << 32))}")
def q_sample(spark, sf):
    return K.sample_rows(flows(spark, sf).select("id", "label"), 0.1, "id", 42)


_RANK = f"""rk AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {_H}, id) - 1 AS r,
  count(*) OVER (PARTITION BY label) AS n FROM flows),
sz AS (SELECT DISTINCT label, n, CASE WHEN n >= 3 THEN least(greatest((n * 70 + 50) // 100, 1), n - 2)
  ELSE (n * 70 + 50) // 100 END AS ntr FROM rk),
sz2 AS (SELECT label, ntr, CASE WHEN n >= 3 THEN least(greatest((n * 15 + 50) // 100, 1), n - ntr - 1)
  ELSE (n * 15 + 50) // 100 END AS nva FROM sz)"""


@register("stratified_split", with_flows(_RANK) + """SELECT id, label,
  CASE WHEN r < ntr THEN 'train' WHEN r < ntr + nva THEN 'val' ELSE 'test' END AS split
  FROM rk JOIN sz2 USING (label)""")
def q_split(spark, sf):
    return K.stratified_split(flows(spark, sf).select("id", "label")).select("id", "label", "split")


@register("oversample", with_flows(_RANK) + """SELECT id, label, CAST(k AS INTEGER) AS copy_no
  FROM rk, (SELECT max(n) AS nmax FROM rk) m, range(0, (nmax + n - 1) // n) t(k)
  WHERE k * n + r < nmax""")
def q_oversample(spark, sf):
    return K.oversample(flows(spark, sf).select("id", "label")).select("id", "label", "copy_no")


#: Labels missing on every tenth flow: NULL is a class of its own.
_NULLS = "nf AS (SELECT id, CASE WHEN id % 10 <> 0 THEN label END AS label FROM flows)"
_NULL_RANK = _RANK.replace("FROM flows)", "FROM nf)")


def _some_labels(spark, sf):
    return flows(spark, sf).select("id", F.when(F.col("id") % 10 != 0, F.col("label")).alias("label"))


@register("split_null_labels", with_flows(_NULLS, _NULL_RANK) + """SELECT id, rk.label,
  CASE WHEN r < ntr THEN 'train' WHEN r < ntr + nva THEN 'val' ELSE 'test' END AS split
  FROM rk JOIN sz2 ON rk.label IS NOT DISTINCT FROM sz2.label""")
def q_split_nulls(spark, sf):
    """J1 with missing labels."""
    return K.stratified_split(_some_labels(spark, sf)).select("id", "label", "split")


@register("oversample_null_labels", with_flows(_NULLS, _NULL_RANK) + """SELECT id, label, CAST(k AS INTEGER) AS copy_no
  FROM rk, (SELECT max(n) AS nmax FROM rk) m, range(0, (nmax + n - 1) // n) t(k)
  WHERE k * n + r < nmax""")
def q_oversample_nulls(spark, sf):
    """J4 with missing labels."""
    return K.oversample(_some_labels(spark, sf)).select("id", "label", "copy_no")


_RANGES = (("all", None, None), ("days", 0.2, 0.7), ("tail", 0.9, None))
_SK_P = (0.05, 0.5, 0.95)


@register("sketch_quantiles", with_flows() + """SELECT part, col, CAST(p AS DOUBLE) AS p, CAST(count(*) FILTER (WHERE v IS NOT NULL) AS BIGINT) AS n,
  TRUE AS within FROM (SELECT CAST(ts AS DATE) AS d, unnest([{'col': 'value', 'v': value}, {'col': 'confidence', 'v': confidence}], recursive := true)
    FROM flows), (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS z FROM flows),
  (VALUES ('all', 0.0, 1.0), ('days', 0.2, 0.7), ('tail', 0.9, 1.0)) r(part, lo, hi), (VALUES (0.05), (0.5), (0.95)) q(p)
  WHERE d BETWEEN a + CAST(floor(lo * (z - a)) AS INTEGER) AND a + CAST(floor(hi * (z - a)) AS INTEGER) GROUP BY ALL""")
def q_sketch_quantiles(spark, sf):
    """B4/D24 from daily KLL sketches merged over ranges of days: exact counts, and whether
    the rank of each answer among all values is within 0.5 %."""
    import datetime

    from flowsight.operators import sketches as S
    f = flows(spark, sf).select("ts", "value", "confidence")
    kept = S.daily_sketches(f, ["value", "confidence"]).checkpoint()
    a, z = kept.agg(F.min("day"), F.max("day")).first()
    out = None
    for part, lo, hi in _RANGES:
        at = lambda x: None if x is None or a is None else a + datetime.timedelta(days=int(x * (z - a).days))
        got = S.merged_quantiles(kept, list(_SK_P), at(lo), at(hi)).withColumn("part", F.lit(part))
        day = F.to_date("ts")
        x = f.where((day >= F.lit(at(lo) or a)) & (day <= F.lit(at(hi) or z)))
        vals = x.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in ("value", "confidence")])).alias("s")).select("s.*")
        rank = vals.join(F.broadcast(got), "column").groupBy("part", "column", "p", "n").agg(  # six rows
            F.avg((F.col("v") < F.col("value")).cast("double")).alias("lo"), F.avg((F.col("v") <= F.col("value")).cast("double")).alias("hi"))
        out = rank if out is None else out.unionByName(rank)
    return out.select("part", F.col("column").alias("col"), "p", "n",
                      ((F.col("lo") - F.col("p") <= 0.005) & (F.col("p") - F.col("hi") <= 0.005)).alias("within"))

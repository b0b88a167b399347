"""Source / sink queries: data derived from the given tables is written in the
reference's file formats under the checkpoint directory and read back with the
readers (A1-A4, A7, A8, A11, A12, G1), plus H1, H22 and B11."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flowsight.functions.columns import parse_ts, r6
from flowsight.plans.metrics_q import _RANK, q_metrics
from flowsight.plans.registry import ORACLE, register
from flowsight.plans.sqlparts import with_feats, with_flows
from flowsight.session import ensure_checkpoint_dir, fs_list, fs_move, join_path
from flowsight.sources import flows_csv as C
from flowsight.sources import store as S
from flowsight.sources.tables import flow_features, flows
from flowsight.operators.risk import stratified_split


def _scratch(spark, tag):
    return join_path(ensure_checkpoint_dir(spark), f"{tag}-{uuid.uuid4().hex}")


@register("read_flows_csv", with_feats() + """SELECT id, Flow_Duration, Tot_Fwd_Pkts, Label,
  CASE WHEN PSH_Flag_Cnt = 1 THEN 'R, x' ELSE 'o, k' END AS Note FROM feats""")
def q_read_csv(spark, sf):
    """A1/A4: single-quoted CSV with untidy headers, read back and normalised."""
    path = _scratch(spark, "csv")
    f = flow_features(spark, sf).select(
        F.col("id").alias(" id "), F.col("Flow_Duration").alias("Flow  Duration"),
        F.col("Tot_Fwd_Pkts").alias("'Tot Fwd Pkts'"), F.col("Label").alias(" Label"),
        F.when(F.col("PSH_Flag_Cnt") == 1, "R, x").otherwise("o, k").alias("Note"))
    f.write.option("header", True).option("quote", "'").csv(path)
    x = C.read_flows_csv(spark, path, quote="'")
    return x.select(F.col("id").cast("long").alias("id"), F.col("Flow_Duration").cast("double").alias("Flow_Duration"),
                    F.col("Tot_Fwd_Pkts").cast("double").alias("Tot_Fwd_Pkts"), "Label", "Note")


@register("read_flow_dir", with_feats() + """SELECT id, Tot_Fwd_Pkts AS qty, TotLen_Fwd_Pkts AS price,
  CAST(NULL AS DOUBLE) AS pkt_mean, 'Réseau ' || Label AS note FROM feats WHERE Label = 'Brute_Force'
  UNION ALL SELECT id, Tot_Fwd_Pkts, CAST(NULL AS DOUBLE), Pkt_Len_Mean, 'Réseau ' || Label FROM feats
  WHERE Label <> 'Brute_Force'""")
def q_read_dir(spark, sf):
    """A2/A3/G1: Latin-1 CSV files with two different headers in one directory."""
    base = _scratch(spark, "csvdir")
    f = flow_features(spark, sf).withColumn("note", F.concat(F.lit("Réseau "), F.col("Label")))
    a = f.filter(F.col("Label") == "Brute_Force").select("id", F.col("Tot_Fwd_Pkts").alias("qty"),
                                                        F.col("TotLen_Fwd_Pkts").alias("price"), "note")
    b = f.filter(F.col("Label") != "Brute_Force").select("id", F.col("Tot_Fwd_Pkts").alias("qty"),
                                                        F.col("Pkt_Len_Mean").alias("pkt_mean"), "note")
    for tag, part in (("a", a), ("b", b)):
        part.write.option("header", True).option("encoding", "ISO-8859-1").csv(join_path(base, "w" + tag))
        for p in fs_list(spark, join_path(base, "w" + tag)):
            if p.endswith(".csv"):
                fs_move(spark, p, join_path(base, "all", f"{tag}-{p.rsplit('/', 1)[-1]}"))
    x = C.read_flow_dir(spark, join_path(base, "all"), encoding="ISO-8859-1")
    return x.select(F.col("id").cast("long").alias("id"), F.col("qty").cast("double").alias("qty"),
                    F.col("price").cast("double").alias("price"), F.col("pkt_mean").cast("double").alias("pkt_mean"),
                    "note")


@register("append_flows", with_flows() + """SELECT id, risk_label, predicted_attack,
  '{"value":' || CAST(value AS VARCHAR) || ',"dst":' || CAST(dst AS VARCHAR) || '}' AS features_json FROM flows""")
def q_append(spark, sf):
    """A11 then A8 twice (benign flows, then the rest): the table holds every flow once."""
    path = _scratch(spark, "live")
    S.reset_flows(spark, path)
    rows = S.to_live_rows(flows(spark, sf), ["value", "dst"])
    S.append_flows(rows.filter(F.col("predicted_attack") == "Normal"), path)
    S.append_flows(rows.filter(F.col("predicted_attack") != "Normal"), path)
    return spark.read.parquet(path).select("id", "risk_label", "predicted_attack", "features_json")


@register("save_load_prepared", with_flows(_RANK) + """SELECT id, label,
  CASE WHEN r < ntr THEN 'train' WHEN r < ntr + nva THEN 'val' ELSE 'test' END AS split
  FROM rk JOIN sz2 USING (label)""")
def q_save_load(spark, sf):
    """Splits written per split directory and loaded back."""
    path = _scratch(spark, "prepared")
    S.save_prepared(stratified_split(flows(spark, sf).select("id", "label")), path)
    return S.load_prepared(spark, path).select("id", "label", "split")


@register("write_report", ORACLE["classification_metrics"])
def q_report(spark, sf):
    """Metrics written as JSON and CSV, JSON read back."""
    path = _scratch(spark, "report")
    S.write_report(q_metrics(spark, sf), path)
    back = spark.read.json(join_path(path, "evaluation_report"))
    return back.select(*[r6(F.col(c)).alias(c) for c in ("accuracy", "precision_macro", "recall_macro",
                                                        "f1_macro", "f1_weighted")])


@register("features_from_json", """SELECT event_id AS id,
  coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k, 0.0 AS absent FROM events""")
def q_features_json(spark, sf):
    """JSON feature text -> trained feature order, missing keys -> 0."""
    from flowsight.operators.features import features_from_json
    from flowsight.sources.tables import table
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), "props")
    return features_from_json(e, "props", ["k", "absent"]).select("id", "k", "absent")


_FMTS = ["dd/MM/yyyy HH:mm:ss", "d/M/yyyy H:mm", "yyyy-MM-dd HH:mm:ss"]
_STR = ("CASE WHEN id % 4 = 0 THEN strftime(ts, '%d/%m/%Y %H:%M:%S') "
        "WHEN id % 4 = 1 THEN strftime(ts, '%-d/%-m/%Y %-H:%M') "
        "WHEN id % 4 = 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE 'not a time' END")


@register("parse_ts", with_flows() + f"""SELECT id, s, try_strptime(s, ['%d/%m/%Y %H:%M:%S', '%d/%m/%Y %H:%M',
  '%Y-%m-%d %H:%M:%S']) AS parsed FROM (SELECT id, {_STR} AS s FROM flows)""")
def q_parse_ts(spark, sf):
    """H1: mixed day-first text timestamps (one junk form) parsed back; junk -> NULL."""
    ts = F.col("ts")
    s = (F.when(F.col("id") % 4 == 0, F.date_format(ts, _FMTS[0]))
         .when(F.col("id") % 4 == 1, F.date_format(ts, _FMTS[1]))
         .when(F.col("id") % 4 == 2, F.date_format(ts, _FMTS[2])).otherwise(F.lit("not a time")))
    x = flows(spark, sf).select("id", s.alias("s"))
    return x.select("id", "s", parse_ts(F.col("s")).cast("timestamp_ntz").alias("parsed"))


@register("benign_rows", with_flows() + "SELECT id, label FROM flows WHERE label = 'Normal'")
def q_benign(spark, sf):
    """Benign rows (all rows when there are none)."""
    from flowsight.operators.clean import benign_rows
    return benign_rows(flows(spark, sf).select("id", "label"), "label")


_PREP = ["Flow_Duration", "Tot_Fwd_Pkts", "Pkt_Size_Avg"]
_PC = ["value", "risk_score", "dst"]


@register("prepare_pipeline", with_flows(_RANK, """sp AS (SELECT f.*, CASE WHEN r < ntr THEN 'train'
  WHEN r < ntr + nva THEN 'val' ELSE 'test' END AS split FROM rk JOIN sz2 USING (label) JOIN flows f ON f.id = rk.id),
st AS (SELECT """ + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _PC) + " FROM sp WHERE split = 'train')")
          + "SELECT id, split, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx, "
          + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in _PC) + " FROM sp, st")
def q_prepare(spark, sf):
    """Clean, encode, split, scale, save and load."""
    from flowsight.operators import prepare as P
    path = _scratch(spark, "prep")
    f = flows(spark, sf).select("id", "value", "risk_score", F.col("dst").cast("double").alias("dst"), F.col("label").alias("Label"))
    P.save(P.prepare(f, stage=lambda d: d.checkpoint()), path)
    p = P.load(spark, path)
    return p.splits.select("id", "split", "label_idx", *[r6(F.col(c)).alias(c) for c in _PC])


@register("reload_artifacts", ORACLE["standard_scale"])
def q_reload(spark, sf):
    """A fitted scaler written, loaded and applied."""
    from flowsight.operators import features as X
    from flowsight.operators import prepare as P
    path = _scratch(spark, "artifacts")
    f = flow_features(spark, sf).select("id", *_PREP)
    labels = X.fit_labels(flow_features(spark, sf), "Label")
    P.save(P.Prepared(f.withColumn("split", F.lit("train")), _PREP, labels, X.fit_standard(f, _PREP)), path)
    p = P.load(spark, path)
    x = X.apply_standard(p.splits.select("id", *p.features), p.scaler)
    return x.select("id", *[r6(F.col(c)).alias(c) for c in p.features])

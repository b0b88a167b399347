"""Spark ML queries (rows-only checks; quality bounds are in tests/test_ml.py)."""
from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from flowsight.functions.columns import r6
from flowsight.operators import features as X
from flowsight.operators import metrics as M
from flowsight.operators import ml
from flowsight.operators import risk as K
from flowsight.operators import trees
from flowsight.plans.metrics_q import _PRED, components
from flowsight.plans.registry import register
from flowsight.plans.sqlparts import with_feats, with_flows
from flowsight.sources.tables import flow_features, flows

FEATURES = ["Flow_Duration", "Tot_Fwd_Pkts", "Tot_Bwd_Pkts", "TotLen_Fwd_Pkts", "TotLen_Bwd_Pkts",
            "Fwd_Pkt_Len_Max", "Pkt_Len_Mean", "Pkt_Size_Avg", "Flow_Byts/s", "Flow_Pkts/s", "SYN_Flag_Cnt",
            "ACK_Flag_Cnt", "PSH_Flag_Cnt", "RST_Flag_Cnt"]
_SAFE = [f.replace("/", "_per_") for f in FEATURES]


def prepared(spark, sf):
    """Features -> split (J1) -> standard scaling fitted on train (H8)."""
    f = flow_features(spark, sf).select("id", *[F.col(f"`{a}`").alias(b) for a, b in zip(FEATURES, _SAFE)], "Label")
    s = K.stratified_split(f, "Label", "id").checkpoint()   # read by every fit / score job below
    stats = X.fit_standard(s.filter(F.col("split") == "train"), _SAFE)
    return X.apply_standard(s, stats)


@register("train_select")
def q_train_select(spark, sf):
    """Random forest (200 trees), logistic regression and boosted trees (60
    rounds here; the operator's default is 300), metrics on test."""
    m = ml.train_and_select(prepared(spark, sf), _SAFE, "Label", rounds=60)
    return M.compare_models(m).select("model", "metric", r6(F.col("value")).alias("value"), "is_best")


@register("reconstruction_error")
def q_recon(spark, sf):
    """PCA reconstruction error fitted on benign train rows."""
    p = prepared(spark, sf)
    model = ml.fit_reconstruction(p.filter((F.col("split") == "train") & (F.col("Label") == "Normal")), _SAFE, 4)
    scored = ml.reconstruction_error(model, p.filter(F.col("split") == "test"), _SAFE)
    flagged, thr = ml.detect_anomalies(scored, F.col("Label") == "Normal")
    b = M.binary_metrics(flagged.withColumn("a", F.col("Label") != "Normal"), "a", "is_anomaly")
    return b.withColumn("threshold", r6(F.lit(thr)))


@register("optimize_weights")
def q_weights(spark, sf):
    """Ensemble weights learned from component scores."""
    c = components(spark, sf).join(flows(spark, sf).select("id", "label"), "id")
    w = ml.optimize_weights(c.withColumn("graph", F.col("graph") / 100.0),
                            ["classifier", "graph", "sequence", "anomaly"], "label")
    return spark.createDataFrame([(k, float(v)) for k, v in w.items()], "component string, weight double")


#: Coefficients given to both sides of the explanation checks; roots, so that no product
#: lies halfway between two of the sentence's decimals.
_FIXED = {c: (-1) ** i * math.sqrt(i + 2) for i, c in enumerate(_SAFE)}
_FIX = ("fx AS (SELECT id, " + ", ".join(f'"{a}" AS {b}' for a, b in zip(FEATURES, _SAFE)) + " FROM feats),\n"
        "fm AS (SELECT " + ", ".join(f"round(avg({c}), 4) AS m_{c}" for c in _SAFE) + " FROM fx),\n"
        "ct AS (SELECT id, unnest([" + ", ".join(
            f"{{'i': {i}, 'feature': '{c}', 'value': {_FIXED[c]} * ({c} - m_{c})}}" for i, c in enumerate(_SAFE))
        + "]) AS c FROM fx, fm),\ncs AS (SELECT id, c.i AS i, c.feature AS feature, c.value AS value FROM ct)")


def _features(spark, sf):
    return flow_features(spark, sf).select("id", *[F.col(f"`{a}`").alias(b) for a, b in zip(FEATURES, _SAFE)])


def _explained(spark, sf):
    """Contributions of the fixed linear model over all rows."""
    f = _features(spark, sf)
    means = f.agg(*[F.round(F.avg(c), 4).alias(c) for c in _SAFE]).first().asDict()  # the same on both sides
    return ml.linear_contributions(f, _SAFE, _FIXED, means)


_ROW = "[" + ", ".join(f"{{'a': -abs({_FIXED[c]} * ({c} - m_{c})), 'i': {i}, 'f': '{c}', 'v': {_FIXED[c]} * ({c} - m_{c})}}"
                       for i, c in enumerate(_SAFE)) + "]"


@register("explain", with_feats(_FIX, f"tp AS (SELECT id, list_sort({_ROW})[1:5] AS t FROM fx, fm)") + """SELECT id,
  list_transform(t, lambda x: x.f) AS top_features, list_transform(t, lambda x: round(x.v, 6)) AS top_values,
  'Top factors: ' || array_to_string(list_transform(t, lambda x: x.f || CASE WHEN x.v > 0 THEN ' (increases' ELSE ' (decreases' END
    || format(' risk by {:+.4f})', x.v)), '; ') AS explanation FROM tp""")
def q_explain(spark, sf):
    """Top-5 contributions of a linear model and the sentence, every row."""
    x = ml.explanation_text(ml.top_contributions(_explained(spark, sf), 5))
    return x.select("id", F.transform("top_contributions", lambda c: c["feature"]).alias("top_features"),
                    F.transform("top_contributions", lambda c: r6(c["value"])).alias("top_values"), "explanation")


@register("global_importance", with_feats(_FIX) + """SELECT feature, round(avg(abs(value)), 6) AS importance
  FROM cs GROUP BY feature""")
def q_importance(spark, sf):
    """Mean absolute contribution of every feature over all rows."""
    return ml.global_importance(_explained(spark, sf)).select("feature", r6(F.col("importance")).alias("importance"))


@register("top_importance", with_feats(_FIX) + """SELECT feature, round(avg(abs(value)), 6) AS importance
  FROM cs GROUP BY feature ORDER BY avg(abs(value)) DESC LIMIT 5""")
def q_top_importance(spark, sf):
    """the five most important features."""
    g = ml.global_importance(_explained(spark, sf)).limit(5)
    return g.select("feature", r6(F.col("importance")).alias("importance"))


@register("explain_trained")
def q_explain_trained(spark, sf):
    """J16 with trained models: contributions of a logistic model and Shapley values of a
    random forest (20 trees, depth 6) for P(attack), over all rows; base + sum is the
    forest's P, compared here with its prediction."""
    p = prepared(spark, sf).withColumn("y", (F.col("Label") != "Normal").cast("double"))
    train = p.filter(F.col("split") == "train")
    lr = LogisticRegression(featuresCol="features", labelCol="y", maxIter=100).fit(
        VectorAssembler(inputCols=_SAFE, outputCol="features").transform(train))
    rf = trees.fit_forest(train, _SAFE, "y", trees=20, depth=6)
    t = ml.top_contributions(rf.explain(rf.transform(p.select("id", *_SAFE)), 1), 5)
    total = F.col("base") + F.aggregate(F.transform("contributions", lambda c: c["value"]), F.lit(0.0), lambda a, b: a + b)
    t = t.select("id", *_SAFE, F.transform("top_contributions", lambda c: c["feature"]).alias("top_forest"),
                 r6(F.element_at("probability", 2)).alias("p_attack"), (F.abs(total - F.element_at("probability", 2)) < 1e-6).alias("adds_up"))
    x = ml.linear_contributions(t, _SAFE, dict(zip(_SAFE, lr.coefficients.toArray().tolist())), {c: 0.0 for c in _SAFE})
    return ml.top_contributions(x, 5).select("id", F.transform("top_contributions", lambda c: c["feature"]).alias("top_linear"),
                                             "top_forest", "p_attack", "adds_up")


@register("iforest")
def q_iforest(spark, sf):
    """Isolation forest (200 trees, 256 samples) fitted on benign train
    rows, offset at contamination 0.05; detector metrics on the test split."""
    from flowsight.operators import iforest as I
    p = prepared(spark, sf)
    benign = p.filter((F.col("split") == "train") & (F.col("Label") == "Normal"))
    nodes, psi = I.fit_iforest(benign, _SAFE, 200, 256)
    nodes = nodes.checkpoint()
    train_scores = I.score_iforest(benign, _SAFE, nodes, psi).select("iforest_score").checkpoint()
    offset = I.iforest_threshold(train_scores)
    test = I.score_iforest(p.filter(F.col("split") == "test"), _SAFE, nodes, psi)
    flagged = test.withColumn("is_anomaly", F.col("iforest_score") < F.lit(offset)) \
                  .withColumn("a", F.col("Label") != "Normal")
    return M.binary_metrics(flagged, "a", "is_anomaly").withColumn("offset", r6(F.lit(offset)))


@register("node_classifier")
def q_node_classifier(spark, sf):
    """Node features (D11) propagated two hops (mean), logistic
    regression on majority labels (D12), node risk."""
    from flowsight.operators import graph as G
    f = flows(spark, sf)
    x = G.node_matrix(f, ["value", "confidence"])
    cols = ["value", "confidence", "out_degree", "in_degree"]
    feats = G.propagate(x, G.distinct_edges(f), cols, hops=2, norm="mean").checkpoint()
    fcols = cols + [f"{c}_h{h}" for h in (1, 2) for c in cols]
    scored, _ = ml.train_node_classifier(feats, G.majority_label(f), fcols)
    return scored.select("node", "split", "label", "predicted", r6(F.col("node_risk")).alias("node_risk"))


@register("sequence_model")
def q_sequence_model(spark, sf):
    """Next-event attack probability from the previous 20 flows of the same
    source (E5 sequences, flattened and pooled, logistic regression); metrics on
    the test split."""
    from flowsight.operators import windows as W
    f = flows(spark, sf).select("id", "us", "src_ip", "value", "risk_score", "label")
    seqs = W.make_sequences(f, ["value", "risk_score"], 20, "label", binary=True)
    seqs, cols = ml.sequence_features(seqs, 2, 20)
    seqs = K.stratified_split(seqs.withColumn("target", F.col("target").cast("string")), "target", "id").checkpoint()
    model = ml.train(seqs.filter(F.col("split") == "train"), cols, "target", "logistic")
    pred = ml.evaluate(model, seqs.filter(F.col("split") == "test"), "target")
    b = M.binary_metrics(pred.select((F.col("target") == "1").alias("a"), (F.col("predicted") == "1").alias("p")),
                         "a", "p")
    return b.select("tp", "fp", "fn", "tn", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


_KNN_D = "list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@register("knn_edges", f"""SELECT src, dst, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM (
  SELECT a.vec_id AS src, b.vec_id AS dst, {_KNN_D} AS dist,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY {_KNN_D}, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 5""")
def q_knn(spark, sf):
    """Exact 5 nearest neighbours of every embedding (no self edges)."""
    from flowsight.operators.knn import knn_edges
    from flowsight.sources.tables import table
    e = knn_edges(table(spark, sf, "embeddings"), "embedding", "vec_id", 5)
    return e.select("src", "dst", r6(F.col("dist")).alias("dist"), "rank")


@register("knn_descent")
def q_knn_descent(spark, sf):
    """C10 beyond the limit: neighbour descent over every embedding; no SQL: approximate,
    recall is tested against the exact search."""
    from flowsight.operators.knn_descent import knn_descent
    from flowsight.sources.tables import table
    return knn_descent(table(spark, sf, "embeddings"), "embedding", "vec_id", 5).select(
        "src", "dst", r6(F.col("dist")).alias("dist"), "rank")


_HEX = "('0x' || substr(md5({s}), 1, 8))::BIGINT"
_SMOTE = f"""WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sz AS (SELECT label, count(*) AS nc FROM e GROUP BY label),
mm AS (SELECT max(nc) AS mx, greatest(1, least(5, min(nc) - 1)) AS kk FROM sz),
rk AS (SELECT e.*, nc, row_number() OVER (PARTITION BY e.label ORDER BY {_HEX.format(s="'42|' || CAST(id AS VARCHAR)")}, id) - 1 AS r
  FROM e JOIN sz ON sz.label = e.label),
syn AS (SELECT rk.label, id, nc, unnest(range(r, mx - nc, nc)) AS j FROM rk, mm WHERE r < mx - nc),
h AS (SELECT syn.*, {_HEX.format(s="'47|' || CAST(syn.label AS VARCHAR) || '|' || CAST(j AS VARCHAR)")} AS hj, kk FROM syn, mm),
nn AS (SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank
  FROM e a JOIN e b ON a.label = b.label AND a.id <> b.id WHERE a.id IN (SELECT id FROM syn))
SELECT h.label, j AS synthetic_idx, h.id AS base_id, nn.dst AS nbr, round(hj / 4294967296.0, 6) AS u, CAST(len(x.v) AS INTEGER) AS dim,
  round(list_sum(x.v) + hj / 4294967296.0 * (list_sum(y.v) - list_sum(x.v)), 4) AS vec_sum
FROM h JOIN nn ON nn.src = h.id AND nn.rank = hj % kk + 1 JOIN e x ON x.id = h.id JOIN e y ON y.id = nn.dst"""


@register("smote", _SMOTE)
def q_smote(spark, sf):
    """SMOTE every embedding class up to the majority size."""
    from flowsight.operators.knn import smote
    from flowsight.sources.tables import table
    s = smote(table(spark, sf, "embeddings"), "label", "embedding", "vec_id", 5)
    total = F.aggregate("vec", F.lit(0.0), lambda a, b: a + b)
    return s.select("label", "synthetic_idx", "base_id", "nbr", r6(F.col("u")).alias("u"), F.size("vec").alias("dim"),
                    F.round(total, 4).alias("vec_sum"))


@register("balance_smote", "SELECT label, max(count(*)) OVER () AS n FROM embeddings GROUP BY label")
def q_balance(spark, sf):
    """After balancing every class has the majority's size."""
    from flowsight.sources.tables import table
    e = table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return ml.balance(e, "smote", "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_SMALL = """e AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS r, CASE WHEN label > 2 THEN NULL ELSE label END AS label
  FROM embeddings), s AS (SELECT id, CASE WHEN r <= {n} THEN -1 ELSE label END AS label FROM e)"""


def _small_class(spark, sf, n: int):
    """Embeddings whose n first ids are class -1 and whose labels above 2 are missing."""
    from flowsight.sources.tables import table
    e = table(spark, sf, "embeddings")
    first = e.orderBy("vec_id").limit(n).agg(F.max("vec_id")).first()[0]
    label = F.when(F.col("vec_id") <= F.lit(first), -1).when(F.col("label") <= 2, F.col("label"))
    return e.select(label.cast("int").alias("label"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _balanced(spark, sf, n: int):
    b = ml.balance(_small_class(spark, sf, n), "smote", "label")
    return b.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count("copy_no").alias("added"), F.countDistinct("id").alias("ids"))


def _balanced_sql(n: int) -> str:
    return f"""WITH {_SMALL.format(n=n)}, c AS (SELECT label, count(*) AS k FROM s GROUP BY label), m AS (SELECT max(k) AS mx FROM c)
  SELECT CAST(label AS INTEGER) AS label, mx AS n, mx - k AS added, k AS ids FROM c, m"""


@register("balance_one_row", _balanced_sql(1))
def q_balance_one(spark, sf):
    """J5: 'smote' with a class of one row and missing labels: copies."""
    return _balanced(spark, sf, 1)


@register("balance_five_rows", _balanced_sql(5))
def q_balance_five(spark, sf):
    """J5: 'smote' with a class of five rows: still copies."""
    return _balanced(spark, sf, 5)


@register("balance_six_rows", _balanced_sql(6))
def q_balance_six(spark, sf):
    """J5: 'smote' with a class of six rows: synthetic rows."""
    return _balanced(spark, sf, 6)


@register("balance_weight", with_feats("n AS (SELECT count(*) AS n, count(DISTINCT Label) AS k FROM feats)") + """SELECT id,
  round(n / (k * count(*) OVER (PARTITION BY Label)), 6) AS weight FROM feats, n""")
def q_class_weights(spark, sf):
    """J5, method 'weight'."""
    return ml.balance(flow_features(spark, sf).select("id", "Label"), "weight").select("id", r6(F.col("weight")).alias("weight"))


@register("save_contributions", with_feats(_FIX) + "SELECT id, feature, round(value, 6) AS value FROM cs")
def q_save_contributions(spark, sf):
    """Per-row contributions of all rows saved as a table and read back."""
    import uuid

    from flowsight.session import ensure_checkpoint_dir, join_path
    from flowsight.sources.store import save_table
    path = join_path(ensure_checkpoint_dir(spark), "contrib-" + uuid.uuid4().hex)
    x = _explained(spark, sf).select("id", F.inline("contributions"))
    save_table(x, path)
    return spark.read.parquet(path).select("id", "feature", r6(F.col("value")).alias("value"))


_RECON = ["Flow_Duration", "Tot_Fwd_Pkts", "Pkt_Size_Avg", "Pkt_Len_Mean"]
_RST = "rst AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _RECON) + " FROM feats)"
_Z = {c: f"(({c} - m_{c}) / s_{c})" for c in _RECON}


@register("reconstruction_fixed", with_feats(_RST, f"""er AS (SELECT id, Label,
  ({" + ".join(f"{z} * {z}" for z in _Z.values())}
   - pow(({_Z[_RECON[0]]} + {_Z[_RECON[1]]}) / sqrt(2.0), 2) - pow(({_Z[_RECON[2]]} - {_Z[_RECON[3]]}) / sqrt(2.0), 2)) / 4 AS err
  FROM feats, rst), th AS (SELECT quantile_cont(err, 0.95) AS t FROM er WHERE Label = 'Normal')""") + """SELECT id,
  round(err, 6) AS recon_error, err > t AS is_anomaly FROM er, th""")
def q_recon_fixed(spark, sf):
    """J10/J11/D24 with fixed orthonormal components (sum and difference of two pairs of
    features), every row."""
    f = flow_features(spark, sf).select("id", "Label", *_RECON)
    x = X.apply_standard(f, X.fit_standard(f, _RECON))
    h = 2 ** -0.5
    y = [h * F.col(_RECON[0]) + h * F.col(_RECON[1]), h * F.col(_RECON[2]) - h * F.col(_RECON[3])]
    scored = ml.projection_error(x, _RECON, y)
    flagged, _ = ml.detect_anomalies(scored, F.col("Label") == "Normal")
    return flagged.select("id", r6(F.col("recon_error")).alias("recon_error"), "is_anomaly")


@register("family_comparison")
def q_families(spark, sf):
    """Node features propagated with the mean and with the symmetric norm."""
    from flowsight.operators import graph as G
    f = flows(spark, sf)
    x = G.node_matrix(f, ["value", "confidence"]).checkpoint()
    cols = ["value", "confidence", "out_degree", "in_degree"]
    fcols = cols + [f"{c}_h{h}" for h in (1, 2) for c in cols]
    e = G.distinct_edges(f)
    cand = {n: (G.propagate(x, e, cols, hops=2, norm=n).checkpoint(), fcols) for n in ("mean", "sym")}
    cand["own"] = (x, cols)
    m = ml.compare_families(cand, G.majority_label(f))
    return m.select("model", "metric", r6(F.col("value")).alias("value"), "is_best")


_CMP = """mo AS (SELECT 'a' AS model, prediction AS p, label FROM pred UNION ALL SELECT 'b', 'Normal', label FROM pred
  UNION ALL SELECT 'c', CASE WHEN id % 3 = 0 THEN 'Normal' ELSE label END, label FROM pred)"""


def _accuracies(spark, sf):
    from flowsight.plans.metrics_q import predictions
    p = predictions(spark, sf)
    models = {"a": F.col("prediction"), "b": F.lit("Normal"), "c": F.when(F.col("id") % 3 == 0, "Normal").otherwise(F.col("label"))}
    return p.select(F.inline(F.array(*[F.struct(F.lit(m).alias("model"), (c == F.col("label")).cast("int").alias("hit"))
                                       for m, c in models.items()]))) \
        .groupBy("model").agg(F.avg("hit").alias("value")).withColumn("metric", F.lit("accuracy"))


@register("compare_models", with_flows(_PRED, _CMP) + """SELECT model, 'accuracy' AS metric, round(v, 6) AS value,
  v = max(v) OVER () AS is_best FROM (SELECT model, avg(CAST(p = label AS INTEGER)) AS v FROM mo GROUP BY model)""")
def q_compare(spark, sf):
    """is_best per metric over three deterministic predictors."""
    return M.compare_models(_accuracies(spark, sf)).select("model", "metric", r6(F.col("value")).alias("value"), "is_best")


@register("best_model", with_flows(_PRED, _CMP) + """SELECT arg_min(model, (-v, model)) AS model, round(max(v), 6) AS value
  FROM (SELECT model, avg(CAST(p = label AS INTEGER)) AS v FROM mo GROUP BY model)""")
def q_best(spark, sf):
    """the model with the highest accuracy."""
    return M.best_model(_accuracies(spark, sf), "accuracy").select("model", r6(F.col("value")).alias("value"))


@register("batch_risk")
def q_batch_risk(spark, sf):
    """Fitted classifier, node, sequence and anomaly scores to risk and category of
    every flow."""
    from flowsight.operators import graph as G
    from flowsight.operators import windows as W
    f = flows(spark, sf).select("id", "us", "src", "dst", "src_ip", "value", "confidence", "risk_score", "label")
    # classifier: P(attack) from the flow's own columns
    own = f.select("id", "label", "value", "confidence", F.col("dst").cast("double").alias("dst")).checkpoint()
    model = ml.train(K.sample_rows(own, 0.7), ["value", "confidence", "dst"], "label", "logistic")
    names = model.stages[0].labels
    from pyspark.ml.functions import vector_to_array
    normal = names.index("Normal") if "Normal" in names else None
    prob = vector_to_array("probability")
    p_attack = 1.0 - prob[normal] if normal is not None else F.lit(1.0)
    classifier = model.transform(own).select("id", p_attack.alias("classifier"))
    # graph: risk of the source node
    cols = ["value", "confidence", "out_degree", "in_degree"]
    nodes = G.propagate(G.node_matrix(f, ["value", "confidence"]), G.distinct_edges(f), cols, hops=1).checkpoint()
    scored, _ = ml.train_node_classifier(nodes, G.majority_label(f), cols + [f"{c}_h1" for c in cols])
    graph = scored.select(F.col("node").alias("src"), F.col("node_risk").alias("graph"))
    # sequence: P(attack next) from the 20 flows before
    seqs, scols = ml.sequence_features(W.make_sequences(f, ["value", "risk_score"], 20, "label", binary=True), 2, 20)
    seqs = seqs.withColumn("target", F.col("target").cast("string")).checkpoint()
    smodel = ml.train(K.sample_rows(seqs, 0.7), scols, "target", "logistic")
    i = smodel.stages[0].labels.index("1") if "1" in smodel.stages[0].labels else None
    sequence = smodel.transform(seqs).select("id", (vector_to_array("probability")[i] if i is not None
                                                    else F.lit(0.0)).alias("sequence"))
    # anomaly: reconstruction error of the benign flows' components
    z = X.apply_standard(own.drop("label"), X.fit_standard(own, ["value", "confidence", "dst"])).join(own.select("id", "label"), "id")
    pca = ml.fit_reconstruction(z.where("label = 'Normal'"), ["value", "confidence", "dst"], 2)
    anomaly = ml.reconstruction_error(pca, z, ["value", "confidence", "dst"], "anomaly").select("id", "anomaly")
    x = K.batch_risk(f.select("id", "src"), {"classifier": (classifier, "id"), "graph": (graph, "src"),
                                             "sequence": (sequence, "id"), "anomaly": (anomaly, "id")})
    return x.select("id", r6(F.col("risk_score")).alias("risk_score"), "risk_label")


# the random-forest selection is the heaviest job: keep it last in the registry
from flowsight.plans.registry import QUERIES as _Q  # noqa: E402

_Q["train_select"] = _Q.pop("train_select")

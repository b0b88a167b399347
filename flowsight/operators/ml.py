"""Spark ML jobs (J5-J8, J10-J12, J16, J17; D27, F3-F5, H21).

Training and scoring are Spark ML estimators on assembled vectors; evaluation
reuses the count-based metrics of `metrics`.  Forests, boosted trees and their Shapley
values are in `trees`.  Re-aimed items: the deep autoencoder becomes its linear form
(PCA reconstruction error), and explanations of the linear model are exact
coefficient x (value - mean) contributions.
"""
from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.feature import PCA, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.operators import metrics as M
from flowsight.operators import trees
from flowsight.operators.ordering import few, join_same
from flowsight.operators.stats import exact_quantile


def _prep(label: str, features: list[str], weight: str | None):
    idx = StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc",
                        handleInvalid="keep")
    vec = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    return idx, vec


def class_weight_column(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Balanced weights n / (k n_c) as a column (J5 'weight' method); NULL is a class of its own."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    st = counts.agg(F.sum("_nc").alias("n"), F.count(F.lit(1)).alias("k")).first()
    w = counts.select(label, (F.lit(float(st["n"])) / (F.lit(st["k"]) * F.col("_nc"))).alias(out))
    return join_same(df, few(w), [label])  # one row per class


def estimator(kind: str, weight: str | None, seed: int = 42, rounds: int = 300):
    w = {"weightCol": weight} if weight else {}
    if kind == "gbt_ovr":              # boosted trees of Spark ML, one binary model per class
        gbt = GBTClassifier(maxDepth=8, maxIter=rounds, stepSize=0.1, subsamplingRate=0.8, seed=seed)
        return OneVsRest(classifier=gbt, featuresCol="features", labelCol="label_idx", **w)
    if kind == "logistic":
        return LogisticRegression(featuresCol="features", labelCol="label_idx", maxIter=100, **w)
    raise ValueError(kind)


def train(df: DataFrame, features: list[str], label: str = "Label", kind: str = "random_forest",
          weight: str | None = None, key: str | None = None, **kw):
    """Fit a classifier: 'random_forest' (J7) and 'boosted' (J6) are histogram trees, the
    others Spark ML pipelines of indexer, assembler and classifier.  `key` identifies a row
    in the trees' samples (its features where it is None and there is no `id`)."""
    if kind in ("random_forest", "boosted"):
        fit = trees.fit_forest if kind == "random_forest" else trees.fit_boosted
        if key is None and "id" not in df.columns:
            df, key = df.withColumn("_key", F.xxhash64(*[F.col(f"`{f}`") for f in features])), "_key"
        return fit(df, features, label, key or "id", weight, **kw)
    idx, vec = _prep(label, features, weight)
    return Pipeline(stages=[idx, vec, estimator(kind, weight, **kw)]).fit(df)


@dataclass(frozen=True)
class LinearModel:
    """A softmax model with given coefficients (one list a class) and intercepts, such as
    one exported by another program; scoring is plain column arithmetic."""
    labels: list[str]
    features: list[str]
    coefficients: list[list[float]]
    intercepts: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        """df with probability (array, in the order of labels) and prediction (its first
        maximum's number)."""
        margins = []
        for coefs, b in zip(self.coefficients, self.intercepts):
            m = F.lit(float(b))
            for c, f in zip(coefs, self.features):
                m = m + F.lit(float(c)) * F.col(f"`{f}`")
            margins.append(m)
        top = F.array_max("_m")
        shares = F.transform("_m", lambda x: F.exp(x - top))
        total = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
        out = df.withColumn("_m", F.array(*margins)).withColumn("_e", shares) \
            .withColumn("probability", F.transform("_e", lambda x: x / total))
        first = F.array_position("probability", F.array_max("probability")) - 1
        return out.withColumn("prediction", first.cast("double")).drop("_m", "_e")


def labels_of(model) -> list:
    """Class names in the order of a model's class numbers."""
    return model.labels if isinstance(model, (trees.TreeModel, LinearModel)) else model.stages[0].labels


def evaluate(model, df: DataFrame, label: str = "Label") -> DataFrame:
    """Predictions decoded back to label names, then D17-D19."""
    p = model.transform(df)
    names = F.element_at(F.array(*[F.lit(x) for x in labels_of(model)]), (F.col("prediction") + 1).cast("int"))
    return p.withColumn("predicted", names)


def train_and_select(splits: DataFrame, features: list[str], label: str = "Label",
                     kinds=("random_forest", "logistic", "boosted"), weight: str | None = "weight",
                     rounds: int = 300) -> DataFrame:
    """Train each model on the train split, evaluate on test, return the long
    metrics table (model, metric, value); pick with `metrics.best_model`."""
    data = class_weight_column(splits, label) if weight else splits
    tr = data.filter(F.col("split") == "train").cache()
    te = data.filter(F.col("split") == "test").cache()
    rows = []
    try:
        for kind in kinds:
            t0 = time.perf_counter()
            model = train(tr, features, label, kind, weight, **({"rounds": rounds} if kind in ("boosted", "gbt_ovr") else {}))
            secs = time.perf_counter() - t0
            m = M.classification_metrics(M.confusion_matrix(evaluate(model, te, label), label, "predicted")).first()
            rows += [(kind, c, float(v)) for c, v in m.asDict().items()] + [(kind, "training_time_s", secs)]
    finally:
        tr.unpersist()
        te.unpersist()
    return splits.sparkSession.createDataFrame(rows, "model string, metric string, value double")


#: Below this many rows in a class neighbours mean little: copies instead of SMOTE.
SMOTE_ROWS = 6


def balance(train_split: DataFrame, method: str, label: str = "Label", key: str = "id", vec: str = "vec",
            seed: int = 42) -> DataFrame:
    """J5: 'none'; 'weight' adds a balanced weight column; 'oversample' replicates every
    class to the majority's size (copy_no); 'smote' adds synthetic rows of the vector
    column for the missing ones (copy_no is their number, key the base row's), or, where a
    class has fewer than SMOTE_ROWS rows, copies of its rows as 'oversample' does."""
    from flowsight.operators.knn import smote
    from flowsight.operators.risk import oversample
    if method == "none":
        return train_split
    if method == "weight":
        return class_weight_column(train_split, label)
    if method == "oversample":
        return oversample(train_split, label, key, seed)
    if method == "smote":
        real = train_split.select(label, F.col(key), F.col(vec).cast("array<double>").alias(vec),
                                  F.lit(None).cast("long").alias("copy_no"))
        least = train_split.groupBy(label).count().agg(F.min("count")).first()[0] or 0
        if least < SMOTE_ROWS:
            copies = oversample(train_split, label, key, seed).withColumn("copy_no", F.expr("nullif(copy_no, 0)").cast("long"))
            return copies.select(*real.columns[:2], F.col(vec).cast("array<double>").alias(vec), "copy_no")
        new = smote(train_split, label, vec, key, seed=seed).select(
            label, F.col("base_id").alias(key), F.col("vec").alias(vec), F.col("synthetic_idx").alias("copy_no"))
        return real.unionByName(new)
    raise ValueError(method)


# --- anomaly detection (J10, J11) ------------------------------------------

def fit_reconstruction(df: DataFrame, features: list[str], k: int = 8):
    """J10 fit: principal components of the (already scaled) benign rows."""
    vec = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[vec, PCA(k=k, inputCol="features", outputCol="proj")]).fit(df)


def reconstruction_error(model, df: DataFrame, features: list[str], out: str = "recon_error") -> DataFrame:
    """Mean squared reconstruction error ||x - V V^T x||^2 / d = (||x||^2 -
    ||V^T x||^2) / d (V orthonormal), as column expressions."""
    p = model.transform(df)
    x = vector_to_array("features")
    y = vector_to_array("proj")
    sq = lambda a: F.aggregate(F.transform(a, lambda v: v * v), F.lit(0.0), lambda s, v: s + v)
    err = F.greatest(sq(x) - sq(y), F.lit(0.0)) / F.lit(float(len(features)))
    return p.withColumn(out, err).drop("features", "proj")


def projection_error(df: DataFrame, features: list[str], components: list, out: str = "recon_error") -> DataFrame:
    """Mean squared reconstruction error for given orthonormal components, each a column
    expression of the row's projection: (|x|^2 - sum y^2) / d."""
    square = [F.col(f"`{c}`") * F.col(f"`{c}`") for c in features]
    rest = sum(square[1:], square[0]) - sum((y * y for y in components[1:]), components[0] * components[0])
    return df.withColumn(out, F.greatest(rest, F.lit(0.0)) / F.lit(float(len(features))))


def detect_anomalies(scored: DataFrame, benign, err: str = "recon_error", pct: float = 0.95):
    """threshold = pct-quantile of benign errors; flag = error > threshold."""
    thr = exact_quantile(scored.filter(benign), err, pct)
    return scored.withColumn("is_anomaly", F.col(err) > F.lit(thr)), thr


# --- ensemble weights (J12) --------------------------------------------------

def optimize_weights(df: DataFrame, components: list[str], label: str = "label") -> dict:
    """Logistic regression of attack vs normal on the component scores; weights
    = |coef| / sum |coef| (uniform when all are zero)."""
    n = df.count()
    vec = VectorAssembler(inputCols=components, outputCol="features")
    y = (F.col(label) != "Normal").cast("double").alias("y")
    data = vec.transform(df.select(*components, y).na.drop())
    lr = LogisticRegression(featuresCol="features", labelCol="y", maxIter=1000, regParam=1.0 / max(n, 1),
                            elasticNetParam=0.0, standardization=False)
    coef = [abs(c) for c in lr.fit(data).coefficients.toArray()]
    tot = sum(coef)
    return {c: (v / tot if tot > 0 else 1.0 / len(components)) for c, v in zip(components, coef)}


# --- explanations (J16, F4, H21, D27) ----------------------------------------

def linear_contributions(df: DataFrame, features: list[str], coefs: dict, means: dict) -> DataFrame:
    """Per-row contributions coef x (x - mean) of a linear model, as an array of
    (feature, value) structs."""
    items = [F.struct(F.lit(f).alias("feature"),
                      (F.lit(coefs[f]) * (F.col(f"`{f}`") - F.lit(means[f]))).alias("value")) for f in features]
    return df.withColumn("contributions", F.array(*items))


def top_contributions(df: DataFrame, n: int = 5) -> DataFrame:
    """the n largest contributions by absolute value."""
    srt = F.array_sort("contributions", lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1)
                       .when(F.abs(a["value"]) < F.abs(b["value"]), 1).otherwise(0))
    return df.withColumn("top_contributions", F.slice(srt, 1, n))


def explanation_text(df: DataFrame) -> DataFrame:
    """One sentence from the top contributions (direction and signed value)."""
    parts = F.transform("top_contributions", lambda c: F.format_string(
        "%s (%s risk by %+.4f)", c["feature"], F.when(c["value"] > 0, "increases").otherwise("decreases"),
        c["value"]))
    return df.withColumn("explanation", F.concat(F.lit("Top factors: "), F.array_join(parts, "; ")))


def global_importance(df: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature, descending (F3 = limit)."""
    x = df.select(F.inline("contributions"))
    return x.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance")).orderBy(F.desc("importance"))


def train_node_classifier(feats: DataFrame, labels: DataFrame, feature_cols: list[str], seed: int = 42):
    """Logistic regression on propagated node features; nodes split 60/20/20 by
    a seeded hash; risk = 100 x (1 - P(Normal)).  Returns (scored nodes, model)."""
    from flowsight.operators.ordering import HASH_SPACE, hash32
    d = feats.join(labels, "node")  # nodes that were a source have a label
    h = hash32("node", seed=seed)
    d = d.withColumn("split", F.when(h < F.lit(int(0.6 * HASH_SPACE)), "train")
                     .when(h < F.lit(int(0.8 * HASH_SPACE)), "val").otherwise("test"))
    model = train(d.filter(F.col("split") == "train"), feature_cols, "label", "logistic")
    labels_order = model.stages[0].labels
    p = evaluate(model, d, "label")
    if "Normal" in labels_order:
        i = labels_order.index("Normal")
        p = p.withColumn("node_risk", (1.0 - vector_to_array("probability")[i]) * 100.0)
    else:
        p = p.withColumn("node_risk", F.lit(100.0))
    return p.select("node", "split", "label", "predicted", "node_risk"), model


def sequence_features(seqs: DataFrame, n_feats: int, n: int = 20) -> tuple[DataFrame, list[str]]:
    """Flatten the n x f sequence into columns plus mean / max pooling per feature."""
    cols, exprs = [], []
    for t in range(n):
        for j in range(n_feats):
            name = f"s{t}_{j}"
            cols.append(name)
            exprs.append(F.col("sequence")[t][j].alias(name))
    for j in range(n_feats):
        vals = F.transform("sequence", lambda v: v[j])
        exprs.append((F.aggregate(vals, F.lit(0.0), lambda a, b: a + b) / n).alias(f"mean_{j}"))
        exprs.append(F.array_max(vals).alias(f"max_{j}"))
        cols += [f"mean_{j}", f"max_{j}"]
    return seqs.select("*", *exprs), cols


def compare_families(candidates: dict[str, tuple[DataFrame, list[str]]], labels: DataFrame, label: str = "label",
                     key: str = "node", by: str = "f1_macro") -> DataFrame:
    """One logistic model per feature family (name -> (features, columns)) on the same
    hashed node split; long metrics table of the test split with is_best per metric."""
    rows = []
    for name, (feats, cols) in candidates.items():
        scored, _ = train_node_classifier(feats.withColumnRenamed(key, "node"), labels, cols)
        test = scored.filter(F.col("split") == "test")
        m = M.classification_metrics(M.confusion_matrix(test, "label", "predicted")).first().asDict()
        rows += [(name, c, float(v) if v is not None else None) for c, v in m.items()]
    table = labels.sparkSession.createDataFrame(rows, "model string, metric string, value double")
    return M.compare_models(table, by)

"""Model tests: planted outliers, separable data, determinism."""
from pyspark.sql import functions as F

from cases import SF001
from flowsight.operators import iforest as I
from flowsight.operators import ml
from flowsight.operators.stats import exact_quantile


def _emb(spark):
    e = spark.read.parquet(f"{SF001}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), "label",
                    *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(8)])


def test_iforest_planted_outliers(spark):
    df = _emb(spark)
    cols = [f"f{i}" for i in range(8)]
    out = df.limit(10).select((F.col("id") + 1_000_000).alias("id"), "label",
                              *[(F.col(c) * 0 + 25.0).alias(c) for c in cols])
    nodes, psi = I.fit_iforest(df, cols, trees=100, psi=128)
    nodes = nodes.cache()
    base = I.score_iforest(df, cols, nodes, psi).cache()
    p05 = exact_quantile(base, "iforest_score", 0.05)
    planted = I.score_iforest(out, cols, nodes, psi).collect()
    assert all(r["iforest_score"] < p05 for r in planted)


def test_iforest_deterministic(spark):
    df = _emb(spark)
    cols = [f"f{i}" for i in range(8)]
    a, _ = I.fit_iforest(df, cols, trees=20, psi=64)
    b, _ = I.fit_iforest(df.repartition(7), cols, trees=20, psi=64)
    key = ["tree", "node"]
    assert sorted(map(tuple, a.orderBy(*key).collect())) == sorted(map(tuple, b.orderBy(*key).collect()))


def test_reconstruction_error_flags_outliers(spark):
    df = _emb(spark)
    cols = [f"f{i}" for i in range(8)]
    model = ml.fit_reconstruction(df, cols, k=3)
    scored = ml.reconstruction_error(model, df, cols)
    thr = exact_quantile(scored, "recon_error", 0.95)
    out = df.limit(5).select("id", "label", *[(F.col(c) * 0 + F.lit(40.0) * (i % 2 * 2 - 1)).alias(c)
                                              for i, c in enumerate(cols)])
    errs = [r["recon_error"] for r in ml.reconstruction_error(model, out, cols).collect()]
    assert all(e > thr for e in errs)


def test_optimize_weights_prefers_informative_component(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") % 2 == 0, "Normal").otherwise("Attack").alias("label"),
        (F.col("id") % 2).cast("double").alias("good"),
        ((F.col("id") * 7919) % 13 / 13.0).alias("noise"))
    w = ml.optimize_weights(df, ["good", "noise"], "label")
    assert w["good"] > 0.9 and abs(sum(w.values()) - 1) < 1e-9


def test_gbt_one_vs_rest_learns_separable_classes(spark):
    from flowsight.operators import metrics as M
    # three classes separated along one feature; a few boosting rounds suffice
    df = spark.range(600).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "A").when(F.col("id") % 3 == 1, "B").otherwise("C").alias("Label"),
        ((F.col("id") % 3) * 10.0 + (F.col("id") % 7) / 7.0).alias("x"), ((F.col("id") * 13) % 11 / 11.0).alias("noise"))
    weighted = ml.class_weight_column(df, "Label")
    model = ml.train(weighted, ["x", "noise"], "Label", "gbt_ovr", "weight", rounds=5)
    pred = ml.evaluate(model, df, "Label")
    acc = M.classification_metrics(M.confusion_matrix(pred, "Label", "predicted")).first()["accuracy"]
    assert acc == 1.0

"""Classifier and detector evaluation from label/prediction tables
(D17-D24, D28, F5).  Everything is computed from grouped counts, so the work is
one partial/final aggregation over the predictions; ROC statistics use
distributed running sums over the distinct scores."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsight.operators.ordering import global_cumsum


def class_pairs(df: DataFrame, label: str, pred: str) -> DataFrame:
    """(actual, predicted) for every pair of classes seen as label or prediction;
    NULL is a class of its own."""
    v = df.select(F.col(label).alias("c")).union(df.select(F.col(pred).alias("c"))).distinct()
    every = v.agg(F.collect_set(F.struct("c")).alias("cs"))  # a struct: collect_set skips bare nulls
    return every.select(F.explode("cs").alias("a"), "cs").select(F.col("a.c").alias("actual"), F.explode("cs").alias("p")) \
        .select("actual", F.col("p.c").alias("predicted"))


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "prediction",
                     labels: list[str] | None = None, normalize: bool = False) -> DataFrame:
    """(actual, predicted, n) for every class pair, zeros included, rows with
    a NULL label or prediction under the class NULL; `normalize` divides by the
    actual-class total (empty rows -> 0).  `labels` fixes the classes."""
    counts = df.groupBy(F.col(label).alias("_a"), F.col(pred).alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    if labels is None:
        grid = class_pairs(df, label, pred)
    else:
        cs = F.array(*[F.lit(x) for x in labels])
        grid = df.sparkSession.range(1).select(F.explode(cs).alias("actual")).withColumn("predicted", F.explode(cs))
    same = F.col("actual").eqNullSafe(F.col("_a")) & F.col("predicted").eqNullSafe(F.col("_p"))
    cm = grid.join(counts, same, "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))
    if normalize:
        tot = F.sum("n").over(Window.partitionBy("actual"))
        cm = cm.withColumn("rate", F.coalesce(F.try_divide(F.col("n").cast("double"), tot), F.lit(0.0)))
    return cm


def per_class(cm: DataFrame) -> DataFrame:
    """Per-class tp, predicted total, actual total from a confusion table."""
    hit = F.when(F.col("actual").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(0)
    ends = F.array(F.struct(F.col("actual").alias("cls"), hit.alias("tp"), F.lit(0).cast("long").alias("p"), F.col("n").alias("a")),
                   F.struct(F.col("predicted").alias("cls"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("p"),
                            F.lit(0).cast("long").alias("a")))
    return cm.select(F.inline(ends)).groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("p").alias("n_pred"),
                                                        F.sum("a").alias("support"))


def classification_report(cm: DataFrame) -> DataFrame:
    """Precision, recall, F1, support per class (zero division -> 0)."""
    p = per_class(cm)
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("n_pred")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return p.select(F.col("cls").alias("class"), prec.alias("precision"), rec.alias("recall"),
                    f1.alias("f1"), F.col("support"), F.col("tp"))


def classification_metrics(cm: DataFrame) -> DataFrame:
    """Accuracy, macro precision / recall / F1, weighted F1."""
    r = classification_report(cm)
    return r.agg((F.sum("tp") / F.sum("support")).alias("accuracy"),
                 F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
                 F.avg("f1").alias("f1_macro"),
                 (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"))


def binary_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1, accuracy of a boolean detector, one pass."""
    a, p = F.col(actual).cast("boolean"), F.col(predicted).cast("boolean")
    c = df.agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"),
               F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    acc = (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return c.select("tp", "fp", "fn", "tn", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
                    acc.alias("accuracy"))


def _score_counts(df: DataFrame, score: str, positive) -> DataFrame:
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(positive).alias("np"), F.count_if(~positive).alias("nn"))


def roc_curve(df: DataFrame, score: str, positive) -> DataFrame:
    """One point per distinct threshold (score >= t): tpr, fpr."""
    s = _score_counts(df, score, positive)
    s = s.withColumn("_neg", -F.col("score"))  # descending thresholds
    c = global_cumsum(s, "_neg", ["np", "nn"])
    tot = s.agg(F.sum("np").alias("P"), F.sum("nn").alias("N")).first()
    P, N = float(tot["P"] or 0), float(tot["N"] or 0)
    return c.select(F.col("score").alias("threshold"),
                    (F.col("np_cum") / F.lit(P) if P else F.lit(0.0)).alias("tpr"),
                    (F.col("nn_cum") / F.lit(N) if N else F.lit(0.0)).alias("fpr"))


def roc_auc(df: DataFrame, score: str, positive) -> DataFrame:
    """Exact AUC (ties count one half): sum over scores of
    positives x (negatives below + negatives tied / 2) / (P x N)."""
    s = _score_counts(df, score, positive)
    c = global_cumsum(s, "score", ["nn"])
    return c.agg(F.try_divide(F.sum(F.col("np") * (F.col("nn_cum") - F.col("nn") * 0.5)),
                              (F.sum("np") * F.sum("nn")).cast("double")).alias("auc"))


def roc_auc_ovr(df: DataFrame, label: str, score_cols: dict[str, str]) -> DataFrame:
    """Macro one-vs-rest AUC over classes present as true labels, all
    classes in one pass: (class, score) counts, running sums of negatives per
    class (distributed, see `global_cumsum`), one grouped sum."""
    items = [F.struct(F.lit(cls).alias("cls"), F.col(sc).cast("double").alias("score"),
                      (F.col(label) == cls).alias("pos")) for cls, sc in score_cols.items()]
    x = df.select(F.inline(F.array(*items)))
    s = x.groupBy("cls", "score").agg(F.count_if(F.col("pos")).alias("np"), F.count_if(~F.col("pos")).alias("nn"))
    c = global_cumsum(s, "score", ["nn"], part=["cls"])
    per = c.groupBy("cls").agg(F.try_divide(F.sum(F.col("np") * (F.col("nn_cum") - F.col("nn") * 0.5)),
                                            (F.sum("np") * F.sum("nn")).cast("double")).alias("auc"))
    per = per.filter(F.col("auc").isNotNull())
    return per.agg(F.avg("auc").alias("roc_auc_ovr"), F.count(F.lit(1)).alias("n_classes"))


def compare_models(metrics: DataFrame, order_by: str = "f1_macro") -> DataFrame:
    """Long (model, metric, value) -> one row per model, with a best flag
    per metric (training time: lowest is best)."""
    best = F.when(F.col("metric").isin("training_time_s", "memory_delta_mb"),
                  F.col("value") == F.min("value").over(Window.partitionBy("metric"))) \
            .otherwise(F.col("value") == F.max("value").over(Window.partitionBy("metric")))
    return metrics.withColumn("is_best", best)


def best_model(metrics: DataFrame, by: str = "f1_macro") -> DataFrame:
    """model with the highest score on metric `by` (ties: smallest name)."""
    return (metrics.filter(F.col("metric") == by)
            .agg(F.min_by("model", F.struct(-F.col("value"), F.col("model"))).alias("model"),
                 F.max("value").alias("value")))

"""Risk scoring and verdict gates (H11-H15, H19, H28, J17) and reproducible
sampling / splitting (A6, J1, J4)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight import dims
from flowsight.functions.columns import risk_category
from flowsight.operators.ordering import hash32, HASH_SPACE, few, join_same, rank_within
from flowsight.operators.stats import exact_quantile


def normalize_weights(weights: dict) -> dict:
    """H28."""
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()}


def risk_score(df: DataFrame, classifier: str | None = "classifier", graph: str | None = "graph",
               sequence: str | None = "sequence", anomaly: str | None = "anomaly",
               weights: dict | None = None, out: str = "risk_score",
               anomaly_scale: float | None = None) -> DataFrame:
    """Weighted mean of the supplied components x 100, clipped to [0, 100].
    classifier / sequence are probabilities, graph is 0-100 (divided by 100),
    anomaly >= 0 is divided by its 99th percentile and clipped (just clipped for
    a single row or an all-zero column).  Weights are renormalised over the
    components present in each row."""
    w = normalize_weights(weights or dict(dims.ENSEMBLE_WEIGHTS))
    comps = []
    if classifier:
        comps.append((F.col(classifier).cast("double"), w["classifier"]))
    if graph:
        comps.append((F.col(graph).cast("double") / 100.0, w["gnn"]))
    if sequence:
        comps.append((F.col(sequence).cast("double"), w["temporal"]))
    if anomaly:
        a = F.col(anomaly).cast("double")
        if anomaly_scale is not None:          # streams / single rows: a fixed scale (1.0 = clip only)
            a = a / F.lit(float(anomaly_scale))
        else:
            st = df.agg(F.count(F.col(anomaly)).alias("n"), F.max(anomaly).alias("mx")).first()
            if st["n"] > 1 and st["mx"] is not None and st["mx"] > 0:
                p99 = exact_quantile(df, anomaly, 0.99)
                a = a / F.lit(p99)
        comps.append((F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0)), w["autoencoder"]))
    num = sum((F.coalesce(c * wt, F.lit(0.0)) for c, wt in comps), F.lit(0.0))
    den = sum((F.when(c.isNotNull(), F.lit(wt)).otherwise(F.lit(0.0)) for c, wt in comps), F.lit(0.0))
    score = F.when(den > 0, num / den * 100.0).otherwise(num)
    return df.withColumn(out, F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)))


def confidence_gate(df: DataFrame, pred: str = "predicted_attack", conf: str = "confidence",
                    p_normal: str = "p_normal", min_conf: float = dims.MIN_ATTACK_CONFIDENCE) -> DataFrame:
    """An attack predicted with confidence below the gate becomes Normal and
    takes P(Normal) as its confidence."""
    gate = (F.col(pred) != "Normal") & (F.col(conf) < min_conf)
    return df.select(*[F.when(gate, F.col(p_normal)).otherwise(F.col(conf)).alias(c) if c == conf else
                       F.when(gate, F.lit("Normal")).otherwise(F.col(pred)).alias(c) if c == pred else F.col(c)
                       for c in df.columns])


def low_risk_override(df: DataFrame, pred: str = "predicted_attack", risk: str = "risk_score",
                      min_risk: float = dims.MIN_ATTACK_RISK) -> DataFrame:
    """An attack whose risk is below `min_risk` becomes Normal."""
    return df.withColumn(pred, F.when((F.col(pred) != "Normal") & (F.col(risk) < min_risk), F.lit("Normal"))
                         .otherwise(F.col(pred)))


def categorize(df: DataFrame, risk: str = "risk_score", out: str = "risk_label") -> DataFrame:
    """H12."""
    return df.withColumn(out, risk_category(F.col(risk)))


def batch_risk(flows: DataFrame, parts: dict[str, tuple[DataFrame, str]], weights: dict | None = None) -> DataFrame:
    """Risk of every flow from fitted components.  `parts` maps a component
    (classifier, graph, sequence, anomaly) to (DataFrame, key): one value per key, in a
    column of the component's name, joined onto the flows by that key; a flow without a
    value keeps the other components (H11), then H12."""
    x = flows
    for name, (df, key) in parts.items():
        x = x.join(df.select(F.col(key).alias(f"_{name}_key"), F.col(name)),
                   F.col(key) == F.col(f"_{name}_key"), "left").drop(f"_{name}_key")
    named = {n: (n if n in parts else None) for n in ("classifier", "graph", "sequence", "anomaly")}
    return categorize(risk_score(x, weights=weights, **named))


def risk_distribution(scored: DataFrame) -> DataFrame:
    """Flows and share per risk category."""
    c = scored.groupBy("risk_label").agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n")).first()[0] or 1
    return c.withColumn("share", F.col("n") / F.lit(total))


# --- sampling and splitting -------------------------------------------------

def sample_rows(df: DataFrame, frac: float, key: str = "id", seed: int = 42) -> DataFrame:
    """Reproducible sample: keep rows whose seeded key hash is below
    frac x 2^32 (independent of partitioning)."""
    return df.filter(hash32(key, seed=seed) < F.lit(int(frac * HASH_SPACE)))


def stratified_split(df: DataFrame, label: str = "label", key: str = "id", seed: int = 42,
                     train: int = 70, val: int = 15) -> DataFrame:
    """Exact per-class split sizes train = round(n x 70%), val =
    round(n x 15%), test = rest, with at least one row in each split when a class
    has 3 or more rows.  Rows are ranked by a seeded hash inside their class
    (hash-bucketed, so a majority class is spread over many tasks).  NULL is a class of its own."""
    x = df.withColumn("_h", hash32(key, seed=seed))
    x = rank_within(x, [label], "_h", key, "_rk")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    n = F.col("_n")
    ntr = F.expr(f"(_n * {train} + 50) div 100")
    nva = F.expr(f"(_n * {val} + 50) div 100")
    ntr = F.when(n >= 3, F.least(F.greatest(ntr, F.lit(1)), n - 2)).otherwise(ntr)
    nva = F.when(n >= 3, F.least(F.greatest(nva, F.lit(1)), n - ntr - 1)).otherwise(nva)
    sizes = sizes.select(label, ntr.alias("_ntr"), nva.alias("_nva"))
    x = join_same(x, few(sizes), [label])  # one row per class
    split = F.when(F.col("_rk") < F.col("_ntr"), "train") \
             .when(F.col("_rk") < F.col("_ntr") + F.col("_nva"), "val").otherwise("test")
    return x.withColumn("split", split).drop("_h", "_rk", "_ntr", "_nva")


def oversample(df: DataFrame, label: str = "label", key: str = "id", seed: int = 42) -> DataFrame:
    """Replicate every class to the majority class size; copy k of row r is
    kept while k x n_c + rank(r) < n_max (exact sizes, reproducible).  NULL is a class of its own."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    n_max = sizes.agg(F.max("_nc")).first()[0]
    x = df.withColumn("_h", hash32(key, seed=seed))
    x = join_same(rank_within(x, [label], "_h", key, "_rk"), few(sizes), [label])
    reps = F.expr(f"CAST(({n_max} + _nc - 1) div _nc AS INT)")
    x = x.withColumn("copy_no", F.explode(F.sequence(F.lit(0), reps - 1)))
    x = x.filter(F.col("copy_no") * F.col("_nc") + F.col("_rk") < F.lit(n_max))
    return x.drop("_h", "_rk", "_nc")

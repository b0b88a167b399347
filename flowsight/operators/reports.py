"""Monitoring questions over the flow table (D1-D6, D16, C8, C9, F1, F6, A9,
A10, E6, E12, E13, B12, B16, H26, H27, I6, I7).

All aggregates are single-pass hash aggregations with map-side partial
combine; zero-filled category counts use conditional counts over a fixed,
bounded category list (no join); top-k uses TakeOrderedAndProject.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsight import dims
from flowsight.operators.ordering import global_row_number


def _stack(df: DataFrame, pairs: list[tuple[str, str]], key_name: str, val_name: str,
           extra: list[tuple[str, str]] | None = None) -> DataFrame:
    """Unpivot a one-row aggregate into (key, value) rows."""
    cols = [F.struct(F.lit(k).alias(key_name), F.col(c).alias(val_name),
                     *[F.lit(v).alias(n) for n, v in (extra or [])]) for k, c in pairs]
    return df.select(F.inline(F.array(*cols)))


def value_counts(df: DataFrame, col: str, out: str = "n") -> DataFrame:
    """D1."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(out))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (k * n_c), computed on the per-class counts."""
    counts = value_counts(df, label, "n_c")
    whole = Window.partitionBy()  # over the tiny per-class table only
    return counts.select(label, "n_c", (F.sum("n_c").over(whole) /
                                        (F.count(F.lit(1)).over(whole) * F.col("n_c"))).alias("weight"))


def flow_stats(df: DataFrame) -> DataFrame:
    """D3: total, threats, critical in one pass."""
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.count_if(F.col("predicted_attack") != "Normal").alias("threats"),
                  F.count_if(F.col("risk_label") == "Critical").alias("critical"))


def risk_summary(df: DataFrame) -> DataFrame:
    """D4."""
    return df.agg(F.avg("risk_score").alias("avg_risk"), F.max("risk_score").alias("peak_risk"),
                  F.count(F.lit(1)).alias("n_flows"))


def attack_rows(df: DataFrame) -> DataFrame:
    """B12."""
    return df.filter(F.col("predicted_attack") != "Normal")


def attack_distribution(df: DataFrame) -> DataFrame:
    """Attack-type counts and shares, Normal excluded."""
    c = value_counts(attack_rows(df), "predicted_attack")
    return c.select("predicted_attack", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def dominant_attack(df: DataFrame) -> DataFrame:
    """Most frequent attack type (ties -> smallest name)."""
    return (value_counts(attack_rows(df), "predicted_attack")
            .orderBy(F.desc("n"), F.asc("predicted_attack")).limit(1))


def risk_level_counts(df: DataFrame, col: str = "risk_label") -> DataFrame:
    """Counts for every risk level, zeros included."""
    agg = df.agg(*[F.count_if(F.col(col) == lvl).alias(f"_c{i}") for i, lvl in enumerate(dims.RISK_LEVELS)])
    return _stack(agg, [(lvl, f"_c{i}") for i, lvl in enumerate(dims.RISK_LEVELS)], "risk_label", "n")


def kill_chain_counts(df: DataFrame, col: str = "predicted_attack") -> DataFrame:
    """A flow counts for every phase whose attack list contains its label as
    a substring (one label can hit two phases).  The phase list is fixed, so this
    is one conditional aggregation instead of a theta join."""
    aggs = [F.count_if(F.lit(attacks).contains(F.col(col))).alias(f"_p{i}")
            for i, (_, attacks) in enumerate(dims.KILL_CHAIN)]
    agg = df.agg(*aggs)
    rows = [F.struct(F.lit(i).alias("phase_order"), F.lit(p).alias("phase"), F.col(f"_p{i}").alias("n"))
            for i, (p, _) in enumerate(dims.KILL_CHAIN)]
    return agg.select(F.inline(F.array(*rows)))


def timeline(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Sequence index, 0 = newest.  With `limit` only the newest rows
    (a top-k, then numbered in one small task); otherwise the whole table is
    numbered by the distributed global row number."""
    if limit is not None:
        top = df.orderBy(F.desc("id")).limit(limit)
        return top.withColumn("seq", F.row_number().over(Window.orderBy(F.desc("id"))) - 1)
    x, _ = global_row_number(df, "id", ascending=False, out="_rn")
    return x.withColumn("seq", F.col("_rn") - 1).drop("_rn")


def row_windows(df: DataFrame, k: int = 20) -> tuple[DataFrame, int]:
    """Windows of max(1, n div k) rows, newest first, labelled W1, W2, ..."""
    x, n = global_row_number(df, "id", ascending=False, out="_rn")
    size = max(1, n // k)
    x = x.withColumn("window_no", ((F.col("_rn") - 1) / size).cast("long") + 1)
    return x.withColumn("window", F.concat(F.lit("W"), F.col("window_no").cast("string"))).drop("_rn"), n


def attack_density(df: DataFrame, k: int = 20, attacks=None) -> DataFrame:
    """(window x attack) counts, zero-filled over the fixed attack list and every
    attack in the data."""
    x, _ = row_windows(df.select("id", "predicted_attack"), k)
    counts = x.groupBy("window_no", "window", F.col("predicted_attack").alias("attack")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.persist()
    try:
        seen = counts.agg(F.collect_set("attack").alias("s"), F.collect_set(F.struct("window_no", "window")).alias("w"))
        fixed = F.array(*[F.lit(a) for a in (attacks or dims.ATTACK_LABELS)])
        grid = seen.select(F.explode(F.array_union(fixed, F.col("s"))).alias("attack"), "w") \
            .select("attack", F.inline("w"))
        out = grid.join(counts, ["window_no", "window", "attack"], "left").select(
            "window_no", "window", "attack", F.coalesce("n", F.lit(0)).alias("n"))
        return out.checkpoint()
    finally:
        counts.unpersist()


def recent_flows(df: DataFrame, n: int = 50) -> DataFrame:
    """Newest n flows (TakeOrderedAndProject)."""
    return df.orderBy(F.desc("id")).limit(n)


def top_risk(df: DataFrame, n: int = 15) -> DataFrame:
    """highest-risk flows (newest first among ties)."""
    return df.orderBy(F.desc("risk_score"), F.desc("id")).limit(n)


def latest_attack(df: DataFrame) -> DataFrame:
    """F6."""
    return attack_rows(df).orderBy(F.desc("id")).limit(1)


FLOW_KEY = ["src_ip", "src_port", "dst_ip", "dst_port"]


def latest_per_flow(df: DataFrame, keys=FLOW_KEY, order: str = "id") -> DataFrame:
    """Newest row per flow 4-tuple.  `max_by` is partially aggregated
    map-side, so a hot tuple never gathers its rows in one task."""
    others = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order)).alias("_r"))
    return agg.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])


def update_latest(df: DataFrame, updates: DataFrame, set_cols: list[str], keys=FLOW_KEY,
                  order: str = "id") -> DataFrame:
    """A10: apply updates (keys + set_cols + order) to the newest row of each key;
    with several updates for a key the newest one wins.  Returns the whole table."""
    target = df.groupBy(*keys).agg(F.max(order).alias("_target"))
    upd = updates.groupBy(*keys).agg(F.max_by(F.struct(*set_cols), F.col(order)).alias("_u"))
    patch = target.join(upd, keys).select(F.col("_target").alias(order), F.lit(True).alias("_hit"),
                                          *[F.col(f"_u.{c}").alias(f"_new_{c}") for c in set_cols])
    x = df.join(patch, order, "left")
    has = F.coalesce(F.col("_hit"), F.lit(False))  # an update may set NULLs
    out = [F.when(has, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in set_cols else F.col(c)
           for c in df.columns]
    return x.select(*out, has.alias("updated"))


def flows_touching(df: DataFrame, ip: str) -> DataFrame:
    """B16."""
    return df.filter((F.col("src_ip") == ip) | (F.col("dst_ip") == ip))


def attention_flag(df: DataFrame) -> DataFrame:
    """Attack, else Medium-risk warning, else none."""
    return df.withColumn("attention", F.when(F.col("predicted_attack") != "Normal", "attack")
                         .when(F.col("risk_label") == "Medium", "warning").otherwise("none"))


def alert_view(df: DataFrame) -> DataFrame:
    """Display projection of the alert feed."""
    return df.select(F.col("ts").alias("Time"), F.col("src_ip").alias("Source"),
                     F.col("dst_ip").alias("Target"), F.col("predicted_attack").alias("Attack Type"),
                     F.col("risk_label").alias("Severity"), F.col("risk_score").alias("Risk Score"),
                     F.col("confidence").alias("Confidence"))


def traffic_view(df: DataFrame) -> DataFrame:
    """Display projection of the live stream."""
    return df.select("ts", "src_ip", "src_port", "dst_ip", "dst_port", "protocol",
                     "predicted_attack", "risk_label", "risk_score", "confidence")


def route_alerts(df: DataFrame) -> DataFrame:
    """Critical -> block and alert, High -> alert; other flows need no action."""
    x = df.filter((F.col("predicted_attack") != "Normal") & F.col("risk_label").isin("Critical", "High"))
    return x.withColumn("action", F.when(F.col("risk_label") == "Critical", "block_and_alert")
                        .otherwise("alert"))


def block_list(df: DataFrame) -> DataFrame:
    """Each critical attacking source once, with the first attack seen."""
    x = df.filter((F.col("predicted_attack") != "Normal") & (F.col("risk_label") == "Critical"))
    return x.groupBy("src_ip").agg(F.min_by("predicted_attack", "id").alias("attack_type"),
                                   F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_critical"))

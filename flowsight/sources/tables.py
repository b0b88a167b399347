"""Parquet tables of a scale-factor directory and the derived `flows` view.

The `flows` view maps the driver's `events` table onto the live flow-table
schema (one row per network flow).  It is a pure projection, so filters and
column pruning still reach the Parquet scan.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsight import dims
from flowsight.functions.columns import micros, risk_category

TABLE_NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def map_lookup(c: Column, mapping: dict, default: str | None = None) -> Column:
    """Small fixed dictionary lookup as a CASE expression (no join needed)."""
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == k, v) if expr is None else expr.when(c == k, v)
    return expr.otherwise(F.lit(default)) if default is not None else expr


def flows_from_events(events: DataFrame) -> DataFrame:
    """events -> flows (id, ts, us, src, dst, src_ip, dst_ip, dst_port, src_port, protocol,
    raw_label, label, value, risk_score, risk_label, confidence, predicted_attack)."""
    port = F.element_at(F.array(*[F.lit(p) for p in dims.EVENT_PORTS]),
                        (F.col("event_id") % len(dims.EVENT_PORTS) + 1).cast("int"))
    dst = F.get_json_object("props", "$.k").cast("long")
    label = map_lookup(F.col("event_type"), dims.EVENT_LABEL_MAP, "Normal")
    risk = F.least(F.col("value"), F.lit(100.0))
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts"),
        micros(F.col("ts")).alias("us"),
        F.col("user_id").alias("src"),
        dst.alias("dst"),
        F.concat(F.col("user_id").cast("string"), F.lit(".1.1.1")).alias("src_ip"),
        F.concat(dst.cast("string"), F.lit(".0.0.1")).alias("dst_ip"),
        port.alias("dst_port"),
        (F.lit(49152) + F.col("user_id")).cast("int").alias("src_port"),
        F.lit("TCP").alias("protocol"),
        F.col("event_type").alias("raw_label"),
        label.alias("label"),
        F.col("value"),
        risk.alias("risk_score"),
        risk_category(risk).alias("risk_label"),
        (risk / 100.0).alias("confidence"),
        label.alias("predicted_attack"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows_from_events(table(spark, sf_dir, "events"))


def dirty_lineitem(li: DataFrame) -> DataFrame:
    """Flow-feature stand-in with planted edge values (inf, -inf, NaN, NULL, an
    all-NaN column, sparse columns, a constant column, NULL categories)."""
    ln = F.col("l_linenumber")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    rate = (F.when(ln == 7, inf).when(ln == 6, -inf).when(ln == 5, nan)
            .when((ln == 4) & (F.col("l_returnflag") == "R"), F.lit(None).cast("double"))
            .otherwise(F.col("l_extendedprice") / F.col("l_quantity")))
    return li.select(
        (F.col("l_orderkey") * 8 + ln).alias("id"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        rate.alias("rate"),
        nan.alias("all_nan"),
        F.when(F.col("l_tax") < 0.04, F.lit(None).cast("double")).otherwise(F.col("l_tax")).alias("sparse_a"),
        F.when(F.col("l_tax") <= 0.04, F.lit(None).cast("double")).otherwise(F.col("l_tax")).alias("sparse_b"),
        F.lit(1.0).alias("const"),
        F.when(ln.isin(2, 3), F.lit(None).cast("string")).otherwise(F.col("l_returnflag")).alias("flag"),
        F.col("l_linestatus").alias("status"),
    )


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty_lineitem(table(spark, sf_dir, "lineitem"))


def flow_features_from_lineitem(li: DataFrame) -> DataFrame:
    """Flow-feature table stand-in with the reference's column naming (rates with
    '/', packet-length and flag-count columns, Label)."""
    ln = F.col("l_linenumber")
    q_, p_ = F.col("l_quantity"), F.col("l_extendedprice")
    label = F.when(F.col("l_returnflag") == "A", "Brute_Force").when(F.col("l_returnflag") == "R", "Port_Scan") \
             .otherwise("Normal")
    return li.select(
        (F.col("l_orderkey") * 8 + ln).alias("id"),
        F.when(ln == 1, F.lit(0.0)).otherwise(q_ * 1000.0).alias("Flow_Duration"),
        q_.alias("Tot_Fwd_Pkts"),
        ln.cast("double").alias("Tot_Bwd_Pkts"),
        p_.alias("TotLen_Fwd_Pkts"),
        (p_ * F.col("l_discount")).alias("TotLen_Bwd_Pkts"),
        (p_ / q_).alias("Fwd_Pkt_Len_Max"),
        (F.col("l_tax") * 100.0).alias("Pkt_Len_Mean"),
        (F.col("l_discount") * 100.0).alias("Pkt_Size_Avg"),
        (p_ / q_ * 1000.0).alias("Flow_Byts/s"),
        (q_ / ln).alias("Flow_Pkts/s"),
        (ln % 2).cast("double").alias("SYN_Flag_Cnt"),
        (ln % 3).cast("double").alias("ACK_Flag_Cnt"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("PSH_Flag_Cnt"),
        F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0).alias("RST_Flag_Cnt"),
        label.alias("Label"),
    )


def flow_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_features_from_lineitem(table(spark, sf_dir, "lineitem"))


def kb_from_documents(docs: DataFrame) -> DataFrame:
    """Technique knowledge-base stand-in (id, name, description, mitigation):
    one technique per document, id T<1000 + doc_id>, full text as description."""
    from flowsight.operators.attack import techniques_from
    x = docs.select(F.concat(F.lit("T"), (F.lit(1000) + F.col("doc_id")).cast("string")).alias("Tactic ID"),
                    F.concat_ws(" ", "source", "lang").alias("Tactic Name"),
                    F.col("text").alias("Description"),
                    F.concat(F.lit("Review source "), F.col("source")).alias("Mitigation Steps"),
                    F.col("doc_id").alias("_ord"))
    return techniques_from(x, "Tactic ID", "Tactic Name", "Description", "Mitigation Steps", "_ord")


def actors_from_documents(docs: DataFrame) -> DataFrame:
    """Actor/technique table stand-in: group = source, techniques a ';' list
    with one non-technique token to exercise the filter."""
    return docs.select(F.col("source").alias("APT Group Name"),
                       F.concat(F.lit("T"), (F.lit(1000) + F.col("doc_id")).cast("string"), F.lit("; "),
                                F.col("lang"), F.lit(";T"), F.col("n_chars").cast("string"), F.lit(" "))
                       .alias("Group Techniques"))

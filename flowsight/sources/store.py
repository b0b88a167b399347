"""Flow-table and artifact persistence (A7, A8, A11, A12, D30).  Plain Parquet
/ JSON / CSV datasets; writes are whole-dataset jobs, never driver loops."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsight.session import join_path

LIVE_SCHEMA = ("id long, timestamp timestamp, src_ip string, src_port int, dst_ip string, dst_port int, "
               "protocol string, risk_score double, risk_label string, predicted_attack string, "
               "confidence double, explanation string, features_json string")


def to_live_rows(df: DataFrame, feature_cols: list[str], explanation: str | None = None) -> DataFrame:
    """A8 projection: the live-table columns, features as a JSON object text."""
    feats = F.to_json(F.struct(*[F.col(f"`{c}`") for c in feature_cols]))
    return df.select("id", F.col("ts").cast("timestamp").alias("timestamp"), "src_ip", "src_port", "dst_ip",
                     "dst_port", "protocol", "risk_score", "risk_label", "predicted_attack", "confidence",
                     (F.col(explanation) if explanation else F.lit("")).alias("explanation"),
                     feats.alias("features_json"))


def append_flows(df: DataFrame, path: str) -> None:
    """Append scored flows to the flow table."""
    df.write.mode("append").parquet(path)


def reset_flows(spark: SparkSession, path: str, schema: str = LIVE_SCHEMA) -> None:
    """Start a fresh session (empty table with the fixed schema)."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def save_prepared(df: DataFrame, path: str, split_col: str = "split") -> None:
    """Processed splits, one directory per split."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(join_path(path, "splits"))


def load_prepared(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(join_path(path, "splits"))


def save_table(df: DataFrame, path: str) -> None:
    """Small artifacts (scaler statistics, class weights, label index,
    contributions) as Parquet."""
    df.write.mode("overwrite").parquet(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """Evaluation report as JSON lines and the comparison table as CSV."""
    metrics.write.mode("overwrite").json(join_path(path, "evaluation_report"))
    metrics.write.mode("overwrite").option("header", True).csv(join_path(path, "model_comparison"))

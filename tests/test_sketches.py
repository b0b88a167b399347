"""Quantile sketches: rank error over ranges of days, and a threshold that follows a stream."""
import numpy as np
from pyspark.sql import functions as F

from flowsight.operators import sketches as S


def test_rank_error_of_any_range(spark):
    n = 200_000
    x = spark.range(n).select(F.timestamp_seconds(F.col("id") % 20 * 86_400).alias("ts"),
                              (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0).alias("v"),
                              F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).when(F.col("id") % 3 == 1, F.col("id") % 7).alias("w"))
    kept = S.daily_sketches(x, ["v", "w"]).checkpoint()
    assert kept.count() == 40 and kept.agg(F.max(F.length("sketch"))).first()[0] < 40_000
    rows = x.select(F.to_date("ts").alias("day"), "v", "w").toPandas()
    for first, last in ((None, None), ("1970-01-03", "1970-01-09"), ("1970-01-20", None)):
        part = rows[[(first is None or str(d) >= first) and (last is None or str(d) <= last) for d in rows.day]]
        for r in S.merged_quantiles(kept, [0.01, 0.25, 0.5, 0.95], first, last).collect():
            v = np.sort(part[r.column].dropna().to_numpy())
            assert r.n == len(v)
            lo, hi = np.searchsorted(v, r.value, "left") / len(v), np.searchsorted(v, r.value, "right") / len(v)
            assert max(0.0, lo - r.p, r.p - hi) < 0.005, r
    assert S.threshold(kept, "v", 0.5, "1980-01-01") is None


def test_threshold_follows_the_stream(spark, tmp_path):
    base = str(tmp_path)
    x = spark.range(6000).select("id", F.timestamp_seconds("id").alias("ts"), F.pmod(F.xxhash64("id"), F.lit(100_000)).cast("double").alias("v"),
                                 F.when(F.col("id") % 3 == 0, "Attack").otherwise("Normal").alias("label"))
    stream = lambda: spark.readStream.schema(x.schema).parquet(f"{base}/in")
    for part in range(3):  # one restart per slice
        x.where((F.col("id") >= part * 2000) & (F.col("id") < part * 2000 + 2000)).coalesce(1).write.mode("append").parquet(f"{base}/in")
        S.flag_stream(stream(), "v", f"{base}/sketches", f"{base}/out", f"{base}/ck", 0.9, F.col("label") == "Normal").awaitTermination()
    out = spark.read.parquet(f"{base}/out").toPandas()
    assert len(out) == 6000 and out.id.is_unique
    assert not out[out.batch == 0].is_anomaly.any()
    benign = x.where("label = 'Normal'").toPandas()
    for b in (1, 2):
        rows = out[out.batch == b]
        before = benign[benign.id < b * 2000].v
        cut = rows.threshold.iloc[0]
        assert (rows.threshold == cut).all() and abs((before <= cut).mean() - 0.9) < 0.006
        assert (rows.is_anomaly == (rows.v > cut)).all()

"""Row blocks and time buckets must not change results: force tiny blocks and
buckets so carried rows and context copies are exercised, compare to DuckDB."""
from pyspark.sql import functions as F

from cases import SF01
from flowsight.functions.columns import r6
from flowsight.operators import behavior as B
from flowsight.operators import windows as W
from flowsight.plans.all import ORACLE
from flowsight.sources.tables import flows
from oracle_check import compare, duck


def test_rolling_with_tiny_blocks(spark):
    x = W.rolling_stats(flows(spark, SF01).select("id", "us", "src_ip", "value"), "value", block_rows=13)
    cols = ["value_rolling_mean_10", "value_rolling_std_10", "value_rolling_max_10", "value_diff",
            "value_pct_change"]
    x = x.select("id", *[r6(F.col(c)).alias(c) for c in cols])
    assert compare(x, duck(SF01), ORACLE["rolling_stats"]) is None


def test_sequences_with_tiny_blocks(spark):
    x = W.make_sequences(flows(spark, SF01).select("id", "us", "src_ip", "value", "label"), ["value"],
                         block_rows=23)
    flat = F.flatten("sequence")
    x = x.select("id", F.size("sequence").cast("long").alias("seq_len"),
                 r6(F.aggregate(flat, F.lit(0.0), lambda a, b: a + b)).alias("seq_sum"),
                 r6(F.element_at(flat, 1)).alias("first_value"), r6(F.element_at(flat, -1)).alias("last_value"),
                 "target")
    assert compare(x, duck(SF01), ORACLE["make_sequences"]) is None


def test_verdict_with_small_buckets(spark):
    # buckets equal to the window: every row has back and forward context copies
    f = flows(spark, SF01).select("id", "us", "src_ip", "dst_ip", "dst_port")
    v = B.behavioral_verdict(f, 86400, 6, 5, 3, bucket_secs=86400)
    v = v.select("id", "src_ip", "dst_ip", "dst_port", "src_rate", "src_fanout", "auth_count",
                 "behavioral_attack", r6(F.col("behavioral_confidence")).alias("behavioral_confidence"),
                 "behavioral_reason")
    assert compare(v, duck(SF01), ORACLE["behavioral_verdict"]) is None


def test_bucket_shrinks_for_a_burst(spark):
    from flowsight.operators.sliding import choose_bucket_secs
    # 50,000 flows of one source within ten minutes, target 1,000 rows per bucket
    burst = spark.range(50_000).select(F.lit("9.9.9.9").alias("src_ip"),
                                       (F.lit(1_704_067_200_000_000) + F.col("id") * 12_000).alias("us"))
    b = choose_bucket_secs(burst, ["src_ip"], "us", 30, target_rows=1_000)
    assert 30 <= b < 3600 and b == max(30.0, 3600 * 1_000 / 50_000)
    assert choose_bucket_secs(burst, ["src_ip"], "us", 30, target_rows=100_000) == 3600


def test_bursts_inside_a_window_are_counted_over_range_partitions(spark):
    import random
    rng = random.Random(6)
    rows = []
    for i in range(1500):   # two sources flood within three seconds, others are calm
        src = rng.choice(["f1", "f1", "f2", None, "c1", "c2"])
        t = rng.randrange(3_000_000) if src in ("f1", "f2", None) else rng.randrange(40_000) * 1_000_000
        rows.append((i, src, rng.choice("wxyz"), t, rng.random() < 0.9))
    df = spark.createDataFrame(rows, "id long, src string, dst string, us long, ok boolean")
    from flowsight.operators import sliding as S
    hot = S.burst_keys(df, {"k": ["src"]}, "us", 1, 100)["k"]
    assert hot.count() == 3   # f1, f2 and the NULL source
    got = {r.id: (r.n, r.d) for r in S.sliding_counts(df, ["src"], "us", 1, count_col="n", distinct={"d": "dst"},
                                                      where=F.col("ok"), burst_rows=100).collect()}
    assert len(got) == len(rows)
    for i, s, _, t, ok in rows:
        near = [r for r in rows if r[1] == s and r[4] and t - 1_000_000 < r[3] <= t]
        assert got[i] == ((len(near), len({r[2] for r in near})) if ok else (None, None))


def test_verdict_with_bursts_equals_the_oracle(spark):
    f = flows(spark, SF01).select("id", "us", "src_ip", "dst_ip", "dst_port")
    v = B.behavioral_verdict(f, 86400, 6, 5, 3, burst_rows=5)
    v = v.select("id", "src_ip", "dst_ip", "dst_port", "src_rate", "src_fanout", "auth_count",
                 "behavioral_attack", r6(F.col("behavioral_confidence")).alias("behavioral_confidence"),
                 "behavioral_reason")
    assert compare(v, duck(SF01), ORACLE["behavioral_verdict"]) is None

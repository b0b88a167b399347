"""Distributed global row numbers and running sums with many forced buckets
must equal a single sorted pass."""
from pyspark.sql import functions as F

from cases import SF01
from flowsight.operators.ordering import global_cumsum, global_row_number, rank_within, hash32


def test_global_row_number_many_buckets(spark):
    f = spark.read.parquet(f"{SF01}/events.parquet").select(F.col("event_id").alias("id"))
    x, n = global_row_number(f, "id", ascending=False, out="rn", rows_per_bucket=97)
    got = {r["id"]: r["rn"] for r in x.collect()}
    ids = sorted(got, reverse=True)
    assert n == len(ids) and all(got[i] == pos + 1 for pos, i in enumerate(ids))


def test_global_cumsum_partitioned_many_buckets(spark):
    f = spark.read.parquet(f"{SF01}/events.parquet").select(
        F.col("event_id").alias("k"), F.col("event_type").alias("p"), F.lit(1).alias("one"),
        (F.col("value") * 100).cast("long").alias("v"))
    got = global_cumsum(f, "k", ["one", "v"], rows_per_bucket=113, part=["p"]).toPandas()
    pdf = f.toPandas().sort_values(["p", "k"])
    pdf["one_cum"] = pdf.groupby("p")["one"].cumsum()
    pdf["v_cum"] = pdf.groupby("p")["v"].cumsum()
    m = got.merge(pdf, on=["k", "p"], suffixes=("", "_want"))
    assert len(m) == len(pdf)
    assert (m["one_cum"] == m["one_cum_want"]).all() and (m["v_cum"] == m["v_cum_want"]).all()


def test_rank_within_is_dense_per_group(spark):
    f = spark.read.parquet(f"{SF01}/events.parquet").select(F.col("event_id").alias("id"), "event_type")
    x = rank_within(f.withColumn("h", hash32("id")), ["event_type"], "h", "id", "r", rows_per_bucket=97).toPandas()
    for _, g in x.groupby("event_type"):
        assert sorted(g["r"]) == list(range(len(g)))
        assert list(g.sort_values(["h", "id"])["r"]) == list(range(len(g)))


def test_row_numbers_keep_the_order_of_large_ids_and_strings(spark):
    base = 1 << 60
    rows = [(base + i * 3 % 5000, f"10.0.{i % 7}.{i}") for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, ip string").dropDuplicates(["id"])
    for key in ("id", "ip"):
        x, n = global_row_number(df, key, out="rn", tiebreak="id", rows_per_bucket=301)
        got = sorted(x.collect(), key=lambda r: r["rn"])
        assert [r["rn"] for r in got] == list(range(1, n + 1))
        want = sorted((r[key], r["id"]) for r in got)
        assert [(r[key], r["id"]) for r in got] == want


def test_rank_within_counts_null_groups(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "a") for i in range(200)], "id long, g string")
    x = rank_within(df.withColumn("h", hash32("id")), ["g"], "h", "id", "r", rows_per_bucket=13).collect()
    for g in (None, "a"):
        assert sorted(r.r for r in x if r.g == g) == list(range(sum(r.g == g for r in x)))
    assert len(x) == 200


def test_no_single_partition_exchange_of_rows(spark):
    f = spark.read.parquet(f"{SF01}/events.parquet").select(F.col("event_id").alias("id"))
    x, _ = global_row_number(f, "id", rows_per_bucket=97)
    plan = x._jdf.queryExecution().executedPlan().toString()
    # the only rows that meet in one task are one per partition
    assert plan.count("SinglePartition") <= 1 and "RDDScan" in plan or "Scan ExistingRDD" in plan

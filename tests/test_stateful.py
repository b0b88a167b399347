"""Keyed event-time state: out-of-order arrival, bounded state, sketches of constant size."""
import random
import uuid

import pytest
from pyspark.sql import functions as F

from flowsight.operators import behavior as B
from flowsight.session import ensure_checkpoint_dir, join_path
from flowsight.streaming import detector as D
from flowsight.streaming import stateful as S

KINDS = dict(c.split() for c in D.FLOW_SCHEMA.split(", "))


def flows(spark, rows):
    """rows: (id, seconds, src, dst, port)."""
    x = spark.createDataFrame(rows, "id long, s double, src_ip string, dst_ip string, dst_port int")
    x = x.withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")))
    fixed = {"src_port": 1, "protocol": "TCP", "predicted_attack": "Normal", "risk_label": "Low", "confidence": 0.5,
             "risk_score": 1.0, "value": 2.0}
    return x.select(*[F.col(c) if c in x.columns else F.lit(fixed[c]).cast(k).alias(c) for c, k in KINDS.items()])


def test_verdicts_of_flows_out_of_order(spark):
    rng = random.Random(3)
    rows = [(i, 1000 + i * 0.7 + rng.choice([0, 0.25]), f"10.0.0.{rng.choice([1, 1, 1, 2, 3])}",
             rng.choice(["8.8.8.8", *[f"10.1.0.{j}" for j in range(9)]]), rng.choice([22, 80, 443])) for i in range(240)]
    late = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 8))  # up to 8 s behind a newer flow
    base = join_path(ensure_checkpoint_dir(spark), "state-" + uuid.uuid4().hex)
    secs = (10.0, 6, 5, 3)

    def run(part):
        part.coalesce(1).write.mode("append").parquet(base + "/src")
        out = S.verdict_stream(D.flow_stream(spark, base + "/src"), "10 seconds", *secs)
        out.writeStream.format("parquet").option("path", base + "/out").option("checkpointLocation", base + "/ck") \
            .outputMode("append").trigger(availableNow=True).start().awaitTermination()
    for a in (0, 120):
        run(flows(spark, late[a:a + 120]))
    run(flows(spark, [(-1, 5000.0, D.END_SOURCE, "10.9.9.9", 80)]))
    batch = B.behavioral_verdict(flows(spark, rows).withColumn("us", F.unix_micros("ts")), *secs)
    cols = ["id", "src_rate", "src_fanout", "auth_count", "behavioral_attack", "behavioral_confidence", "behavioral_reason"]
    want = sorted(map(tuple, batch.select(cols).collect()))
    got = sorted(map(tuple, spark.read.parquet(base + "/out").where(F.col("src_ip") != D.END_SOURCE).select(cols).collect()))
    assert got == want and len({r[4] for r in got}) == 4 and any(r[1] is None for r in got)


def test_state_of_a_key_is_bounded_by_the_window():
    counts, tail = S.WindowCounts(1000), []
    for step in range(50):
        done = [(step * 500 + i, i, f"d{i % 7}", "") for i in range(0, 500, 50)]
        out, tail = counts.answer(done, tail, (step + 1) * 500 - 1)
        assert len(tail) <= 20 and (step < 2 or out[-1] == (20, 7))
    last, tail = S.LastVectors(3), []
    for step in range(10):
        out, tail = last.answer([(step, step, f"[{step}.0]", "")], tail, step)
        assert len(tail) <= 2 and out[0][0] == "[" + ",".join(f"[{i}.0]" for i in range(max(0, step - 2), step + 1)) + "]"


@pytest.mark.parametrize("n", [10, 300, 100_000, 1_000_000])
def test_sketch_of_many_destinations_stays_small(spark, n):
    x = spark.range(n).select(F.concat(F.lit("10."), "id").alias("dst_ip"), F.lit("s").alias("src_ip"),
                              F.timestamp_seconds(F.lit(1000)).alias("ts"))
    got = D.alert_windows(x, "30 seconds", "30 seconds").first()
    assert got.flows == n and abs(got.distinct_dsts - n) <= 0.03 * n
    size = x.agg(F.length(F.hll_sketch_agg("dst_ip", 13)).alias("b")).first().b
    assert size <= 10_000

"""Physical-plan properties the design relies on."""
import re

from pyspark.sql import functions as F

from cases import SF01
from flowsight.operators import behavior as B
from flowsight.sources.tables import flows


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_verdict_uses_two_hash_exchanges(spark):
    f = flows(spark, SF01).select("id", "us", "src_ip", "dst_ip", "dst_port")
    p = _plan(B.behavioral_verdict(f, 86400, 6, 5, 3))
    ex = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", p)
    assert len(ex) == 2, ex
    assert any("src_ip" in e for e in ex) and any("dst_port" in e for e in ex)
    assert "Union" not in p and "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


def test_flows_view_prunes_and_pushes_filters(spark):
    df = flows(spark, SF01).filter(F.col("src") == 3).select("id", "dst_port")
    p = df._jdf.queryExecution().executedPlan().toString()
    scan = [ln for ln in p.splitlines() if "FileScan parquet" in ln or "Scan parquet" in ln][0]
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,3)]" in scan
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in scan


def test_kill_chain_and_levels_need_no_join(spark):
    from flowsight.operators import reports as R
    f = flows(spark, SF01)
    for df in (R.kill_chain_counts(f), R.risk_level_counts(f)):
        p = _plan(df)
        assert "Join" not in p and "Exchange hashpartitioning" not in p

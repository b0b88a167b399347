"""Behavioural rules over sliding event-time windows.

Semantics of the reference's live detector, restated for event time:
a flow with a safe endpoint (or both endpoints local) never enters the window
state and gets no verdict; all windows are updated before the rules run; the
first matching rule wins: flood (flows per source), scan (distinct destination
addresses per source), brute force (attempts per destination address and auth
port).  The frame is (t - secs, t].
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight import dims
from flowsight.functions.columns import is_nonroutable, is_safe_ip
from flowsight.operators.sliding import BURST_ROWS, burst_keys, sliding_counts


def safe_flow(src_ip: str = "src_ip", dst_ip: str = "dst_ip", local_ips=()) -> F.Column:
    c = is_safe_ip(F.col(src_ip)) | is_safe_ip(F.col(dst_ip))
    if local_ips:
        c = c | (F.col(src_ip).isin(*local_ips) & F.col(dst_ip).isin(*local_ips))
    return c


def drop_safe_flows(df: DataFrame, src_ip="src_ip", dst_ip="dst_ip", local_ips=()) -> DataFrame:
    """B13."""
    return df.filter(~safe_flow(src_ip, dst_ip, local_ips))


def drop_nonroutable(df: DataFrame, src_ip="src_ip", dst_ip="dst_ip") -> DataFrame:
    """Intake filter, prefixes only."""
    return df.filter(~(is_nonroutable(F.col(src_ip)) | is_nonroutable(F.col(dst_ip))))


def src_rate(df: DataFrame, secs: float = dims.WINDOW_SECONDS, src="src_ip", us="us",
             order_col="id", bucket_secs: float | None = None) -> DataFrame:
    """Flows per source in (t - secs, t]."""
    return sliding_counts(df, [src], us, secs, count_col="src_rate", order_col=order_col,
                          bucket_secs=bucket_secs)


def src_fanout(df: DataFrame, secs: float = dims.WINDOW_SECONDS, src="src_ip", dst="dst_ip",
               us="us", order_col="id", bucket_secs: float | None = None) -> DataFrame:
    """Distinct destination addresses per source in (t - secs, t]."""
    return sliding_counts(df, [src], us, secs, distinct={"src_fanout": dst},
                          order_col=order_col, bucket_secs=bucket_secs)


def auth_rate(df: DataFrame, secs: float = dims.WINDOW_SECONDS, dst="dst_ip", port="dst_port",
              us="us", order_col="id", bucket_secs: float | None = None, where=None, bursts=True,
              rows: int | None = None) -> DataFrame:
    """Attempts per (destination, auth port) in (t - secs, t]; NULL for other ports."""
    is_auth = F.col(port).isin(*dims.AUTH_PORTS)
    cond = is_auth if where is None else (is_auth & where)
    return sliding_counts(df, [dst, port], us, secs, count_col="auth_count", order_col=order_col,
                          bucket_secs=bucket_secs, where=cond, bursts=bursts, rows=rows)


def behavioral_verdict(df: DataFrame, secs: float = dims.WINDOW_SECONDS,
                       flood: int = dims.FLOOD_THRESHOLD, scan: int = dims.SCAN_THRESHOLD,
                       brute: int = dims.BRUTE_THRESHOLD, src_ip="src_ip", dst_ip="dst_ip",
                       port="dst_port", us="us", order_col="id", local_ips=(),
                       bucket_secs: float | None = None, burst_rows: int = BURST_ROWS) -> DataFrame:
    """Adds src_rate, src_fanout, auth_count, behavioral_attack,
    behavioral_confidence, behavioral_reason.  Input rows are kept whole;
    safe flows get NULL counts and no verdict.  Without bursts two hash exchanges in
    total: (source, bucket) and (destination, port, bucket)."""
    live = ~safe_flow(src_ip, dst_ip, local_ips)
    # bursts are looked for in the input rows, both key sets in one job
    found = {"src": None, "dst": None} if bucket_secs else burst_keys(
        df, {"src": [src_ip], "dst": [dst_ip, port]}, us, secs, burst_rows)
    rows = df.count()
    x = sliding_counts(df, [src_ip], us, secs, count_col="src_rate",
                       distinct={"src_fanout": dst_ip}, order_col=order_col,
                       bucket_secs=bucket_secs, where=live, bursts=found["src"], burst_rows=burst_rows, rows=rows)
    x = auth_rate(x, secs, dst_ip, port, us, order_col, bucket_secs, where=live, bursts=found["dst"], rows=rows)
    return rules(x, secs, flood, scan, brute, src_ip, dst_ip, port)


def rules(x: DataFrame, secs: float = dims.WINDOW_SECONDS, flood: int = dims.FLOOD_THRESHOLD,
          scan: int = dims.SCAN_THRESHOLD, brute: int = dims.BRUTE_THRESHOLD, src_ip="src_ip", dst_ip="dst_ip",
          port="dst_port") -> DataFrame:
    """The ordered rules of E11 over src_rate, src_fanout and auth_count."""
    rate, fan, auth = F.col("src_rate"), F.col("src_fanout"), F.col("auth_count")
    secs_txt = str(int(secs)) if float(secs).is_integer() else str(secs)
    r1 = F.coalesce(rate >= flood, F.lit(False))
    r2 = F.coalesce(fan >= scan, F.lit(False))
    r3 = F.coalesce(auth >= brute, F.lit(False))
    attack = F.when(r1, "HTTP_Flood").when(r2, "Port_Scan").when(r3, "Brute_Force")
    conf = (F.when(r1, F.least(rate / float(2 * flood), F.lit(1.0)))
            .when(r2, F.least(fan / float(2 * scan), F.lit(1.0)))
            .when(r3, F.least(auth / float(2 * brute), F.lit(1.0)))
            .otherwise(F.lit(0.0)))
    reason = (F.when(r1, F.concat(F.lit("DDoS: "), rate.cast("string"), F.lit(" outbound flows from "),
                                  F.col(src_ip), F.lit(f" in {secs_txt}s")))
              .when(r2, F.concat(F.lit("Scan: "), fan.cast("string"),
                                 F.lit(" distinct hosts contacted by "), F.col(src_ip)))
              .when(r3, F.concat(F.lit("Brute Force: "), auth.cast("string"), F.lit(" auth attempts to "),
                                 F.col(dst_ip), F.lit(":"), F.col(port).cast("string")))
              .otherwise(F.lit("")))
    return x.select("*", attack.alias("behavioral_attack"), conf.alias("behavioral_confidence"),
                    reason.alias("behavioral_reason"))


def behavioral_override(df: DataFrame) -> DataFrame:
    """When the model says Normal and a rule fired, take the rule's label
    and confidence, risk = max(risk, 75 + 25 * conf), label Critical if >= 81
    else High."""
    fire = F.col("behavioral_attack").isNotNull() & (F.col("predicted_attack") == "Normal")
    new_risk = F.greatest(F.col("risk_score"), F.lit(75.0) + F.col("behavioral_confidence") * 25.0)
    return df.select(
        *[c for c in df.columns if c not in ("predicted_attack", "confidence", "risk_score", "risk_label")],
        F.when(fire, F.col("behavioral_attack")).otherwise(F.col("predicted_attack")).alias("predicted_attack"),
        F.when(fire, F.col("behavioral_confidence")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(fire, new_risk).otherwise(F.col("risk_score")).alias("risk_score"),
        F.when(fire, F.when(new_risk >= 81, "Critical").otherwise("High"))
         .otherwise(F.col("risk_label")).alias("risk_label"),
        fire.alias("behavior_override"),
    )


def merge_verdicts(flows: DataFrame, verdicts: DataFrame, key: str = "id") -> DataFrame:
    """Join separately computed verdict columns onto flows by flow id, then H20."""
    v = verdicts.select(key, "behavioral_attack", "behavioral_confidence", "behavioral_reason")
    return behavioral_override(flows.join(v, key, "left")
                               .fillna({"behavioral_confidence": 0.0, "behavioral_reason": ""}))

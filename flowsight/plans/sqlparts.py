"""Shared DuckDB SQL fragments for the oracle queries (mirror the Spark views)."""
from __future__ import annotations

from flowsight import dims


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)
                     for v in values)


def case_map(expr: str, mapping: dict, default: str) -> str:
    arms = " ".join(f"WHEN {expr} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {arms} ELSE '{default}' END"


def risk_category_sql(x: str) -> str:
    return (f"CASE WHEN {x} <= 30 THEN 'Low' WHEN {x} <= 60 THEN 'Medium' "
            f"WHEN {x} <= 80 THEN 'High' ELSE 'Critical' END")


def urgency_sql(x: str) -> str:
    arms = []
    for bound, text in dims.URGENCY_TEXT:
        arms.append(f"WHEN {x} >= {bound} THEN '{text}'" if bound is not None else f"ELSE '{text}'")
    return "CASE " + " ".join(arms) + " END"


def safe_ip_sql(c: str) -> str:
    pre = " OR ".join(f"starts_with({c}, '{p}')" for p in dims.SAFE_IP_PREFIXES)
    return f"({c} IN ({sql_list(dims.SAFE_IPS)}) OR {pre})"


_DST = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_LABEL = case_map("event_type", dims.EVENT_LABEL_MAP, "Normal")
_PORTS = "[" + ", ".join(str(p) for p in dims.EVENT_PORTS) + "]"

FLOWS = f"""flows AS (
  SELECT event_id AS id, ts, epoch_us(ts) AS us, user_id AS src, {_DST} AS dst,
         CAST(user_id AS VARCHAR) || '.1.1.1' AS src_ip,
         CAST({_DST} AS VARCHAR) || '.0.0.1' AS dst_ip,
         CAST({_PORTS}[event_id % {len(dims.EVENT_PORTS)} + 1] AS INTEGER) AS dst_port,
         CAST(49152 + user_id AS INTEGER) AS src_port,
         'TCP' AS protocol, event_type AS raw_label, {_LABEL} AS label, value,
         least(value, 100.0) AS risk_score,
         {risk_category_sql('least(value, 100.0)')} AS risk_label,
         least(value, 100.0) / 100.0 AS confidence,
         {_LABEL} AS predicted_attack
  FROM events)"""


def with_flows(*ctes: str) -> str:
    """`WITH flows AS (...), <ctes>` prefix."""
    return "WITH " + ",\n".join([FLOWS, *ctes]) + "\n"


def verdict_cte(secs: int, flood: int, scan: int, brute: int, name: str = "verdict") -> str:
    w = secs * 1_000_000
    frame = f"ORDER BY us RANGE BETWEEN {w - 1} PRECEDING AND CURRENT ROW"
    auth = sql_list(dims.AUTH_PORTS)
    safe = f"({safe_ip_sql('src_ip')} OR {safe_ip_sql('dst_ip')})"
    return f"""{name}_w AS (
  SELECT *,
    count(*) OVER (PARTITION BY src_ip {frame}) AS src_rate,
    count(DISTINCT dst_ip) OVER (PARTITION BY src_ip {frame}) AS src_fanout,
    CASE WHEN dst_port IN ({auth})
         THEN count(*) OVER (PARTITION BY dst_ip, dst_port {frame}) END AS auth_count
  FROM flows WHERE NOT {safe}),
{name} AS (
  SELECT *,
    CASE WHEN src_rate >= {flood} THEN 'HTTP_Flood' WHEN src_fanout >= {scan} THEN 'Port_Scan'
         WHEN auth_count >= {brute} THEN 'Brute_Force' END AS behavioral_attack,
    CASE WHEN src_rate >= {flood} THEN least(src_rate / {2 * flood}.0, 1.0)
         WHEN src_fanout >= {scan} THEN least(src_fanout / {2 * scan}.0, 1.0)
         WHEN auth_count >= {brute} THEN least(auth_count / {2 * brute}.0, 1.0)
         ELSE 0.0 END AS behavioral_confidence,
    CASE WHEN src_rate >= {flood} THEN 'DDoS: ' || src_rate || ' outbound flows from ' || src_ip || ' in {secs}s'
         WHEN src_fanout >= {scan} THEN 'Scan: ' || src_fanout || ' distinct hosts contacted by ' || src_ip
         WHEN auth_count >= {brute} THEN 'Brute Force: ' || auth_count || ' auth attempts to ' || dst_ip || ':' || dst_port
         ELSE '' END AS behavioral_reason
  FROM {name}_w
  UNION ALL
  SELECT *, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT),
         CAST(NULL AS VARCHAR), 0.0, ''
  FROM flows WHERE {safe})"""


DIRTY = """dirty AS (
  SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity AS qty, l_extendedprice AS price,
         l_discount AS discount,
         CASE WHEN l_linenumber = 7 THEN 'Infinity'::DOUBLE WHEN l_linenumber = 6 THEN '-Infinity'::DOUBLE
              WHEN l_linenumber = 5 THEN 'NaN'::DOUBLE WHEN l_linenumber = 4 AND l_returnflag = 'R' THEN NULL
              ELSE l_extendedprice / l_quantity END AS rate,
         'NaN'::DOUBLE AS all_nan,
         CASE WHEN l_tax < 0.04 THEN NULL ELSE l_tax END AS sparse_a,
         CASE WHEN l_tax <= 0.04 THEN NULL ELSE l_tax END AS sparse_b,
         1.0::DOUBLE AS const,
         CASE WHEN l_linenumber IN (2, 3) THEN NULL ELSE l_returnflag END AS flag,
         l_linestatus AS status
  FROM lineitem)"""


def with_dirty(*ctes: str) -> str:
    return "WITH " + ",\n".join([DIRTY, *ctes]) + "\n"


FEATS = """feats AS (
  SELECT l_orderkey * 8 + l_linenumber AS id,
         CASE WHEN l_linenumber = 1 THEN 0.0 ELSE l_quantity * 1000.0 END AS Flow_Duration,
         l_quantity AS Tot_Fwd_Pkts, CAST(l_linenumber AS DOUBLE) AS Tot_Bwd_Pkts,
         l_extendedprice AS TotLen_Fwd_Pkts, l_extendedprice * l_discount AS TotLen_Bwd_Pkts,
         l_extendedprice / l_quantity AS Fwd_Pkt_Len_Max, l_tax * 100.0 AS Pkt_Len_Mean,
         l_discount * 100.0 AS Pkt_Size_Avg, l_extendedprice / l_quantity * 1000.0 AS "Flow_Byts/s",
         l_quantity / l_linenumber AS "Flow_Pkts/s",
         CAST(l_linenumber % 2 AS DOUBLE) AS SYN_Flag_Cnt, CAST(l_linenumber % 3 AS DOUBLE) AS ACK_Flag_Cnt,
         CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS PSH_Flag_Cnt,
         CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS RST_Flag_Cnt,
         CASE WHEN l_returnflag = 'A' THEN 'Brute_Force' WHEN l_returnflag = 'R' THEN 'Port_Scan'
              ELSE 'Normal' END AS Label
  FROM lineitem)"""


def with_feats(*ctes: str) -> str:
    return "WITH " + ",\n".join([FEATS, *ctes]) + "\n"

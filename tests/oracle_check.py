"""Compare each registered query with its DuckDB oracle (the driver's check):
row count, column names, order-insensitive values (floats compared at 1e-6)."""
from __future__ import annotations

import math

import duckdb

from flowsight.sources.tables import TABLE_NAMES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return ("~null",)
    if isinstance(v, float):
        if math.isnan(v):
            return ("~nan",)
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(records, cols):
    return sorted((tuple(_norm(r[c]) for c in cols) for r in records), key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    s_cols = sorted(spark_df.columns)
    s_rows = [r.asDict(recursive=True) for r in spark_df.collect()]
    cur = con.execute(sql)
    d_cols = [d[0] for d in cur.description]
    if sorted(d_cols) != s_cols:
        return f"columns differ: spark={s_cols} oracle={sorted(d_cols)}"
    d_rows = [dict(zip(d_cols, r)) for r in cur.fetchall()]
    if len(d_rows) != len(s_rows):
        return f"row count spark={len(s_rows)} oracle={len(d_rows)}"
    a, b = rows_of(s_rows, s_cols), rows_of(d_rows, s_cols)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return f"values differ, e.g. {diff}"
    return None

"""Column-expression helpers (all JVM-side Catalyst expressions, no UDFs)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowsight import dims


def q(name: str) -> str:
    """Quote a column name that may hold '/', '.', spaces or backticks."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def is_missing(c: Column) -> Column:
    """NULL or NaN (pandas treats both as missing)."""
    return c.isNull() | F.isnan(c)


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (c != F.lit(float("inf"))) & (c != F.lit(float("-inf")))


def finite(c: Column, big: float = 1e6) -> Column:
    """NaN/NULL -> 0, +inf -> big, -inf -> -big."""
    return (F.when(is_missing(c), F.lit(0.0))
            .when(c == F.lit(float("inf")), F.lit(big))
            .when(c == F.lit(float("-inf")), F.lit(-big))
            .otherwise(c.cast("double")))


def any_of(conds) -> Column:
    conds = list(conds)
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def is_safe_ip(c: Column) -> Column:
    """Known-safe address (exact list or safe prefix)."""
    return c.isin(*dims.SAFE_IPS) | any_of(c.startswith(p) for p in dims.SAFE_IP_PREFIXES)


def is_nonroutable(c: Column) -> Column:
    """Intake skip prefixes only."""
    return any_of(c.startswith(p) for p in dims.SAFE_IP_PREFIXES)


def risk_category(c: Column) -> Column:
    """Upper bounds 30 / 60 / 80 (so 80.5 is Critical)."""
    return (F.when(c <= 30, "Low").when(c <= 60, "Medium")
            .when(c <= 80, "High").otherwise("Critical"))


def urgency(c: Column) -> Column:
    """Lower bounds 81 / 61 / 31 (so 80.5 is HIGH)."""
    expr = None
    for bound, text in dims.URGENCY_TEXT:
        if bound is None:
            expr = expr.otherwise(text)
        elif expr is None:
            expr = F.when(c >= bound, text)
        else:
            expr = expr.when(c >= bound, text)
    return expr


def anomaly01(score: Column) -> Column:
    """Isolation-forest score_samples value -> [0, 1]."""
    return F.least(F.greatest((-score - F.lit(0.3)) / F.lit(0.7), F.lit(0.0)), F.lit(1.0))


DEFAULT_TS_FORMATS = [
    "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy H:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy H:mm",
    "d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "dd-MM-yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy",
]


def parse_ts(c: Column, formats=None) -> Column:
    """H1: mixed-format, day-first timestamps; unparseable -> NULL."""
    formats = formats or DEFAULT_TS_FORMATS
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def micros(ts: Column) -> Column:
    """Microseconds since epoch for TIMESTAMP or TIMESTAMP_NTZ (UTC session)."""
    return F.unix_micros(ts.cast("timestamp"))


def r6(c: Column) -> Column:
    """Round to 6 decimals the way DuckDB does for DOUBLE (round(x * 1e6) / 1e6),
    so results compare bit-for-bit with the SQL oracle."""
    return F.round(c.cast("double") * F.lit(1e6)) / F.lit(1e6)

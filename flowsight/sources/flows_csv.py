"""Flow CSV readers (A1-A4, G1).

Header groups are found by reading only the first line of each file through
the Hadoop FileSystem API on the driver (one line per file); each group is one
`spark.read.csv` scan of text, groups are unioned by column name and typed once.
"""
from __future__ import annotations

import re
from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsight.session import _fs, fs_list


def normalize_name(name: str) -> str:
    """A4: trim, strip quote characters, trim, whitespace runs -> '_'."""
    n = name.strip().strip("'\"").strip()
    return re.sub(r"\s+", "_", n)


def normalize_columns(df: DataFrame) -> DataFrame:
    """A4."""
    return df.toDF(*[normalize_name(c) for c in df.columns])


def read_flows_csv(spark: SparkSession, path: str, quote: str = "'", schema=None,
                   encoding: str = "UTF-8") -> DataFrame:
    """A1: single-quoted CSV with a header; numeric columns typed by inference
    unless a schema is given; column names normalised."""
    r = spark.read.option("header", True).option("quote", quote).option("encoding", encoding)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return normalize_columns(r.csv(path))


def first_line(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    fs, p = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(p), encoding))
    try:
        return reader.readLine() or ""
    finally:
        reader.close()


def union_flows(*dfs: DataFrame) -> DataFrame:
    """G1: union by column name, absent columns as NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


#: Types tried for a column of text, narrowest first.
TYPES = ("bigint", "double", "timestamp")


def typed(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Columns of text as the first of TYPES that every non-empty value casts to, one
    aggregation over all columns; others stay text."""
    cols = [c for c in df.columns if c not in keep]
    value = {c: F.when(F.trim(F.col(f"`{c}`")) != "", F.trim(F.col(f"`{c}`"))) for c in cols}
    bad = [F.count_if(value[c].isNotNull() & value[c].try_cast(t).isNull()).alias(f"{i}_{t}")
           for i, c in enumerate(cols) for t in TYPES]
    row = df.agg(*bad, *[F.count(value[c]).alias(f"{i}_n") for i, c in enumerate(cols)]).first().asDict() if cols else {}
    out = {c: next((value[c].try_cast(t) for t in TYPES if row[f"{i}_n"] and not row[f"{i}_{t}"]), F.col(f"`{c}`"))
           for i, c in enumerate(cols)}
    return df.select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_flow_dir(spark: SparkSession, path: str, encoding: str = "UTF-8", quote: str = '"',
                  suffix: str = ".csv", schema: dict[str, str] | None = None) -> DataFrame:
    """A2/A3: every CSV under `path` (UTF-8 or e.g. ISO-8859-1), tolerating files whose
    columns differ.  Files are read as text and typed once over all of them, or cast to
    `schema` (column -> type; no inference pass)."""
    files = [f for f in fs_list(spark, path) if f.endswith(suffix)]
    groups: dict[str, list[str]] = defaultdict(list)
    for f in files:
        groups[first_line(spark, f, encoding)].append(f)
    parts = []
    for _, paths in sorted(groups.items()):
        r = spark.read.option("header", True).option("quote", quote).option("encoding", encoding)
        parts.append(normalize_columns(r.csv(paths)))
    both = union_flows(*parts)
    if schema is None:
        return typed(both)
    return both.select(*[F.col(f"`{c}`").try_cast(schema[c]).alias(c) if c in schema else F.col(f"`{c}`")
                         for c in both.columns])

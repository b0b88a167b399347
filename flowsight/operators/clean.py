"""Cleaning chain and label handling.

Column statistics are computed in one aggregation job per step; only a bounded
row of per-column scalars reaches the driver, and it comes back as literals in
a projection (no join, no per-column scan loop).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsight import dims
from flowsight.functions.columns import col, is_finite, is_missing, q
from flowsight.operators.stats import exact_quantiles

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, _NUMERIC) and f.name not in exclude]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def _float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """B1: exact duplicates over all columns (NaN equals NaN, NULL equals NULL)."""
    return df.dropDuplicates()


def replace_infinities(df: DataFrame, cols=None) -> DataFrame:
    """B2: +inf -> column max finite, -inf -> min finite, 0 if none is finite."""
    cols = cols or _float_columns(df)
    if not cols:
        return df
    aggs = []
    for i, c in enumerate(cols):
        fin = F.when(is_finite(col(c)), col(c))
        aggs += [F.max(fin).alias(f"mx{i}"), F.min(fin).alias(f"mn{i}")]
    row = df.agg(*aggs).first()
    out = []
    for f in df.columns:
        if f in cols:
            i = cols.index(f)
            mx = row[f"mx{i}"] if row[f"mx{i}"] is not None else 0.0
            mn = row[f"mn{i}"] if row[f"mn{i}"] is not None else 0.0
            out.append(F.when(col(f) == float("inf"), F.lit(mx))
                       .when(col(f) == float("-inf"), F.lit(mn)).otherwise(col(f)).alias(f))
        else:
            out.append(col(f))
    return df.select(*out)


def missing_ratios(df: DataFrame, cols=None) -> dict[str, float]:
    cols = cols or df.columns
    numeric = set(_float_columns(df))
    aggs = [F.avg((is_missing(col(c)) if c in numeric else col(c).isNull()).cast("double")).alias(f"m{i}")
            for i, c in enumerate(cols)]
    row = df.agg(*aggs).first()
    return {c: (row[f"m{i}"] or 0.0) for i, c in enumerate(cols)}


def drop_sparse_columns(df: DataFrame, max_ratio: float = 0.5) -> DataFrame:
    """Drop columns whose missing share is strictly above max_ratio."""
    ratios = missing_ratios(df)
    return df.drop(*[c for c, r in ratios.items() if r > max_ratio])


def impute_median(df: DataFrame, cols=None, exclude=("Label", "label")) -> DataFrame:
    """Fill NULL/NaN of numeric columns with the exact median of the rest."""
    cols = cols or numeric_columns(df, exclude)
    ratios = missing_ratios(df, cols)
    need = [c for c in cols if ratios[c] > 0]
    fills = exact_quantiles(df, need, 0.5) if need else {}
    return df.select(*[F.when(is_missing(col(c)), F.lit(fills[c]).cast(df.schema[c].dataType))
                       .otherwise(col(c)).alias(c) if c in fills and fills[c] is not None else col(c)
                       for c in df.columns])


def column_mode(df: DataFrame, c: str):
    """Most frequent non-NULL value, smallest on ties: a distributed group count
    followed by a top-1 (never gathers the values of a column in one task)."""
    top = (df.filter(col(c).isNotNull()).groupBy(col(c).alias("v"))
             .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("v")).limit(1).collect())
    return top[0]["v"] if top else None


def impute_mode(df: DataFrame, cols=None, exclude=("Label", "label"), default: str = "unknown") -> DataFrame:
    """Fill NULL strings with the column mode (smallest on ties), else 'unknown'."""
    cols = cols or string_columns(df, exclude)
    nulls = df.agg(*[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]).first() if cols else {}
    fills = {}
    for i, c in enumerate(cols):
        if nulls[f"n{i}"] > 0:
            m = column_mode(df, c)
            fills[c] = m if m is not None else default
    return df.fillna(fills) if fills else df


def drop_identity_columns(df: DataFrame, cols=dims.IDENTITY_COLUMNS) -> DataFrame:
    """B6."""
    return df.drop(*[c for c in cols if c in df.columns])


def constant_columns(df: DataFrame, exclude=("Label", "label")) -> list[str]:
    """Numeric columns with at most one distinct non-missing value (min = max test)."""
    cols = numeric_columns(df, exclude)
    if not cols:
        return []
    aggs = []
    for i, c in enumerate(cols):
        v = F.when(~is_missing(col(c)), col(c)) if c in _float_columns(df) else col(c)
        aggs += [F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}")]
    row = df.agg(*aggs).first()
    return [c for i, c in enumerate(cols) if row[f"a{i}"] is None or row[f"a{i}"] == row[f"b{i}"]]


def drop_constant_columns(df: DataFrame, exclude=("Label", "label")) -> DataFrame:
    """B7."""
    return df.drop(*constant_columns(df, exclude))


def missing_report(df: DataFrame) -> DataFrame:
    """Missing (NULL, and NaN for floats) count per column, one pass."""
    numeric = set(_float_columns(df))
    aggs = [F.count_if(is_missing(col(c)) if c in numeric else col(c).isNull()).alias(f"m{i}")
            for i, c in enumerate(df.columns)]
    agg = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("n_missing"))
            for i, c in enumerate(df.columns)]
    return agg.select(F.inline(F.array(*rows)))


def clean(df: DataFrame, drop_cols=dims.IDENTITY_COLUMNS, max_missing: float = 0.5, stage=None) -> DataFrame:
    """B1 -> B2 -> B3/B4/B5 -> B6 -> B7.  `stage` (a function from DataFrame to
    DataFrame: persist, checkpoint, write and read back) is applied once to the
    deduplicated table, which the statistics jobs that follow read; without it they
    repeat the dedup shuffle."""
    x = drop_duplicate_rows(df)
    x = stage(x) if stage else x
    x = replace_infinities(x)
    x = drop_sparse_columns(x, max_missing)
    x = impute_median(x)
    x = impute_mode(x)
    x = drop_identity_columns(x, drop_cols)
    return drop_constant_columns(x)


def feature_columns(df: DataFrame, label: str = "Label", meta=()) -> list[str]:
    """Numeric columns that are not label or meta columns."""
    return numeric_columns(df, (label, *meta))


def fill_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """NULL and NaN -> 0 in the feature columns."""
    return df.fillna(0, subset=cols)


def align_features(df: DataFrame, cols: list[str], keep=()) -> DataFrame:
    """Trained column order, absent columns as 0.0, missing values 0."""
    present = set(df.columns)
    out = [F.coalesce(F.nanvl(col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) if c in present
           else F.lit(0.0).alias(c) for c in cols]
    return df.select(*[col(k) for k in keep], *out)


def canonicalize_labels(df: DataFrame, dim: DataFrame, raw: str = "Label",
                        default: str = "Normal") -> DataFrame:
    """Label map as a left join; unmatched -> default.
    `dim` is a mapping table (raw, label); Spark broadcasts it by its size."""
    d = dim.select(F.col("raw").alias("_raw"), F.col("label").alias("_canon"))
    x = df.join(d, F.col(q(raw)) == F.col("_raw"), "left")
    out = [c for c in df.columns if c != "label"]
    return x.select(*[col(c) for c in out], F.coalesce(F.col("_canon"), F.lit(default)).alias("label"))


def unmapped_labels(df: DataFrame, dim: DataFrame, raw: str = "Label") -> DataFrame:
    """Raw labels absent from the map, with counts (left anti join)."""
    d = dim.select(F.col("raw").alias(raw))
    return (df.select(raw).join(d, raw, "left_anti")
              .groupBy(raw).agg(F.count(F.lit(1)).alias("n")))


def recode_unknown(df: DataFrame, classes, label: str = "label", default: str = "Normal") -> DataFrame:
    """Labels outside the trained class set become `default`."""
    return df.withColumn(label, F.when(col(label).isin(*classes), col(label)).otherwise(F.lit(default)))


def standardize_label(df: DataFrame) -> DataFrame:
    """A5: find the label column case-insensitively, rename to Label, trim values."""
    hit = next((c for c in df.columns if c.strip().lower() == "label"), None)
    if hit is None:
        return df
    return df.withColumnRenamed(hit, "Label").withColumn("Label", F.trim(F.col("Label")))


def missing_ratio_table(df: DataFrame, max_ratio: float = 0.5) -> DataFrame:
    """B3 as a table: (column, missing_ratio, dropped) from one aggregation."""
    numeric = set(_float_columns(df))
    aggs = [F.avg((is_missing(col(c)) if c in numeric else col(c).isNull()).cast("double")).alias(f"m{i}")
            for i, c in enumerate(df.columns)]
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_ratio"))
            for i, c in enumerate(df.columns)]
    t = df.agg(*aggs).select(F.inline(F.array(*rows)))
    return t.withColumn("dropped", F.col("missing_ratio") > max_ratio)


def constant_column_table(df: DataFrame, exclude=("Label", "label")) -> DataFrame:
    """B7 as a table: (column, n_values_le_1) for numeric columns, one aggregation."""
    cols = numeric_columns(df, exclude)
    floats = set(_float_columns(df))
    aggs = []
    for i, c in enumerate(cols):
        v = F.when(~is_missing(col(c)), col(c)) if c in floats else col(c)
        aggs.append((F.min(v).isNull() | (F.min(v) == F.max(v))).alias(f"k{i}"))
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"k{i}").alias("is_constant")) for i, c in enumerate(cols)]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def benign_rows(df: DataFrame, label: str = "Label", benign: str = "Normal") -> DataFrame:
    """Rows labelled benign; every row when there is none."""
    b = df.filter(col(label) == benign)
    return b if b.take(1) else df

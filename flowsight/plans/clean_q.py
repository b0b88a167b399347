"""Cleaning queries over the planted `dirty` lineitem view."""
from __future__ import annotations

from pyspark.sql import functions as F

from flowsight.functions.columns import r6
from flowsight.operators import clean as C
from flowsight.plans.registry import register
from flowsight.plans.sqlparts import with_dirty, with_feats
from flowsight.sources.tables import dirty, flow_features

_FLOATS = ["qty", "price", "discount", "rate", "all_nan", "sparse_a", "sparse_b", "const"]
_ALL = ["id", *_FLOATS, "flag", "status"]


def _miss(c):
    return f"({c} IS NULL OR isnan({c}))" if c in _FLOATS else f"({c} IS NULL)"


@register("drop_duplicate_rows", with_dirty() + "SELECT DISTINCT qty, discount, status, flag FROM dirty")
def q_dedup(spark, sf):
    return C.drop_duplicate_rows(dirty(spark, sf).select("qty", "discount", "status", "flag"))


_INF = """stats AS (SELECT max(rate) FILTER (WHERE isfinite(rate)) AS mx,
  min(rate) FILTER (WHERE isfinite(rate)) AS mn FROM dirty)"""


@register("replace_infinities", with_dirty(_INF) + """SELECT id, round(CASE
  WHEN rate = 'Infinity'::DOUBLE THEN coalesce(mx, 0.0) WHEN rate = '-Infinity'::DOUBLE THEN coalesce(mn, 0.0)
  ELSE rate END, 6) AS rate FROM dirty, stats""")
def q_replace_inf(spark, sf):
    x = C.replace_infinities(dirty(spark, sf).select("id", "rate"), ["rate"])
    return x.select("id", r6(F.col("rate")).alias("rate"))


_RATIO_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {_miss(c)} THEN 1.0 ELSE 0.0 END), 6) AS missing_ratio, "
    f"avg(CASE WHEN {_miss(c)} THEN 1.0 ELSE 0.0 END) > 0.5 AS dropped FROM dirty" for c in _ALL[1:])


@register("drop_sparse_columns", with_dirty() + _RATIO_SQL)
def q_sparse(spark, sf):
    t = C.missing_ratio_table(dirty(spark, sf).drop("id"))
    return t.select("column", r6(F.col("missing_ratio")).alias("missing_ratio"), "dropped")


_MED = """med AS (SELECT median(rate) FILTER (WHERE NOT isnan(rate)) AS m_rate,
  median(sparse_a) FILTER (WHERE NOT isnan(sparse_a)) AS m_sa FROM dirty)"""


@register("impute_median", with_dirty(_MED) + """SELECT id,
  round(CASE WHEN rate IS NULL OR isnan(rate) THEN m_rate ELSE rate END, 6) AS rate,
  round(CASE WHEN sparse_a IS NULL OR isnan(sparse_a) THEN m_sa ELSE sparse_a END, 6) AS sparse_a,
  round(discount, 6) AS discount FROM dirty, med""")
def q_impute_median(spark, sf):
    x = C.impute_median(dirty(spark, sf).select("id", "rate", "sparse_a", "discount"),
                        ["rate", "sparse_a", "discount"])
    return x.select("id", *[r6(F.col(c)).alias(c) for c in ("rate", "sparse_a", "discount")])


_MODE = """md AS (SELECT flag AS m FROM dirty WHERE flag IS NOT NULL GROUP BY flag
  ORDER BY count(*) DESC, flag LIMIT 1)"""


@register("impute_mode", with_dirty(_MODE) + "SELECT id, coalesce(flag, (SELECT m FROM md), 'unknown') AS flag, status FROM dirty")
def q_impute_mode(spark, sf):
    return C.impute_mode(dirty(spark, sf).select("id", "flag", "status"))


_MISS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {_miss(c)}) AS n_missing FROM dirty" for c in _ALL)


@register("missing_report", with_dirty() + _MISS_SQL)
def q_missing_report(spark, sf):
    return C.missing_report(dirty(spark, sf))


_CONST_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", (min({c}) FILTER (WHERE NOT isnan({c})) IS NULL OR "
    f"min({c}) FILTER (WHERE NOT isnan({c})) = max({c}) FILTER (WHERE NOT isnan({c}))) AS is_constant FROM dirty"
    for c in _FLOATS)


@register("drop_constant_columns", with_dirty() + _CONST_SQL)
def q_constant(spark, sf):
    return C.constant_column_table(dirty(spark, sf).drop("id"))


_CHAIN = """inf AS (SELECT max(rate) FILTER (WHERE isfinite(rate)) AS mx,
  min(rate) FILTER (WHERE isfinite(rate)) AS mn FROM dirty),
d2 AS (SELECT id, qty, price, discount, CASE WHEN rate = 'Infinity'::DOUBLE THEN coalesce(mx, 0.0)
  WHEN rate = '-Infinity'::DOUBLE THEN coalesce(mn, 0.0) ELSE rate END AS rate, sparse_a, flag, status
  FROM (SELECT DISTINCT * FROM dirty), inf),
med AS (SELECT median(rate) FILTER (WHERE NOT isnan(rate)) AS m_rate,
  median(sparse_a) FILTER (WHERE NOT isnan(sparse_a)) AS m_sa FROM d2),
md AS (SELECT flag AS m FROM d2 WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)"""


@register("clean_chain", with_dirty(_CHAIN) + """SELECT id, round(qty, 6) AS qty, round(price, 6) AS price,
  round(discount, 6) AS discount,
  round(CASE WHEN rate IS NULL OR isnan(rate) THEN m_rate ELSE rate END, 6) AS rate,
  round(CASE WHEN sparse_a IS NULL OR isnan(sparse_a) THEN m_sa ELSE sparse_a END, 6) AS sparse_a,
  coalesce(flag, (SELECT m FROM md), 'unknown') AS flag, status FROM d2, med""")
def q_clean_chain(spark, sf):
    x = C.clean(dirty(spark, sf), stage=lambda d: d.checkpoint())
    return x.select(*[r6(F.col(c)).alias(c) if c in _FLOATS else F.col(c) for c in x.columns])


@register("standardize_label", with_feats() + "SELECT id, Label FROM feats")
def q_standardize_label(spark, sf):
    """A5: an untidy label column (case, blanks) renamed and trimmed."""
    f = flow_features(spark, sf).select("id", F.concat(F.lit("  "), F.col("Label"), F.lit(" ")).alias(" lABEL "))
    return C.standardize_label(f).select("id", "Label")


_FILLED = ["qty", "rate", "sparse_a"]


@register("fill_features", with_dirty() + "SELECT id, " + ", ".join(
    f"round(CASE WHEN {c} IS NULL OR isnan({c}) THEN 0.0 ELSE {c} END, 6) AS {c}" for c in _FILLED)
    + " FROM dirty WHERE isfinite(coalesce(CASE WHEN isnan(rate) THEN 0.0 ELSE rate END, 0.0))")
def q_fill_features(spark, sf):
    """Numeric feature columns in table order, NULL and NaN as 0."""
    d = dirty(spark, sf).where(~F.col("rate").isin(float("inf"), float("-inf")) | F.col("rate").isNull())
    cols = C.feature_columns(d, "flag", meta=("id",))
    x = C.fill_features(d, cols)
    return x.select("id", *[r6(F.col(c)).alias(c) for c in cols if c in _FILLED])

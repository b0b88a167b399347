"""Exact quantiles by narrowing must equal pandas' linear quantile, also when
narrowing takes several rounds and values repeat heavily."""
import pytest
from pyspark.sql import functions as F

from cases import SF01
from flowsight.operators.stats import exact_quantiles


@pytest.mark.parametrize("p", [0.0, 0.01, 0.25, 0.5, 0.95, 0.99, 1.0])
def test_exact_quantiles_forced_rounds(spark, p):
    df = spark.read.parquet(f"{SF01}/lineitem.parquet").select(
        "l_extendedprice", "l_quantity", "l_tax",
        F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("disc"))
    pdf = df.toPandas()
    got = exact_quantiles(df, list(pdf.columns), p, max_collect=50, splits=4)
    for c in pdf.columns:
        assert abs(got[c] - pdf[c].quantile(p)) < 1e-9, (c, got[c], pdf[c].quantile(p))


@pytest.mark.parametrize("p", [0.0, 0.5, 0.9, 1.0])
def test_exact_quantiles_with_infinities_and_ties(spark, p):
    df = spark.read.parquet(f"{SF01}/lineitem.parquet").select(
        F.when(F.col("l_linenumber") == 7, F.lit(float("inf")))
         .when(F.col("l_linenumber") == 6, F.lit(float("-inf")))
         .otherwise(F.col("l_extendedprice") / F.col("l_quantity")).alias("rate"),
        F.when(F.col("l_linenumber") <= 4, F.lit(1.0)).otherwise(F.col("l_tax")).alias("ties"))
    pdf = df.toPandas()
    got = exact_quantiles(df, ["rate", "ties"], p, max_collect=50, splits=4)
    for c in ("rate", "ties"):
        want = pdf[c].quantile(p)
        if want != want:  # pandas interpolates 0 * inf -> NaN at the ends; no exact value to compare
            continue
        assert got[c] == want or abs(got[c] - want) < 1e-9, (c, got[c], want)

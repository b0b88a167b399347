"""End-to-end preparation of a flow table (J2): clean, encode, split, scale, balance,
save and load."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsight.operators import clean as C
from flowsight.operators import features as X
from flowsight.operators.ml import balance
from flowsight.operators.risk import stratified_split
from flowsight.session import join_path
from flowsight.sources import store as S


@dataclass
class Prepared:
    """Splits (train balanced), feature order, label index and scaler statistics."""
    splits: DataFrame
    features: list[str]
    labels: DataFrame
    scaler: dict[str, tuple[float, float]]


def prepare(df: DataFrame, label: str = "Label", key: str = "id", method: str = "none", stage=None,
            statistical: bool = False) -> Prepared:
    """A5 -> (H7) -> B8 -> B9 -> H10 -> J1 -> H8 fitted on train -> J5 on train.  `stage`
    materialises a frame that later jobs read several times (see `clean.clean`)."""
    x = C.standardize_label(df)
    x = X.statistical_features(x) if statistical else x
    x = C.clean(x, stage=stage)
    cols = C.feature_columns(x, label, meta=(key,))
    x = C.fill_features(x, cols)
    labels = X.fit_labels(x, label)
    x = stratified_split(X.encode(x, labels, label), label, key)
    x = stage(x) if stage else x
    scaler = X.fit_standard(x.filter(F.col("split") == "train"), cols)
    x = X.apply_standard(x, scaler)
    if method != "none":
        train = balance(x.filter(F.col("split") == "train"), method, label, key)
        x = train.unionByName(x.filter(F.col("split") != "train"), allowMissingColumns=True)
    return Prepared(x, cols, labels, scaler)


def save(p: Prepared, path: str) -> None:
    """Splits, scaler, label index and feature order."""
    spark = p.splits.sparkSession
    S.save_prepared(p.splits, path)
    S.save_table(spark.createDataFrame([(c, float(m), float(s)) for c, (m, s) in p.scaler.items()],
                                       "feature string, mean double, std double"), join_path(path, "scaler"))
    S.save_table(p.labels, join_path(path, "labels"))
    S.save_table(spark.createDataFrame(list(enumerate(p.features)), "position int, feature string"),
                 join_path(path, "features"))


def load(spark: SparkSession, path: str) -> Prepared:
    scaler = {r.feature: (r.mean, r.std) for r in spark.read.parquet(join_path(path, "scaler")).collect()}
    order = spark.read.parquet(join_path(path, "features")).orderBy("position").collect()
    return Prepared(S.load_prepared(spark, path), [r.feature for r in order],
                    spark.read.parquet(join_path(path, "labels")), scaler)

"""Persisted splits: long table plus a one-row header, validated on load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagspark.operators.splits import SplitError, fingerprint

SPLITS_SCHEMA = "patient_id string, label int, is_test boolean, fold int"
HEADER_SCHEMA = "fingerprint string, seed bigint, test_frac double, n_folds int, n_classes int"


def write_splits(splits: DataFrame, path: str, seed: int, test_frac: float, n_folds: int, n_classes: int) -> None:
    splits.select("patient_id", "label", "is_test", "fold").write.mode("overwrite").parquet(f"{path}/members")
    stored = splits.sparkSession.read.schema(SPLITS_SCHEMA).parquet(f"{path}/members")
    header = fingerprint(stored).select(
        "fingerprint",
        F.lit(seed).cast("bigint").alias("seed"),
        F.lit(float(test_frac)).alias("test_frac"),
        F.lit(n_folds).cast("int").alias("n_folds"),
        F.lit(n_classes).cast("int").alias("n_classes"),
    )
    header.coalesce(1).write.mode("overwrite").json(f"{path}/header")


def load_splits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(splits, header); raises when the test ids changed or a test patient sits in a fold."""
    splits = spark.read.schema(SPLITS_SCHEMA).parquet(f"{path}/members")
    header = spark.read.schema(HEADER_SCHEMA).json(f"{path}/header")
    expected = header.first()["fingerprint"]
    actual = fingerprint(splits).first()["fingerprint"]
    if actual != expected:
        raise SplitError(f"test-set fingerprint is {actual}, the header says {expected}: the split was edited")
    per = splits.groupBy("patient_id").agg(
        F.max("is_test").alias("test"), F.max(F.col("fold").isNotNull()).alias("dev")
    )
    leaked = per.where("test AND dev").select("patient_id")
    sample = [r[0] for r in leaked.orderBy("patient_id").limit(5).collect()]
    if sample:
        raise SplitError(f"{leaked.count()} test patients are also in folds, e.g. {sample}")
    return splits, header

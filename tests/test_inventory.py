"""Written statistics of a feature store."""

import glob
import os

from pyspark.sql import functions as F

from bagspark.sources import store as S


def rows(spark, lo, hi, width=3, encoder="e"):
    return spark.range(lo, hi).select(
        (F.col("id") % 5).alias("slide_id"), F.col("id").alias("patch_idx"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(encoder).alias("encoder"),
        F.lit("cls").alias("pooling"), F.array_repeat(F.lit(1.0).cast("float"), width).alias("features"),
    )


def found(spark, path):
    return sorted(tuple(r) for r in S.store_inventory(spark, path).collect())


def test_inventory_follows_appends_foreign_files_and_removals(spark, folder):
    path = f"{folder}/store"
    S.write_features(rows(spark, 0, 50), path)
    assert found(spark, path) == [(s, 10, 3, "e", "cls") for s in range(5)]
    S.write_features(rows(spark, 50, 60, encoder="f", width=4), path)
    rows(spark, 60, 65).drop("encoder", "pooling").write.mode("append").parquet(f"{path}/encoder=e/pooling=cls")
    assert found(spark, path) == sorted([(s, 11, 3, "e", "cls") for s in range(5)] + [(s, 2, 4, "f", "cls") for s in range(5)])
    for f in glob.glob(f"{path}/encoder=f/pooling=cls/*"):
        os.remove(f)
    rows(spark, 0, 0).write.mode("overwrite").parquet(f"{folder}/none")
    assert found(spark, path) == [(s, 11, 3, "e", "cls") for s in range(5)]


def test_no_vector_is_read(spark, folder):
    path = f"{folder}/store"
    S.write_features(rows(spark, 0, 50), path)
    plan = S.store_inventory(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "features" not in plan and "n_patches" in plan
    assert spark.read.parquet(path).count() == 50

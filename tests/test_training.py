"""Cross-validated training on separable bags."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagspark.operators.cohort import CohortError
from bagspark.operators.metrics import grading_metrics
from bagspark.operators.splits import make_splits
from bagspark.plans import train as T
from bagspark.session import materialise

FAST = T.FitOptions(max_iter=10)


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(0)
    rows = []
    for s in range(60):
        y = s % 3
        for i in range(6):
            v = rng.normal(0, 0.3, 4)
            v[0] += y
            rows.append((s, i, [float(a) for a in v]))
    patches = materialise(spark.createDataFrame(rows, "slide_id bigint, patch_idx bigint, features array<float>"))
    labels = spark.range(60).select(F.col("id").alias("patient_id"), (F.col("id") % 3).cast("int").alias("label"))
    return patches, materialise(make_splits(labels, n_folds=3))


def test_mean_pooling_separates_and_covers_dev_once(cohort):
    patches, splits = cohort
    preds = materialise(T.train_cv(patches, splits, options=FAST))
    assert preds.count() == preds.select("slide_id").distinct().count() == splits.where("NOT is_test").count()
    assert preds.join(splits.where("is_test").withColumnRenamed("patient_id", "slide_id"), "slide_id").count() == 0
    assert grading_metrics(preds).first()["qwk"] > 0.8
    assert {r["metric"] for r in T.cv_summary(preds).collect()} >= {"qwk", "macro_f1"}


def test_missing_dev_features_are_an_error(cohort):
    patches, splits = cohort
    with pytest.raises(CohortError, match="without features"):
        T.train_cv(patches.where("slide_id > 30"), splits, options=FAST)


def test_comparison_tuning_and_instances(cohort):
    patches, splits = cohort
    arms = {r["arm"]: r for r in T.pooling_comparison(patches, splits, ["mean", "mean+max"], options=FAST).collect()}
    assert arms["mean"]["mean_delta"] is None and arms["mean+max"]["n"] == 3
    grid = [{"pooling": "mean", "reg_param": r} for r in (0.01, 50.0)]
    trials = T.tune(patches, splits, grid, n_trials=2, options=FAST).collect()
    assert len(trials) == 6 and {r["trial"] for r in trials if r["best"]} == {0}
    top = T.instance_pool(patches, splits, 0.5, "top", options=FAST)
    assert grading_metrics(top).first()["qwk"] > 0.7
    with pytest.raises(ValueError):
        T.instance_pool(patches, splits, mode="other")


def test_a_losing_trial_stops_and_survivors_keep_their_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(s, i, [float(v) for v in rng.normal(0, 0.3, 4) + [s % 3, 0, 0, 0]]) for s in range(75) for i in range(2)]
    patches = materialise(spark.createDataFrame(rows, "slide_id bigint, patch_idx bigint, features array<float>"))
    labels = spark.range(75).select(F.col("id").alias("patient_id"), (F.col("id") % 3).cast("int").alias("label"))
    splits = materialise(make_splits(labels, n_folds=5))
    grid = [{"pooling": "mean", "reg_param": 0.01 * (k + 1)} for k in range(2)] + [{"pooling": "std", "reg_param": 500.0}]
    trials = T.tune(patches, splits, grid, options=FAST, n_startup_trials=2, n_warmup_steps=1).collect()
    by = {k: [r for r in trials if r["trial"] == k] for k in range(3)}
    assert len(by[2]) == 2 and {(r["pruned_at"], r["folds_run"], r["best"]) for r in by[2]} == {(1, 2, False)}
    assert all(len(by[k]) == 5 and by[k][0]["pruned_at"] is None for k in range(2))
    alone = T.tune(patches, splits, grid[:1], options=FAST).collect()
    assert sorted((r["fold"], r["score"]) for r in alone) == sorted((r["fold"], r["score"]) for r in by[0])
    assert sum(r["best"] for r in trials) == 5


def test_mixed_cohorts_are_refused_before_vectors_are_read(spark, cohort):
    patches, splits = cohort
    sound = spark.range(60).selectExpr("id AS slide_id", "6L AS n_patches", "4 AS width", "'e' AS encoder")
    mixed = sound.withColumn("width", F.when(F.col("slide_id") == 7, 8).otherwise(4))
    boom = patches.withColumn("features", F.raise_error(F.lit("read")).cast("array<float>"))
    for run in (T.train_cv, lambda p, s, **k: T.tune(p, s, [{"pooling": "mean", "reg_param": 0.1}], **k)):
        with pytest.raises(CohortError, match="widths"):
            run(boom, make_splits_all_dev(splits), inventory=mixed)
    assert T.train_cv(patches, splits, options=FAST, inventory=sound).count() > 0


def make_splits_all_dev(splits):
    return splits.withColumns({"is_test": F.lit(False), "fold": F.coalesce("fold", F.lit(0))})


def test_instances_of_absent_subjects_are_an_error(cohort):
    patches, splits = cohort
    with pytest.raises(CohortError, match="without features"):
        T.instance_pool(patches.where("slide_id > 30"), splits, options=FAST)


def test_instances_are_pooled_in_place(spark, cohort, monkeypatch):
    """Every pooled bag against numpy from the fitted scores, and no vector written but the sample that fits."""
    patches, splits = cohort
    written = []
    monkeypatch.setattr(T, "materialise", lambda df, name="stage": written.append((name, df.columns)) or materialise(df, name))
    top = T.instance_pool(patches, splits, 0.5, "top", options=FAST)
    soft = T.instance_pool(patches, splits, 0.5, "softmax", options=FAST, fit_rows=100)
    assert grading_metrics(top).first()["qwk"] > 0.7 and grading_metrics(soft).first()["qwk"] > 0.7
    assert top.count() == splits.where("NOT is_test").count() == soft.select("slide_id").distinct().count()
    assert {name for name, columns in written if "features" in columns} == {"fit_sample"}
    fit = T.LogisticRegression(family="multinomial", maxIter=5).fit(
        patches.select(T.array_to_vector(F.col("features").cast("array<double>")).alias("features"), (F.col("slide_id") % 3).alias("label"))
    )
    scores = {(r[0], r[1]): r[2][0] for r in T._instance_scores(patches, [fit]).collect()}
    scored = fit.transform(patches.select("slide_id", "patch_idx", T.array_to_vector(F.col("features").cast("array<double>")).alias("features")))
    for r in scored.collect():
        assert abs(scores[r["slide_id"], r["patch_idx"]] - sum(k * p for k, p in enumerate(r["probability"]))) < 1e-9

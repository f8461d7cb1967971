"""Cross-validated training over embeddings (five vectors per slide) and landed run manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from bagspark.operators.metrics import grading_metrics
from bagspark.operators.splits import make_splits
from bagspark.plans import train as T
from bagspark.queries.registry import query, rounded, tables, write_file
from bagspark.session import materialise, scratch_path
from bagspark.sources.landed import collect_runs as collect

QUICK = T.FitOptions(max_iter=15)


def cohort(spark, sf):
    patches = tables(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 5).alias("slide_id"), (F.col("vec_id") % 5).alias("patch_idx"), F.col("embedding").alias("features")
    )
    labels = patches.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("slide_id").alias("patient_id"), (F.col("slide_id") % 3).cast("int").alias("label")
    )
    return patches, materialise(make_splits(labels), "splits")


@query("train_cv")
def train_cv(spark, sf):
    preds = T.train_cv(*cohort(spark, sf), options=QUICK)
    return rounded(T.cv_summary(preds).select("metric", "mean", "std", "n_folds"), "mean", "std")


@query("instance_pool")
def instance_pool(spark, sf):
    patches, splits = cohort(spark, sf)
    preds = T.instance_pool(patches, splits, fraction=0.4, options=QUICK)
    return rounded(grading_metrics(preds, by=["fold"]), "qwk", "macro_f1").select("fold", "n", "qwk", "macro_f1")


@query("pooling_comparison")
def pooling_comparison(spark, sf):
    patches, splits = cohort(spark, sf)
    df = T.pooling_comparison(patches, splits, ["mean", "std", "top", "mean+max"], options=QUICK)
    return rounded(df, "qwk_mean", "qwk_std", "mean_delta", "corrected_se", "naive_se", "t")


@query("tune")
def tune(spark, sf):
    patches, splits = cohort(spark, sf)
    grid = [{"pooling": p, "reg_param": r} for p in ("mean", "std") for r in (0.01, 0.1)]
    return rounded(T.tune(patches, splits, grid, options=QUICK), "score", "mean_score")


@query(
    "collect_runs",
    """WITH r AS (SELECT event_type AS run, count(*) AS n, avg(value) AS v FROM events GROUP BY event_type)
       SELECT run, CASE run WHEN 'error' THEN 'failed' WHEN 'view' THEN 'incomplete' ELSE 'complete' END AS run_status,
              CASE WHEN run <> 'view' THEN n END AS n_usable, CASE WHEN run <> 'view' THEN n * 3000 END AS total_patches,
              CASE WHEN run <> 'view' THEN round(v / 500, 6) + 0.0 END AS cv_qwk_mean, CASE WHEN run <> 'view' THEN 0.07e0 END AS cv_qwk_std
       FROM r""",
)
def collect_runs(spark, sf):
    """One run directory per event type: manifests, failure markers and unfinished runs."""
    root = scratch_path(spark, "runs")
    runs = tables(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_usable"), F.avg("value").alias("value")
    )
    manifest = F.to_json(
        F.struct(
            F.lit("h-optimus-0").alias("encoder"),
            F.struct("n_usable", (F.col("n_usable") * 3000).alias("total_patches")).alias("cohort"),
            F.struct(F.struct((F.col("value") / 500).alias("mean"), F.lit(0.07).alias("std")).alias("qwk")).alias("cv"),
        )
    )
    for row in runs.select("event_type", manifest.alias("text")).collect():
        folder = f"{root}/{row['event_type']}"
        write_file(spark, f"{folder}/SPLITS.json", "{}")
        if row["event_type"] != "view":
            write_file(spark, f"{folder}/MANIFEST.json", row["text"])
        if row["event_type"] == "error":
            write_file(spark, f"{folder}/TRAINING_FAILED.txt", "diverged")
    return rounded(collect(spark, root), "cv_qwk_mean", "cv_qwk_std").select(
        "run", "run_status", "n_usable", "total_patches", "cv_qwk_mean", "cv_qwk_std"
    )

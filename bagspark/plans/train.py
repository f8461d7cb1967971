"""Cross-validated ordinal heads over pooled vectors, with Spark ML.

A grade in 0..K-1 is learnt as K-1 conditional binary logistic regressions: task j sees the
subjects with y > j-1 and predicts y > j, classes weighted to balance. Fits of different folds
and tasks are independent Spark jobs and run side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagspark.functions import ordinal
from bagspark.functions.hashing import hash_uniform
from bagspark.operators.attention import mean_pool
from bagspark.operators.cohort import CohortError, check_cohort
from bagspark.operators.history import median_prune
from bagspark.operators.metrics import aggregate_folds, corrected_resampled_t, grading_metrics
from bagspark.operators.pooling import pooling_statistics
from bagspark.plans.scoring import _matrix
from bagspark.session import materialise
from bagspark.skew import extreme_rows
from bagspark.sources.layout import Layout, beside_patches


@dataclass(frozen=True)
class FitOptions:
    reg_param: float = 0.01
    max_iter: int = 50
    parallelism: int = 4


def pooled_features(patches: DataFrame, poolings: Sequence[str]) -> DataFrame:
    """(slide_id, <pooling>...): one array column per arm such as "mean", "std" or "mean+max"."""
    atoms = sorted({a for p in poolings for a in p.split("+")})
    if atoms == ["mean"]:
        wide = mean_pool(patches).withColumnRenamed("bag", "mean")
    else:
        stats = pooling_statistics(patches)
        wide = stats.groupBy("slide_id").agg(
            F.array_sort(F.collect_list(F.struct("dim", *atoms))).alias("_s")
        ).select("slide_id", *[F.col(f"_s.{a}").alias(a) for a in atoms])
    return wide.select("slide_id", *[F.concat(*p.split("+")).alias(p) for p in poolings])


def _labelled(features: DataFrame, splits: DataFrame) -> DataFrame:
    """Dev subjects with features; raises when a dev subject has none. Test subjects never enter."""
    dev = splits.where(~F.col("is_test")).select(F.col("patient_id").alias("slide_id"), "label", "fold")
    joined = dev.join(features, "slide_id", "left")
    value = features.columns[1]
    absent = joined.where(F.col(value).isNull()).select("slide_id").limit(5).collect()
    if absent:
        raise CohortError(f"dev subjects without features, e.g. {[r[0] for r in absent]}")
    return joined


def _weighted(rows: DataFrame, target: str) -> DataFrame:
    """Adds the balanced class weight n / (2 n_class) of a binary target."""
    sizes = rows.groupBy(target).agg(F.count(F.lit(1)).alias("_n")).collect()
    total = sum(r["_n"] for r in sizes)
    weight = F.lit(1.0)
    for r in sizes:
        weight = F.when(F.col(target) == r[target], total / (2.0 * r["_n"])).otherwise(weight)
    return rows.withColumn("_w", weight)


def fit_corn(train: DataFrame, n_classes: int, options: FitOptions) -> Callable[[DataFrame], DataFrame]:
    """Fit the conditional tasks on (features vector, label); returns a scorer adding ``cumulative``."""
    fits = []
    for j in range(n_classes - 1):
        rows = train.where(F.col("label") > j - 1) if j else train
        rows = _weighted(rows.withColumn("_t", (F.col("label") > j).cast("double")), "_t")
        lr = LogisticRegression(
            featuresCol="features", labelCol="_t", weightCol="_w", maxIter=options.max_iter, regParam=options.reg_param,
            rawPredictionCol=f"_raw{j}", probabilityCol=f"_p{j}", predictionCol=f"_y{j}",
        )
        fits.append(lr.fit(rows))

    def score(df: DataFrame) -> DataFrame:
        names = df.columns
        for fit in fits:
            df = fit.transform(df)
        cum, running = [], None
        for j in range(n_classes - 1):
            p = vector_to_array(f"_p{j}")[1]
            running = p if running is None else running * p
            cum.append(running)
        return df.select(*names, F.array(*cum).alias("cumulative"))

    return score


def _folds(splits: DataFrame) -> list[int]:
    rows = splits.where("fold IS NOT NULL").agg(F.max("fold").alias("m")).first()
    return list(range(int(rows["m"]) + 1))


def _fold_predictions(rows: DataFrame, fold: int, n_classes: int, options: FitOptions) -> DataFrame:
    """Predictions of one fold, fit on the others."""
    score = fit_corn(rows.where(F.col("fold") != fold), n_classes, options)
    return score(rows.where(F.col("fold") == fold)).select(
        "slide_id", "fold", F.col("label").alias("y_true"), ordinal.corn_predict("cumulative", n_classes=n_classes).alias("y_pred"), "cumulative"
    )


def _cv_predictions(rows: DataFrame, folds: list[int], n_classes: int, options: FitOptions) -> DataFrame:
    """Out-of-fold predictions of (slide_id, label, fold, features vector) rows."""
    with ThreadPool(min(options.parallelism, len(folds))) as pool:
        parts = pool.map(lambda fold: _fold_predictions(rows, fold, n_classes, options), folds)
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    return scored


def _checked(splits: DataFrame, inventory: DataFrame | None) -> None:
    """Raises when the slides to be used mix vector widths or encoders, before any vector is read."""
    if inventory is not None:
        check_cohort(splits.where(~F.col("is_test")).select(F.col("patient_id").alias("slide_id")), inventory)


def train_cv(
    patches: DataFrame, splits: DataFrame, pooling: str = "mean", n_classes: int = 3, options: FitOptions = FitOptions(),
    inventory: DataFrame | None = None,
) -> DataFrame:
    """Out-of-fold predictions (slide_id, fold, y_true, y_pred, cumulative) of one pooling arm.

    With an ``inventory`` of the store the cohort is checked first."""
    _checked(splits, inventory)
    features = _labelled(pooled_features(patches, [pooling]), splits)
    rows = materialise(
        features.select("slide_id", "label", "fold", array_to_vector(F.col(pooling).cast("array<double>")).alias("features")), "pooled"
    )
    return _cv_predictions(rows, _folds(splits), n_classes, options)


def cv_summary(predictions: DataFrame, n_classes: int = 3) -> DataFrame:
    return aggregate_folds(grading_metrics(predictions, n_classes, by=["fold"]))


def _arm_scores(
    features: DataFrame, arms: Sequence[str], folds: list[int], n_classes: int, options: FitOptions
) -> DataFrame:
    """(arm, fold, qwk) of several pooling columns of one feature table."""
    out = None
    for arm in arms:
        rows = features.select("slide_id", "label", "fold", array_to_vector(F.col(f"`{arm}`").cast("array<double>")).alias("features"))
        scores = grading_metrics(_cv_predictions(rows, folds, n_classes, options), n_classes, by=["fold"]).select(
            F.lit(arm).alias("arm"), "fold", "qwk"
        )
        out = scores if out is None else out.unionByName(scores)
    return out


def pooling_comparison(
    patches: DataFrame, splits: DataFrame, arms: Sequence[str] = ("mean", "max", "p90", "std", "top", "bottom", "mean+std"),
    n_classes: int = 3, options: FitOptions = FitOptions(),
) -> DataFrame:
    """Per arm: mean kappa, paired delta to the first arm, folds improved, corrected standard error and t."""
    features = materialise(_labelled(pooled_features(patches, arms), splits), "arms")
    folds = _folds(splits)
    scores = materialise(_arm_scores(features, arms, folds, n_classes, options), "scores")
    means = scores.groupBy("arm").agg(F.avg("qwk").alias("qwk_mean"), F.stddev_pop("qwk").alias("qwk_std"))
    long = scores.withColumns({"repeat": F.lit(0), "score": F.col("qwk")})
    base = arms[0]
    tests = None
    for arm in arms[1:]:
        row = corrected_resampled_t(long, base, arm, 1.0 / (len(folds) - 1)).withColumn("arm", F.lit(arm))
        tests = row if tests is None else tests.unionByName(row)
    return means.join(tests, "arm", "left").select(
        "arm", "qwk_mean", "qwk_std", "mean_delta", "improved", "n", "corrected_se", "naive_se", "t"
    )


def tune(
    patches: DataFrame, splits: DataFrame, grid: Sequence[dict], n_trials: int | None = None, n_classes: int = 3,
    options: FitOptions = FitOptions(), seed: int = 0, n_startup_trials: int = 4, n_warmup_steps: int = 2, inventory: DataFrame | None = None,
) -> DataFrame:
    """(trial, pooling, reg_param, fold, score, mean_score, best, pruned_at, folds_run) over the grid, or ``n_trials`` points drawn from it.

    Points are drawn by a seeded hash of their values, so the order of the list decides nothing; ``trial`` is the place in it.

    Trials advance fold by fold, side by side. After each fold :func:`median_prune` is asked, and a trial that loses has no fit of a
    later fold: its rows end there. A trial is compared with earlier trials of the same fold only, so the outcome is that of
    running one trial after the other. ``best`` is chosen among trials with all folds. Only dev folds are read.
    """
    _checked(splits, inventory)
    drawn = sorted(enumerate(grid), key=lambda t: hashlib.sha256(f"{seed}|{sorted(t[1].items())}".encode()).hexdigest())
    alive = dict(sorted(drawn[:n_trials], key=lambda t: t[0]))
    arms = sorted({t["pooling"] for t in alive.values()})
    features = materialise(_labelled(pooled_features(patches, arms), splits), "tuning")
    vectors = {
        a: features.select("slide_id", "label", "fold", array_to_vector(F.col(f"`{a}`").cast("array<double>")).alias("features")) for a in arms
    }
    spark, history, cut = patches.sparkSession, [], {}

    def run(item: tuple[int, dict], fold: int, step: int) -> tuple:
        number, t = item
        tried = FitOptions(t["reg_param"], options.max_iter, options.parallelism)
        row = grading_metrics(_fold_predictions(vectors[t["pooling"]], fold, n_classes, tried), n_classes).first()
        return number, t["pooling"], float(t["reg_param"]), fold, step, row["qwk"]

    for step, fold in enumerate(_folds(splits)):
        with ThreadPool(max(1, min(options.parallelism, len(alive)))) as pool:
            history += pool.map(lambda item: run(item, fold, step), list(alive.items()))  # noqa: B023
        scores = spark.createDataFrame(history, "trial int, pooling string, reg_param double, fold int, step int, score double")
        asked = median_prune(scores.withColumn("study", F.lit(0)), n_startup_trials, n_warmup_steps).where("pruned_at IS NOT NULL")
        cut |= {r["trial"]: r["pruned_at"] for r in asked.collect() if r["trial"] in alive}  # one row per trial at most
        alive = {k: t for k, t in alive.items() if k not in cut}
    ended = F.lit(None).cast("int")
    for trial, at in cut.items():
        ended = F.when(F.col("trial") == trial, F.lit(at)).otherwise(ended)
    means = scores.groupBy("trial").agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).cast("int").alias("folds_run")).withColumn("pruned_at", ended)
    best = means.agg(F.max_by("trial", F.when(F.col("pruned_at").isNull(), F.struct("mean_score", -F.col("trial")))).alias("_best"))
    joined = scores.drop("step").join(means, "trial").withColumn("_one", F.lit(1)).join(best.withColumn("_one", F.lit(1)), "_one")
    return joined.withColumn("best", F.col("trial") == F.col("_best")).drop("_one", "_best")


FIT_ROWS = 200_000
"""About so many labelled patches, chosen by a hash of their keys, fit the patch classifier. All patches are scored."""


def _instance_scores(patches: DataFrame, fits: Sequence[LogisticRegressionModel]) -> DataFrame:
    """(slide_id, patch_idx, scores): the expected grade of every patch by every classifier, from one pass over the vectors."""
    layers = [(m.coefficientMatrix.toArray(), m.interceptVector.toArray()) for m in fits]
    kinds = {f.name: f.dataType.simpleString() for f in patches.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, out = _matrix(batch.column("features")), []
            for weights, bias in layers:
                z = x @ weights.T + bias
                e = np.exp(z - z.max(axis=1, keepdims=True))
                out.append((e / e.sum(axis=1, keepdims=True)) @ np.arange(len(bias)))
            scores = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(out, axis=1).ravel()), len(layers)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("slide_id"), batch.column("patch_idx"), scores], ["slide_id", "patch_idx", "scores"])

    narrow = patches.select("slide_id", "patch_idx", "features")
    return narrow.mapInArrow(run, f"slide_id {kinds['slide_id']}, patch_idx {kinds['patch_idx']}, scores array<double>")


def instance_pool(
    patches: DataFrame, splits: DataFrame, fraction: float = 0.10, mode: str = "top", n_classes: int = 3,
    options: FitOptions = FitOptions(), layout: Layout | None = None, fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """Out-of-fold predictions when slides are pooled by a patch classifier fit on the training folds. Dev subjects without patches are an error.

    Patches inherit the label of their slide; the classifier's expected grade ranks them. ``mode``
    "top" averages the best share of each slide, "softmax" weights all patches by exp(score).

    The classifiers are fit on about ``fit_rows`` patches of dev slides. The store is scored in place, all folds in one pass, and only
    (slide, patch, scores) are written; with the ``layout`` of a bucketed table the weights that follow are sent to the vectors.
    """
    if mode not in ("top", "softmax"):
        raise ValueError("mode must be 'top' or 'softmax'")
    dev = splits.where(~F.col("is_test")).select(F.col("patient_id").alias("slide_id"), "label", "fold")
    sizes = patches.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n"))
    bags = materialise(dev.join(sizes, "slide_id", "left"), "dev_bags")
    absent = bags.where("n IS NULL").select("slide_id").limit(5).collect()
    if absent:
        raise CohortError(f"dev subjects without features, e.g. {[r[0] for r in absent]}")
    rate = min(1.0, fit_rows / max(bags.agg(F.sum("n")).first()[0] or 0, 1))
    chosen = patches.where(hash_uniform("instances", "slide_id", "patch_idx") < rate).select("slide_id", array_to_vector(F.col("features").cast("array<double>")).alias("features"))
    sample = materialise(chosen.join(bags.drop("n"), "slide_id"), "fit_sample")
    folds = _folds(splits)

    def fit(fold: int) -> LogisticRegressionModel:
        return LogisticRegression(
            featuresCol="features", labelCol="label", family="multinomial", maxIter=options.max_iter, regParam=options.reg_param
        ).fit(sample.where(F.col("fold") != fold))

    with ThreadPool(min(options.parallelism, len(folds))) as pool:
        fits = pool.map(fit, folds)
    scored = materialise(_instance_scores(patches, fits).join(bags.select("slide_id"), "slide_id", "left_semi"), "instance_scores")
    if mode == "top":
        size = lambda n: F.greatest(F.floor(n * F.lit(fraction)), F.lit(1))
        long = scored.select("slide_id", "patch_idx", F.posexplode("scores").alias("k", "score"))
        best = extreme_rows(long, ["slide_id", "k"], "score", "patch_idx", size)
        taken = best.groupBy("slide_id", "patch_idx").agg(F.collect_set("k").alias("_k"))  # one entry per fold at most
        weights = taken.select("slide_id", "patch_idx", F.transform(F.sequence(F.lit(0), F.lit(len(folds) - 1)), lambda k: F.array_contains("_k", k).cast("double")).alias("weights"))
    else:
        weights = scored.select("slide_id", "patch_idx", F.transform("scores", lambda s: F.exp(s)).alias("weights"))
    vector = array_to_vector(F.col("features").cast("array<double>"))
    each = [Summarizer.mean(vector, F.get("weights", F.lit(k))).alias(f"bag{k}") for k in range(len(folds))]
    pooled = materialise(beside_patches(patches, weights, layout).groupBy("slide_id").agg(*each).join(bags.drop("n"), "slide_id"), "instance_bags")
    parts = None
    for k, fold in enumerate(folds):
        rows = pooled.select("slide_id", "label", "fold", F.col(f"bag{k}").alias("features"))
        part = _fold_predictions(rows, fold, n_classes, options)
        parts = part if parts is None else parts.unionByName(part)
    return parts

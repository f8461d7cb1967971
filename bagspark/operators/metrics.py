"""Agreement metrics. Everything derives from one aggregate of K x K confusion counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bagspark.functions import ordinal
from bagspark.skew import ranged_prefix

# Metric names.
METRICS = ["qwk", "macro_f1", "balanced_accuracy", "adjacent_accuracy", "mean_absolute_error"]


def _cell(i: int, j: int) -> str:
    return f"c{i}_{j}"


def _cells(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(k)]


def _total(columns: Sequence[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def confusion_wide(
    preds: DataFrame, n_classes: int = 3, by: Sequence[str] = (), true: str = "y_true", pred: str = "y_pred"
) -> DataFrame:
    """One row per group with a count column per (truth, prediction) cell, zeros included.

    Pairs with a grade outside 0..K-1 are counted beside the cells: by their truth or prediction where that is inside,
    and all together with how many are equal or neighbours and the sum of their distances.
    """
    counts = [
        F.count_if((F.col(true) == i) & (F.col(pred) == j)).alias(_cell(i, j)) for i, j in _cells(n_classes)
    ]
    known = [F.col(c).between(0, n_classes - 1) for c in (true, pred)]
    odd, far = ~(known[0] & known[1]), F.abs(F.col(true) - F.col(pred))
    beside = [F.count_if(odd & (F.col(true) == i)).alias(f"t{i}") for i in range(n_classes)]
    beside += [F.count_if(odd & (F.col(pred) == j)).alias(f"p{j}") for j in range(n_classes)]
    beside += [F.count_if(odd).alias("n_outside"), F.count_if(odd & (far == 0)).alias("o_equal"), F.count_if(odd & (far <= 1)).alias("o_near")]
    distance = F.coalesce(F.sum(F.when(odd, far)), F.lit(0)).cast("bigint").alias("o_far")
    return preds.groupBy(*by).agg(*counts, *beside, distance)


def _beside(k: int) -> list[str]:
    return [*[f"t{i}" for i in range(k)], *[f"p{j}" for j in range(k)], "n_outside", "o_equal", "o_near", "o_far"]


def confusion(preds: DataFrame, n_classes: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Long form (by..., y_true, y_pred, n), rows = truth."""
    wide = confusion_wide(preds, n_classes, by)
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("y_true"), F.lit(j).alias("y_pred"), F.col(_cell(i, j)).alias("n"))
            for i, j in _cells(n_classes)
        ]
    )
    return wide.select(*by, F.explode(cells).alias("_c")).select(*by, "_c.*")


def metrics_from_confusion(wide: DataFrame, n_classes: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    """Metric columns from the cell columns of :func:`confusion_wide`.

    Kappa without expected disagreement is null; an undefined F1 counts as 0; balanced accuracy
    averages over the classes 0..K-1 present in the truth. Pairs with a grade outside count in n, the accuracies and
    the mean error, as misses of the grade that is inside, and not in kappa.
    """
    k = n_classes
    c = {ij: F.col(_cell(*ij)).cast("double") for ij in _cells(k)}
    row = [_total([c[i, j] for j in range(k)]) for i in range(k)]
    col = [_total([c[i, j] for i in range(k)]) for j in range(k)]
    inside = _total(row)
    n = inside + F.col("n_outside")
    truths, guesses = [row[i] + F.col(f"t{i}") for i in range(k)], [col[j] + F.col(f"p{j}") for j in range(k)]
    weighted = [((i - j) ** 2, i, j) for i, j in _cells(k) if i != j]
    observed = _total([F.lit(float(w)) * c[i, j] for w, i, j in weighted])
    expected = _total([F.lit(float(w)) * row[i] * col[j] for w, i, j in weighted])
    f1 = [
        F.coalesce(F.try_divide(F.lit(2.0) * c[i, i], truths[i] + guesses[i]), F.lit(0.0)) for i in range(k)
    ]
    recalls = _total([F.coalesce(F.try_divide(c[i, i], truths[i]), F.lit(0.0)) for i in range(k)])
    present = _total([F.when(truths[i] > 0, 1.0).otherwise(0.0) for i in range(k)])
    return wide.select(
        *keep,
        n.cast("bigint").alias("n"),
        (F.lit(1.0) - F.try_divide(observed * inside, expected)).alias("qwk"),
        (_total(f1) / k).alias("macro_f1"),
        F.try_divide(recalls, present).alias("balanced_accuracy"),
        F.try_divide(_total([c[i, i] for i in range(k)]) + F.col("o_equal"), n).alias("accuracy"),
        F.try_divide(_total([c[i, j] for i, j in _cells(k) if abs(i - j) <= 1]) + F.col("o_near"), n).alias("adjacent_accuracy"),
        F.try_divide(_total([F.lit(float(abs(i - j))) * c[i, j] for i, j in _cells(k) if i != j]) + F.col("o_far"), n).alias(
            "mean_absolute_error"
        ),
        *[f1[i].alias(f"f1_{i}") for i in range(k)],
    )


def grading_metrics(
    preds: DataFrame, n_classes: int = 3, by: Sequence[str] = (), true: str = "y_true", pred: str = "y_pred"
) -> DataFrame:
    return metrics_from_confusion(confusion_wide(preds, n_classes, by, true, pred), n_classes, by)


def resampled_kappa(counts: np.ndarray) -> np.ndarray:
    """Quadratic weighted kappa per [..., K, K] count matrix; NaN where the truth has one class."""
    k = counts.shape[-1]
    w = (np.arange(k)[:, None] - np.arange(k)[None, :]) ** 2
    row, col, n = counts.sum(-1), counts.sum(-2), counts.sum((-1, -2))
    expected = (w * (row[..., :, None] * col[..., None, :])).sum((-1, -2)) / np.maximum(n, 1)
    observed = (w * counts).sum((-1, -2))
    single = (row > 0).sum(-1) < 2
    return np.where(single | (expected == 0), np.nan, 1 - observed / np.where(expected == 0, 1, expected))


def _multinomial_kappas(spark: SparkSession, counts: np.ndarray, n_boot: int, seed: int, k: int) -> DataFrame:
    total = int(counts.sum())

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kappas = np.full(len(batch), np.nan)
            if total:
                tables = np.stack(
                    [np.random.default_rng([seed, b]).multinomial(total, counts / total) for b in batch["id"]]
                )
                kappas = resampled_kappa(tables.reshape(-1, k, k).astype(float))
            yield pd.DataFrame({"qwk": kappas})

    return spark.range(n_boot).mapInPandas(draw, "qwk double").where(~F.isnan("qwk"))


def _hashed_kappas(spark: SparkSession, counts: np.ndarray, n_boot: int, seed: int, k: int) -> DataFrame:
    """Every draw of every resample is a hash: four of 32 bits from md5("seed|resample|draw div 4"), each looked up in the cumulative
    counts of the cells. Draws are counted where they are made, so one row per resample and task is exchanged."""
    total = int(counts.sum())
    quads = -(-total // 4)
    limits = [int(v) for v in np.cumsum(counts)]
    ids = spark.range(n_boot * quads).select(F.expr(f"id div {max(quads, 1)}").alias("b"), F.expr(f"id % {max(quads, 1)}").alias("q"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("b").cast("string"), F.col("q").cast("string"))).alias("d")
    at = [
        F.when(F.col("q") * 4 + part < total, F.floor(F.conv(F.substring("d", 8 * part + 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) * total)).alias(f"p{part}")
        for part in range(4)
    ]
    placed = ids.select("b", "q", digest).select("b", *at)
    below = [F.sum(_total([F.when(F.col(f"p{part}") < v, 1).otherwise(0) for part in range(4)])).alias(f"c{c}") for c, v in enumerate(limits)]
    reached = placed.groupBy("b").agg(*below)
    cells = {(i, j): F.col(f"c{i * k + j}") - (F.col(f"c{i * k + j - 1}") if i + j else F.lit(0)) for i, j in _cells(k)}
    wide = reached.select("b", *[v.cast("double").alias(_cell(*ij)) for ij, v in cells.items()])
    row = [_total([F.col(_cell(i, j)) for j in range(k)]) for i in range(k)]
    col = [_total([F.col(_cell(i, j)) for i in range(k)]) for j in range(k)]
    weighted = [(float((i - j) ** 2), i, j) for i, j in _cells(k) if i != j]
    observed = _total([F.lit(w) * F.col(_cell(i, j)) for w, i, j in weighted])
    expected = _total([F.lit(w) * row[i] * col[j] for w, i, j in weighted])
    classes = _total([F.when(r > 0, 1).otherwise(0) for r in row])
    kappa = F.lit(1.0) - F.try_divide(observed * F.lit(float(total)), expected)
    return wide.where(classes >= 2).select(kappa.alias("qwk")).where(F.col("qwk").isNotNull())


def bootstrap_qwk_ci(
    preds: DataFrame, n_boot: int = 2000, alpha: float = 0.05, seed: int = 0, n_classes: int = 3, method: str = "multinomial"
) -> DataFrame:
    """Percentile interval of kappa over resamples with replacement: ``qwk_lo, qwk_hi, n_used``.

    Resampling rows and counting them is a multinomial draw over the K x K cells, so by ``method`` "multinomial" the cost does
    not depend on the number of rows. "hash" makes every single draw, by a rule that can be restated anywhere, at a cost of
    rows x resamples hashes. Only the cell counts pass through the driver. Resamples
    with a single true class are left out; without any left the bounds are null.
    """
    if method not in ("multinomial", "hash"):
        raise ValueError("method must be 'multinomial' or 'hash'")
    cells = confusion_wide(preds, n_classes).first()
    counts = np.array([cells[_cell(i, j)] for i, j in _cells(n_classes)], dtype=np.int64)
    kappas = _hashed_kappas if method == "hash" else _multinomial_kappas
    scores = kappas(preds.sparkSession, counts, n_boot, seed, n_classes)
    return scores.agg(
        F.percentile("qwk", F.lit(alpha / 2)).alias("qwk_lo"),
        F.percentile("qwk", F.lit(1 - alpha / 2)).alias("qwk_hi"),
        F.count("qwk").alias("n_used"),
    )


def aggregate_folds(fold_metrics: DataFrame, fold: str = "fold") -> DataFrame:
    """(metric, mean, std, n_folds, per_fold): population deviation, per_fold ordered by fold."""
    long = fold_metrics.unpivot([fold], METRICS, "metric", "value")
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.count(F.lit(1)).alias("n_folds"),
        F.array_sort(F.collect_list(F.struct(fold, "value"))).alias("per_fold"),
    )


def _mean_arrays(df: DataFrame, keys: Sequence[str], k: int, *extra: Column) -> DataFrame:
    mean = F.array(*[F.avg(F.col("cumulative")[j]) for j in range(k - 1)]).alias("cumulative")
    return df.groupBy(*keys).agg(mean, *extra)


def crop_average(crops: DataFrame, n_classes: int = 3, key: str = "slide_id") -> DataFrame:
    """Mean cumulative probabilities over the crops of each (slide, model)."""
    return _mean_arrays(crops, [key, "model"], n_classes)


def ensemble_predict(model_cums: DataFrame, n_classes: int = 3, key: str = "slide_id") -> DataFrame:
    """Mean over models, with the sample and population spread averaged over thresholds."""
    def spread(fn):
        return _total([fn(F.col("cumulative")[j]) for j in range(n_classes - 1)]) / (n_classes - 1)

    return _mean_arrays(
        model_cums,
        [key],
        n_classes,
        spread(F.stddev_samp).alias("spread_samp"),
        spread(F.stddev_pop).alias("spread_pop"),
        F.count(F.lit(1)).alias("n_models"),
    )


def prediction_record(df: DataFrame, cum_col: str = "cumulative", n_classes: int | None = None) -> DataFrame:
    """Adds grade, probabilities, expected_grade, confidence, ambiguity and posterior entropy."""
    probs = F.col("probabilities")
    return (
        df.withColumn("probabilities", ordinal.corn_class_probs(cum_col, n_classes))
        .withColumn("grade", ordinal.corn_predict(cum_col, n_classes=n_classes))
        .withColumns(
            {
                "expected_grade": ordinal.expected_grade(probs),
                "confidence": F.get(probs, F.col("grade")),
                "ambiguity": ordinal.ambiguity(cum_col),
                "entropy": -ordinal.array_sum(F.transform(probs, lambda p: p * F.ln(p + F.lit(1e-12)))),
            }
        )
    )


def error_detection_auc(preds: DataFrame, signals: Sequence[str]) -> DataFrame:
    """AUC of each signal for "the prediction is wrong", ties counted half (Mann-Whitney)."""
    wrong = (F.col("y_true") != F.col("y_pred")).cast("bigint")
    long = preds.select(wrong.alias("wrong"), *signals).unpivot(["wrong"], list(signals), "signal", "value")
    by_value = long.groupBy("signal", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("wrong").alias("n_wrong"))
    placed = ranged_prefix(by_value, ["value"], keys=["signal"], weight="n", out="before")
    mean_rank = F.col("before") + (F.col("n") + 1) / 2.0
    sums = placed.groupBy("signal").agg(
        F.sum(F.col("n_wrong") * mean_rank).alias("_ranks"),
        F.sum("n_wrong").alias("n_wrong"),
        F.sum(F.col("n") - F.col("n_wrong")).alias("n_right"),
    )
    pairs = F.col("n_wrong").cast("double") * F.col("n_right")
    u = F.col("_ranks") - F.col("n_wrong") * (F.col("n_wrong") + 1) / 2.0
    return sums.select("signal", "n_wrong", "n_right", F.try_divide(u, pairs).alias("auc"))


def selective_prediction(
    preds: DataFrame, signal: str = "ambiguity", key: str = "id", buckets: int = 10, n_classes: int = 3
) -> DataFrame:
    """Risk-coverage curve: metrics over the most decisive 1/buckets, 2/buckets, ... of the rows."""
    total = preds.count()
    placed = ranged_prefix(preds.select(key, signal, "y_true", "y_pred"), [signal, key], out="_p")
    small, longer = divmod(total, buckets)
    edge = longer * (small + 1)
    p = F.col("_p")
    bucket = F.when(p < edge, F.floor(p / (small + 1))).otherwise(
        F.lit(longer) + F.floor((p - edge) / max(small, 1))
    )
    per = confusion_wide(placed.withColumn("bucket", bucket.cast("int") + 1), n_classes, ["bucket"])
    upto = W.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    cells = [*[_cell(i, j) for i, j in _cells(n_classes)], *_beside(n_classes)]
    curve = metrics_from_confusion(
        per.select("bucket", *[F.sum(c).over(upto).alias(c) for c in cells]), n_classes, ["bucket"]
    )
    return curve.withColumn("coverage", F.col("n") / F.lit(float(max(total, 1))))


def corrected_resampled_t(
    scores: DataFrame, arm_a: str, arm_b: str, test_over_train: float, by: Sequence[str] = ()
) -> DataFrame:
    """Paired per-split deltas (b - a): mean, variance, Nadeau-Bengio and naive standard error, t."""
    per = scores.groupBy(*by, "repeat", "fold").agg(
        F.max(F.when(F.col("arm") == arm_a, F.col("score"))).alias("a"),
        F.max(F.when(F.col("arm") == arm_b, F.col("score"))).alias("b"),
    )
    deltas = per.where("a IS NOT NULL AND b IS NOT NULL").withColumn("d", F.col("b") - F.col("a"))
    out = deltas.groupBy(*by).agg(
        F.count("d").alias("n"),
        F.avg("d").alias("mean_delta"),
        F.var_samp("d").alias("var_delta"),
        F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("improved"),
    )
    out = out.withColumns(
        {
            "corrected_se": F.sqrt(F.col("var_delta") * (1 / F.col("n") + F.lit(test_over_train))),
            "naive_se": F.sqrt(F.col("var_delta") / F.col("n")),
        }
    )
    return out.withColumn("t", F.try_divide(F.col("mean_delta"), F.col("corrected_se")))


def contextualise(metrics: DataFrame, col: str = "qwk") -> DataFrame:
    return metrics.withColumn("band", ordinal.contextualise(col))

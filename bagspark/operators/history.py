"""Training histories, trials and progress journals.

History rows are one per (run, fold, epoch): a group is as long as a training run has epochs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RUN = ["run", "fold"]


def smooth_metric(history: DataFrame, window: int = 5, keys: Sequence[str] = RUN) -> DataFrame:
    """Adds ``smoothed``: median of the metric over the last ``window`` epochs."""
    recent = W.partitionBy(*keys).orderBy("epoch").rowsBetween(1 - max(1, window), 0)
    return history.withColumn("smoothed", F.percentile("metric", F.lit(0.5)).over(recent))


def line_slopes() -> Callable[[np.ndarray], np.ndarray]:
    """The function for least-squares slopes of the rows of a matrix over the positions 0, 1, ...

    Moments are updated value by value, each product added before it is rounded: slopes that are a threshold in
    exact arithmetic are common, and every caller has to round them alike. Made in a call, so that tasks get it by value.
    """

    def slopes(windows: np.ndarray) -> np.ndarray:
        mean_x, mean_y, xx, xy = 0.0, np.zeros(len(windows)), 0.0, np.zeros(len(windows))
        for i in range(windows.shape[1]):
            y, dx = windows[:, i], i - mean_x
            mean_x += dx / (i + 1)
            mean_y = mean_y + (y - mean_y) / (i + 1)
            xx += dx * (i - mean_x)
            xy = (np.longdouble(dx) * (y - mean_y) + xy).astype("float64")
        n = windows.shape[1]
        return (xy / n) / (xx / n) if n > 1 else np.full(len(windows), np.nan)

    return slopes


def plateau_slope(history: DataFrame, window: int = 10, keys: Sequence[str] = RUN) -> DataFrame:
    """Adds ``slope``: least squares over the last ``window`` smoothed values; null until enough.

    Windows with nulls or values that are not finite are left to Spark's own regression.
    """
    slopes = line_slopes()

    @F.pandas_udf("double")
    def full_slope(windows: pd.Series) -> pd.Series:
        out, full = np.full(len(windows), np.nan), windows.notna().to_numpy()
        if full.any():
            out[full] = slopes(np.stack(windows[full].to_list()))
        return pd.Series(out)

    series = W.partitionBy(*keys).orderBy("epoch")
    recent = series.rowsBetween(1 - window, 0)
    placed = history.withColumn("_pos", F.row_number().over(series)).withColumns(
        {
            "_values": F.collect_list("smoothed").over(recent),
            "_slope": F.regr_slope(F.col("smoothed"), F.col("_pos").cast("double")).over(recent),
        }
    )
    full = (F.size("_values") == window) & ~F.isnan("_slope")
    slope = F.coalesce(full_slope(F.when(full, F.col("_values"))), "_slope")
    return placed.withColumn("slope", F.when(F.col("_pos") >= max(3, window), slope)).drop("_pos", "_values", "_slope")


def early_stopping(
    history: DataFrame,
    patience: int = 20,
    min_delta: float = 0.002,
    mode: str = "max",
    smooth_window: int = 5,
    plateau_window: int = 10,
    plateau_slope_below: float | None = 0.001,
    min_epochs: int = 20,
    keys: Sequence[str] = RUN,
) -> DataFrame:
    """(run, fold, stop_epoch, reason, num_bad): where each history would have been stopped.

    An epoch improves when the smoothed metric beats every earlier smoothed value by
    ``min_delta``. Stops on exhausted patience, or on a flat trend once half of it is spent;
    ``stop_epoch`` is null when neither happens.
    """
    if mode not in ("max", "min"):
        raise ValueError("mode must be 'max' or 'min'")
    judged = judge_epochs(
        history, patience, min_delta, mode, smooth_window, plateau_window, plateau_slope_below, min_epochs, keys
    )
    hit = F.struct("epoch", "reason", "num_bad")
    return judged.groupBy(*keys).agg(
        F.min_by(hit, F.when(F.col("reason").isNotNull(), F.col("epoch"))).alias("h"),
        F.count("reason").alias("_stops"),
    ).select(
        *keys,
        *[F.when(F.col("_stops") > 0, F.col(f"h.{c}")).alias(n) for c, n in
          (("epoch", "stop_epoch"), ("reason", "reason"), ("num_bad", "num_bad"))],
    )


def judge_epochs(
    history: DataFrame, patience: int, min_delta: float, mode: str, smooth_window: int, plateau_window: int,
    plateau_slope_below: float | None, min_epochs: int, keys: Sequence[str],
) -> DataFrame:
    """Every epoch with smoothed, slope, num_bad and the reason it would stop for, if any."""
    df = plateau_slope(smooth_metric(history, smooth_window, keys), plateau_window, keys)
    series = W.partitionBy(*keys).orderBy("epoch")
    sign = 1.0 if mode == "max" else -1.0
    df = df.withColumn("_s", F.col("smoothed") * sign).withColumn("_pos", F.row_number().over(series))
    best_before = F.max("_s").over(series.rowsBetween(W.unboundedPreceding, -1))
    better = best_before.isNull() | (F.col("_s") > best_before + min_delta)
    df = df.withColumn("_better", F.when(better, F.col("_pos")))
    last = F.max("_better").over(series.rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumn("num_bad", F.col("_pos") - last)
    flat = F.lit(False)
    if plateau_slope_below is not None:
        flat = F.coalesce(F.abs("slope") < plateau_slope_below, F.lit(False)) & (F.col("num_bad") >= patience // 2)
    reason = F.when(F.col("epoch") < min_epochs, F.lit(None)).when(F.col("num_bad") >= patience, "patience").when(flat, "plateau")
    return df.withColumn("reason", reason).drop("_s", "_pos", "_better")


def best_epoch(
    history: DataFrame, min_delta: float = 0.002, mode: str = "max", keys: Sequence[str] = RUN
) -> DataFrame:
    """(run, fold, best, best_epoch): the raw metric replaces the best only when it gains ``min_delta``.

    Each replacement depends on the one before, so the epochs of a run are folded in order.
    """
    sign = 1.0 if mode == "max" else -1.0
    series = F.array_sort(F.collect_list(F.struct("epoch", (F.col("metric") * sign).alias("m"))))
    nothing = F.struct(F.lit(None).cast("double").alias("m"), F.lit(None).cast("int").alias("epoch"))

    def step(acc: Column, e: Column) -> Column:
        gains = acc["m"].isNull() | (e["m"] > acc["m"] + F.lit(min_delta))
        return F.when(gains, F.struct(e["m"].alias("m"), e["epoch"].cast("int").alias("epoch"))).otherwise(acc)

    folded = history.groupBy(*keys).agg(series.alias("_e")).withColumn("_b", F.aggregate("_e", nothing, step))
    return folded.select(*keys, (F.col("_b.m") * sign).alias("best"), F.col("_b.epoch").alias("best_epoch"))


def median_prune(
    trials: DataFrame, n_startup_trials: int = 4, n_warmup_steps: int = 2, by: Sequence[str] = ("study",)
) -> DataFrame:
    """(study, trial, pruned_at): first step where a trial's best report so far is below the median.

    A trial reports its running mean after each step; the median is over the reports of earlier
    trials of the study at that step. ``step`` counts from 0; a study has few trials by nature.
    """
    keys = list(by)
    own = W.partitionBy(*keys, "trial").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*keys, "step").orderBy("trial").rowsBetween(W.unboundedPreceding, -1)
    reports = trials.withColumn("report", F.avg("score").over(own))
    reports = reports.withColumns(
        {
            "best": F.max("report").over(own),
            "number": F.dense_rank().over(W.partitionBy(*keys).orderBy("trial")),
            "median": F.percentile("report", F.lit(0.5)).over(earlier),
        }
    )
    cut = (F.col("number") > n_startup_trials) & (F.col("step") >= n_warmup_steps) & (F.col("best") < F.col("median"))
    return reports.groupBy(*keys, "trial").agg(F.min(F.when(cut, F.col("step"))).alias("pruned_at"))


def weight_selection(candidates: DataFrame) -> DataFrame:
    """Per fold the averaged weights ("ema") only when they score strictly better than "best-epoch"."""
    per = candidates.groupBy("fold").agg(
        F.max(F.when(F.col("weights") == "best-epoch", F.col("score"))).alias("best_epoch"),
        F.max(F.when(F.col("weights") == "ema", F.col("score"))).alias("ema"),
    )
    wins = F.coalesce(F.col("ema") > F.col("best_epoch"), F.lit(False))
    return per.select(
        "fold",
        F.when(wins, "ema").otherwise("best-epoch").alias("selected"),
        F.when(wins, F.col("ema")).otherwise(F.col("best_epoch")).alias("score"),
    )


def ablation_summary(history: DataFrame, fold_metrics: DataFrame) -> DataFrame:
    """Per arm: kappa mean, population deviation, per-fold list, mean last-epoch attention entropy.

    A fold that never logged an entropy raises ``entropy_missing`` instead of vanishing.
    """
    last = history.groupBy("arm", "fold").agg(
        F.max_by("entropy", F.when(F.col("entropy").isNotNull(), F.col("epoch"))).alias("entropy"),
        F.count("entropy").alias("_logged"),
    )
    joined = fold_metrics.join(last, ["arm", "fold"], "left")
    logged = F.coalesce("_logged", F.lit(0)) > 0
    return joined.groupBy("arm").agg(
        F.avg("qwk").alias("qwk_mean"), F.stddev_pop("qwk").alias("qwk_std"), F.count("qwk").alias("n_folds"),
        F.array_sort(F.collect_list(F.struct("fold", "qwk"))).alias("per_fold"),
        F.avg(F.when(logged, F.col("entropy"))).alias("entropy_final"),
        F.bool_or(~logged).alias("entropy_missing"),
    )


def progress_summary(journal: DataFrame, totals: DataFrame) -> DataFrame:
    """Per shard and combined (shard null): done, failed, total, units, rate per hour, ETA, percent.

    Elapsed time is the span of the journal; the combined row spans all shards.
    """
    per = journal.rollup("shard").agg(
        F.count_if("ok").alias("done"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("n_patches"))), F.lit(0)).alias("units"),
        (F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 3.6e9).alias("elapsed_h"),
    )
    asked = totals.rollup("shard").agg(F.sum("total").alias("total"))
    joined = per.join(asked, per["shard"].eqNullSafe(asked["shard"])).drop(asked["shard"])
    rate = F.col("done") / F.greatest("elapsed_h", F.lit(1e-6))
    left = F.greatest(F.col("total") - F.col("done") - F.col("failed"), F.lit(0))
    return joined.withColumn("rate_per_h", rate).withColumns(
        {
            "eta_h": left / F.greatest("rate_per_h", F.lit(1e-6)),
            "percent": F.try_divide(F.col("done") * 100.0, F.col("total")),
        }
    )


def stage_breakdown(journal: DataFrame) -> DataFrame:
    """(stage, seconds, share) of in-slide time, and its ratio to the wall time of the journal."""
    stages = ["grid", "encode", "write"]
    sums = journal.agg(
        *[F.sum(f"{s}_seconds").alias(s) for s in stages],
        (F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 1e6).alias("wall"),
    )
    total = F.col("grid") + F.col("encode") + F.col("write")
    rows = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("seconds")) for s in stages])
    return sums.select(F.explode(rows).alias("r"), total.alias("t"), "wall").select(
        "r.stage", "r.seconds", F.try_divide(F.col("r.seconds"), F.col("t")).alias("share"),
        F.try_divide(F.col("t"), F.col("wall")).alias("in_slide_over_wall"),
    )

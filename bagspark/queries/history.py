"""Histories, trials and journals over events and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from bagspark.operators import history as H
from bagspark.queries.registry import query, r6, rounded, tables

SMOOTH = """sm AS (SELECT *, quantile_cont(metric, 0.5) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS smoothed FROM history)"""
SLOPE = f"""{SMOOTH}, sl AS (SELECT *, CASE WHEN epoch >= 10 THEN regr_slope(smoothed, epoch) OVER
    (PARTITION BY run ORDER BY epoch ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS slope FROM sm)"""


def history(spark, sf):
    return tables(spark, sf, "history")


@query("smooth_metric", f"WITH {SMOOTH} SELECT run, epoch, round(smoothed, 9) + 0.0 AS smoothed FROM sm", "history")
def smooth_metric(spark, sf):
    return H.smooth_metric(history(spark, sf)).select("run", "epoch", (F.round("smoothed", 9) + 0.0).alias("smoothed"))


@query("plateau_slope", f"WITH {SLOPE} SELECT run, epoch, round(slope, 6) + 0.0 AS slope FROM sl", "history")
def plateau_slope(spark, sf):
    return rounded(H.plateau_slope(H.smooth_metric(history(spark, sf))), "slope").select("run", "epoch", "slope")


@query(
    "early_stopping",
    f"""WITH {SLOPE}, b AS (SELECT *, max(smoothed) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM sl),
        i AS (SELECT *, CASE WHEN prev IS NULL OR smoothed > prev + 0.002e0 THEN epoch END AS imp FROM b),
        n AS (SELECT *, epoch - max(imp) OVER (PARTITION BY run ORDER BY epoch) AS num_bad FROM i),
        s AS (SELECT *, CASE WHEN epoch < 20 THEN NULL WHEN num_bad >= 20 THEN 'patience'
                             WHEN abs(slope) < 0.001 AND num_bad >= 10 THEN 'plateau' END AS why FROM n),
        f AS (SELECT run, min(epoch) FILTER (WHERE why IS NOT NULL) AS stop_epoch FROM s GROUP BY run)
        SELECT f.run, f.stop_epoch, s.why AS reason, CAST(s.num_bad AS INT) AS num_bad FROM f LEFT JOIN s ON s.run = f.run AND s.epoch = f.stop_epoch""",
    "history",
)
def early_stopping(spark, sf):
    return H.early_stopping(history(spark, sf)).drop("fold")


@query(
    "best_epoch",
    """WITH RECURSIVE walk AS (SELECT run, epoch, metric AS best, epoch AS best_epoch FROM history WHERE epoch = 1
         UNION ALL SELECT h.run, h.epoch, CASE WHEN h.metric > w.best + 0.002e0 THEN h.metric ELSE w.best END,
                          CASE WHEN h.metric > w.best + 0.002e0 THEN h.epoch ELSE w.best_epoch END
         FROM walk w JOIN history h ON h.run = w.run AND h.epoch = w.epoch + 1)
       SELECT run, round(best, 6) + 0.0 AS best, best_epoch FROM walk QUALIFY row_number() OVER (PARTITION BY run ORDER BY epoch DESC) = 1""",
    "history",
)
def best_epoch(spark, sf):
    return rounded(H.best_epoch(history(spark, sf)), "best").drop("fold")


@query(
    "median_prune",
    """WITH r AS (SELECT study, trial, step - 1 AS step, avg(score) OVER (PARTITION BY study, trial ORDER BY step) AS report,
                         dense_rank() OVER (PARTITION BY study ORDER BY trial) AS number FROM trials),
            b AS (SELECT *, max(report) OVER (PARTITION BY study, trial ORDER BY step) AS best FROM r),
            m AS (SELECT a.study, a.trial, a.step, any_value(a.best) AS best, any_value(a.number) AS number, median(e.report) AS med
                  FROM b a LEFT JOIN b e ON e.study = a.study AND e.step = a.step AND e.trial < a.trial GROUP BY 1, 2, 3)
       SELECT study, trial, min(step) FILTER (WHERE number > 4 AND step >= 2 AND best < med) AS pruned_at FROM m GROUP BY study, trial""",
    "trials",
)
def median_prune(spark, sf):
    rows = tables(spark, sf, "trials").withColumn("step", F.col("step") - 1)
    return H.median_prune(rows)


@query(
    "weight_selection",
    """WITH c AS (SELECT l_suppkey AS fold, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS b,
                         avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS e FROM lineitem GROUP BY l_suppkey)
       SELECT fold, CASE WHEN e > b THEN 'ema' ELSE 'best-epoch' END AS selected, round(CASE WHEN e > b THEN e ELSE b END, 4) + 0.0 AS score FROM c""",
)
def weight_selection(spark, sf):
    weights = F.when(F.col("l_returnflag") == "A", "best-epoch").when(F.col("l_returnflag") == "R", "ema")
    rows = tables(spark, sf, "lineitem").select(F.col("l_suppkey").alias("fold"), weights.alias("weights"), "l_extendedprice")
    scores = rows.groupBy("fold", "weights").agg(F.avg("l_extendedprice").alias("score"))
    return H.weight_selection(scores).withColumn("score", F.round("score", 4) + 0.0)


@query(
    "ablation_summary",
    """WITH h AS (SELECT event_type AS arm, user_id % 5 AS fold, dayofyear(ts) AS epoch,
                         avg(CASE WHEN event_type = 'error' AND user_id % 5 = 0 THEN NULL ELSE value END) / 500 AS entropy FROM events GROUP BY 1, 2, 3),
            m AS (SELECT event_type AS arm, user_id % 5 AS fold, avg(value) / 500 AS qwk FROM events GROUP BY 1, 2),
            l AS (SELECT arm, fold, arg_max(entropy, epoch) AS entropy, count(entropy) AS logged FROM h WHERE entropy IS NOT NULL GROUP BY 1, 2)
       SELECT arm, round(avg(qwk), 6) + 0.0 AS qwk_mean, round(stddev_pop(qwk), 6) + 0.0 AS qwk_std, count(qwk) AS n_folds,
              round(avg(entropy), 6) + 0.0 AS entropy_final, bool_or(logged IS NULL) AS entropy_missing
       FROM m LEFT JOIN l USING (arm, fold) GROUP BY arm""",
)
def ablation_summary(spark, sf):
    events = tables(spark, sf, "events").select(
        F.col("event_type").alias("arm"), (F.col("user_id") % 5).alias("fold"), F.dayofyear("ts").alias("epoch"), "value"
    )
    silent = (F.col("arm") == "error") & (F.col("fold") == 0)
    hist = events.groupBy("arm", "fold", "epoch").agg((F.avg(F.when(~silent, F.col("value"))) / 500).alias("entropy"))
    scores = events.groupBy("arm", "fold").agg((F.avg("value") / 500).alias("qwk"))
    df = H.ablation_summary(hist, scores).drop("per_fold")
    return rounded(df, "qwk_mean", "qwk_std", "entropy_final")


@query(
    "progress_summary",
    """WITH t AS (SELECT shard, count(*) + 100 AS total FROM journal GROUP BY shard),
            p AS (SELECT shard, count(*) FILTER (WHERE ok) AS done, count(*) FILTER (WHERE NOT ok) AS failed, sum(n_patches) FILTER (WHERE ok) AS units,
                         epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM journal GROUP BY ROLLUP (shard)),
            j AS (SELECT p.shard, done, failed, units, us / 3.6e9 AS h, coalesce(t.total, (SELECT sum(total) FROM t)) AS total FROM p LEFT JOIN t USING (shard))
       SELECT shard, done, failed, CAST(units AS BIGINT) AS units, CAST(total AS BIGINT) AS total, round(h, 6) + 0.0 AS elapsed_h,
              round(done / greatest(h, 1e-6), 6) + 0.0 AS rate_per_h, round((total - done - failed) / (done / greatest(h, 1e-6)), 6) + 0.0 AS eta_h,
              round(done * 100.0e0 / total, 6) + 0.0 AS percent FROM j""",
    "journal",
)
def progress_summary(spark, sf):
    rows = tables(spark, sf, "journal")
    totals = rows.groupBy("shard").agg((F.count(F.lit(1)) + 100).alias("total"))
    return rounded(H.progress_summary(rows, totals), "elapsed_h", "rate_per_h", "eta_h", "percent")


@query(
    "stage_breakdown",
    """WITH s AS (SELECT sum(grid_seconds) AS g, sum(encode_seconds) AS e, sum(write_seconds) AS w, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS wall FROM journal),
            l AS (SELECT unnest(['grid', 'encode', 'write']) AS stage, unnest([g, e, w]) AS seconds, g + e + w AS t, wall FROM s)
       SELECT stage, round(seconds, 4) + 0.0 AS seconds, round(seconds / t, 6) + 0.0 AS share, round(t / wall, 6) + 0.0 AS in_slide_over_wall FROM l""",
    "journal",
)
def stage_breakdown(spark, sf):
    df = rounded(H.stage_breakdown(tables(spark, sf, "journal")), "share", "in_slide_over_wall")
    return df.withColumn("seconds", F.round("seconds", 4) + 0.0)

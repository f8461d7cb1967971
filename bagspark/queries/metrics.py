"""Agreement metrics over orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from bagspark.functions import ordinal as O
from bagspark.operators import metrics as M
from bagspark.operators.splits import make_splits, majority_label
from bagspark.plans.evaluate import evaluate_locked as evaluate
from bagspark.queries.ordinal import CUM, with_records
from bagspark.queries.registry import query, r6, rounded, tables
from bagspark.queries.splits import FINGERPRINT, SPLIT
from bagspark.session import materialise

NAMES = ["qwk", "macro_f1", "balanced_accuracy", "accuracy", "adjacent_accuracy", "mean_absolute_error"]
ALL = NAMES + ["f1_0", "f1_1", "f1_2"]
ROUNDED = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ALL)


def metric_ctes(source: str, g: str = "fold") -> str:
    """CTEs ending in ``metrics`` (g, n, metric columns) from (g, y_true, y_pred) rows."""
    return f"""grid AS (SELECT * FROM (SELECT DISTINCT {g} FROM {source}) a, (SELECT unnest([0, 1, 2]) AS k) b),
per AS (SELECT {g}, count(*) AS n, avg(CASE WHEN y_true = y_pred THEN 1.0e0 ELSE 0 END) AS accuracy,
               avg(CASE WHEN abs(y_true - y_pred) <= 1 THEN 1.0e0 ELSE 0 END) AS adjacent_accuracy,
               avg(abs(y_true - y_pred)) AS mean_absolute_error,
               sum((y_true - y_pred) * (y_true - y_pred)) AS obs FROM {source} GROUP BY {g}),
cls AS (SELECT gr.{g}, k, count(*) FILTER (WHERE y_true = k) AS t, count(*) FILTER (WHERE y_pred = k) AS p,
               count(*) FILTER (WHERE y_true = k AND y_pred = k) AS tp
        FROM grid gr JOIN {source} s ON gr.{g} = s.{g} GROUP BY gr.{g}, k),
ex AS (SELECT a.{g}, sum((a.k - b.k) * (a.k - b.k) * a.t * b.p)::DOUBLE AS e FROM cls a JOIN cls b ON a.{g} = b.{g} GROUP BY a.{g}),
f AS (SELECT {g}, k, CASE WHEN t + p = 0 THEN 0 ELSE 2.0e0 * tp / (t + p) END AS f1,
             CASE WHEN t > 0 THEN tp::DOUBLE / t END AS recall FROM cls),
fa AS (SELECT {g}, avg(f1) AS macro_f1, avg(recall) AS balanced_accuracy, max(f1) FILTER (WHERE k = 0) AS f1_0,
              max(f1) FILTER (WHERE k = 1) AS f1_1, max(f1) FILTER (WHERE k = 2) AS f1_2 FROM f GROUP BY {g}),
metrics AS (SELECT per.{g}, n, 1 - CASE WHEN e = 0 THEN NULL ELSE obs * n / e END AS qwk, macro_f1, balanced_accuracy,
                   accuracy, adjacent_accuracy, mean_absolute_error, f1_0, f1_1, f1_2
            FROM per JOIN ex USING ({g}) JOIN fa USING ({g}))"""


def predictions(spark, sf):
    return tables(spark, sf, "predictions")


@query(
    "confusion",
    """SELECT t.k AS y_true, p.k AS y_pred, count(x.id) AS n
       FROM (SELECT unnest([0, 1, 2]) AS k) t CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) p
       LEFT JOIN predictions x ON x.y_true = t.k AND x.y_pred = p.k GROUP BY t.k, p.k""",
    "predictions",
)
def confusion(spark, sf):
    return M.confusion(predictions(spark, sf))


@query("grading_metrics", f"WITH {metric_ctes('predictions')} SELECT fold, n, {ROUNDED} FROM metrics", "predictions")
def grading_metrics(spark, sf):
    return rounded(M.grading_metrics(predictions(spark, sf), by=["fold"]), *ALL)


def bootstrap_ctes(source: str, n_boot: int) -> str:
    """CTEs ending in ``interval`` (qwk_lo, qwk_hi, n_used) from (y_true, y_pred) rows, draw by draw."""
    return f"""bc AS (SELECT t.k AS i, p.k AS j, (SELECT count(*) FROM {source} x WHERE x.y_true = t.k AND x.y_pred = p.k) AS n
       FROM (SELECT unnest([0, 1, 2]) AS k) t CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) p),
bl AS (SELECT i, j, sum(n) OVER (ORDER BY i, j) AS hi, sum(n) OVER (ORDER BY i, j) - n AS lo, CAST(sum(n) OVER () AS BIGINT) AS total FROM bc),
bs AS (SELECT total, (total + 3) // 4 AS quads FROM bl LIMIT 1),
bd AS (SELECT b, q, total, md5('0|' || b || '|' || q) AS d FROM bs, (SELECT unnest(range({n_boot})) AS b) r, LATERAL (SELECT unnest(range(quads)) AS q) s),
bp AS (SELECT b, floor(CAST(('0x' || substr(d, 8 * part + 1, 8)) AS BIGINT) / 4294967296.0e0 * total) AS p
       FROM bd, (SELECT unnest([0, 1, 2, 3]) AS part) t WHERE q * 4 + part < total),
bt AS (SELECT b, i, j, count(*)::DOUBLE AS n FROM bp JOIN bl ON p >= lo AND p < hi GROUP BY b, i, j),
br AS (SELECT b, i, sum(n) AS n FROM bt GROUP BY b, i), bk AS (SELECT b, j, sum(n) AS n FROM bt GROUP BY b, j),
be AS (SELECT br.b, sum((i - j) * (i - j) * br.n * bk.n) AS e, count(DISTINCT i) AS classes FROM br JOIN bk USING (b) GROUP BY br.b),
bo AS (SELECT b, sum((i - j) * (i - j) * n) * sum(n) AS o FROM bt GROUP BY b),
interval AS (SELECT quantile_cont(1 - o / e, 0.025) AS qwk_lo, quantile_cont(1 - o / e, 0.975) AS qwk_hi, count(*) AS n_used
             FROM be JOIN bo USING (b) WHERE classes > 1 AND e > 0)"""


@query(
    "bootstrap_qwk_ci",
    f"WITH {bootstrap_ctes('predictions', 200)} SELECT round(qwk_lo, 6) + 0.0 AS qwk_lo, round(qwk_hi, 6) + 0.0 AS qwk_hi, n_used FROM interval",
    "predictions",
)
def bootstrap_qwk_ci(spark, sf):
    """By the rule that SQL can follow; the multinomial rule is held against it in the tests."""
    return rounded(M.bootstrap_qwk_ci(predictions(spark, sf), n_boot=200, method="hash"), "qwk_lo", "qwk_hi")


@query(
    "aggregate_folds",
    f"""WITH {metric_ctes('predictions')},
        long AS (SELECT fold, unnest({M.METRICS}) AS metric, unnest([{', '.join(M.METRICS)}]) AS value FROM metrics)
        SELECT metric, round(avg(value) OVER w, 6) + 0.0 AS mean, round(stddev_pop(value) OVER w, 6) + 0.0 AS std,
               count(*) OVER w AS n_folds, fold, round(value, 6) + 0.0 AS value FROM long WINDOW w AS (PARTITION BY metric)""",
    "predictions",
)
def aggregate_folds(spark, sf):
    df = M.aggregate_folds(M.grading_metrics(predictions(spark, sf), by=["fold"]))
    long = df.select("metric", "mean", "std", "n_folds", F.explode("per_fold").alias("e"))
    return rounded(long.select("metric", "mean", "std", "n_folds", "e.*"), "mean", "std", "value")


@query(
    "contextualise",
    f"""WITH {metric_ctes('predictions')} SELECT fold, round(qwk, 6) + 0.0 AS qwk,
        CASE WHEN qwk < 0.5 THEN 'below' WHEN qwk <= 0.7 THEN 'inside' ELSE 'exceeds' END AS band FROM metrics""",
    "predictions",
)
def contextualise(spark, sf):
    df = M.contextualise(M.grading_metrics(predictions(spark, sf), by=["fold"]))
    return rounded(df, "qwk").select("fold", "qwk", "band")


@query(
    "error_detection_auc",
    f"""WITH {CUM}, sig AS (SELECT y_true <> y_pred AS wrong, ambiguity,
              -(p0 * ln(p0 + 1e-12) + p1 * ln(p1 + 1e-12) + p2 * ln(p2 + 1e-12)) AS entropy FROM probs),
        long AS (SELECT 'ambiguity' AS signal, wrong, round(ambiguity, 9) AS v FROM sig
                 UNION ALL SELECT 'entropy', wrong, round(entropy, 9) FROM sig),
        r AS (SELECT *, rank() OVER (PARTITION BY signal ORDER BY v) + (count(*) OVER (PARTITION BY signal, v) - 1) / 2.0e0 AS rk FROM long),
        s AS (SELECT signal, count(*) FILTER (WHERE wrong) AS n_wrong, count(*) FILTER (WHERE NOT wrong) AS n_right,
                     sum(rk) FILTER (WHERE wrong) AS ranks FROM r GROUP BY signal)
        SELECT signal, n_wrong, n_right, round((ranks - n_wrong * (n_wrong + 1) / 2) / (n_wrong * n_right), 6) + 0.0 AS auc FROM s""",
    "predictions",
)
def error_detection_auc(spark, sf):
    df = with_records(spark, sf).select(
        "y_true", "y_pred", *[F.round(c, 9).alias(c) for c in ("ambiguity", "entropy")]
    )
    return rounded(M.error_detection_auc(df, ["ambiguity", "entropy"]), "auc")


@query(
    "selective_prediction",
    f"""WITH {CUM}, b AS (SELECT y_true, y_pred, ntile(10) OVER (ORDER BY round(ambiguity, 9), id) AS decile FROM probs),
        cum_rows AS (SELECT CAST(k.bucket AS INT) AS bucket, y_true, y_pred
                     FROM b JOIN (SELECT unnest(range(1, 11)) AS bucket) k ON b.decile <= k.bucket),
        {metric_ctes('cum_rows', 'bucket')}
        SELECT bucket, n, {ROUNDED}, round(n / (SELECT count(*) FROM probs), 6) + 0.0 AS coverage FROM metrics""",
    "predictions",
)
def selective_prediction(spark, sf):
    df = with_records(spark, sf).withColumn("ambiguity", F.round("ambiguity", 9))
    return rounded(M.selective_prediction(df), *ALL, "coverage")


@query(
    "corrected_resampled_t",
    """WITH s AS (SELECT l_suppkey AS study, month(l_shipdate) AS repeat, l_linenumber AS fold, l_returnflag AS arm,
                         avg(l_extendedprice) / 100000 AS score FROM lineitem GROUP BY 1, 2, 3, 4),
            d AS (SELECT a.study, b.score - a.score AS d FROM s a JOIN s b USING (study, repeat, fold) WHERE a.arm = 'A' AND b.arm = 'R'),
            g AS (SELECT study, count(*) AS n, avg(d) AS mean_delta, var_samp(d) AS var_delta, count(*) FILTER (WHERE d > 0) AS improved
                  FROM d GROUP BY study)
       SELECT study, n, improved, round(mean_delta, 6) + 0.0 AS mean_delta, round(sqrt(var_delta * (1.0e0 / n + 0.25e0)), 6) + 0.0 AS corrected_se,
              round(sqrt(var_delta / n), 6) + 0.0 AS naive_se,
              round(mean_delta / sqrt(var_delta * (1.0e0 / n + 0.25e0)), 6) + 0.0 AS t FROM g""",
)
def corrected_resampled_t(spark, sf):
    rows = tables(spark, sf, "lineitem")
    scores = rows.groupBy(
        F.col("l_suppkey").alias("study"), F.month("l_shipdate").alias("repeat"),
        F.col("l_linenumber").alias("fold"), F.col("l_returnflag").alias("arm"),
    ).agg((F.avg("l_extendedprice") / 100000).alias("score"))
    df = M.corrected_resampled_t(scores, "A", "R", 0.25, by=["study"])
    return rounded(df, "mean_delta", "corrected_se", "naive_se", "t").select(
        "study", "n", "improved", "mean_delta", "corrected_se", "naive_se", "t"
    )


PATIENT = "concat('TCGA-', lpad(CAST(o_custkey % 97 AS STRING), 2, '0'), '-', lpad(CAST(o_custkey AS STRING), 6, '0'))"
LOCKED = f"""logit AS (SELECT {PATIENT} AS patient_id, unnest([0, 1, 2]) AS model,
      CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 250 - 2 AS z0, CAST((o_orderkey * 104729) % 1000 AS DOUBLE) / 250 - 2 AS z1 FROM orders),
lc AS (SELECT patient_id, model, 1 / (1 + exp(-(z0 + 1 + 0.3e0 * model))) AS c0,
              1 / (1 + exp(-(z0 + 1 + 0.3e0 * model))) * (1 / (1 + exp(-(z1 + 0.5e0 - 0.1e0 * model)))) AS c1 FROM logit),
pm AS (SELECT patient_id, model, avg(c0) AS c0, avg(c1) AS c1 FROM lc GROUP BY patient_id, model),
en AS (SELECT patient_id, avg(c0) AS c0, avg(c1) AS c1, (stddev_samp(c0) + stddev_samp(c1)) / 2 AS spread FROM pm GROUP BY patient_id),
locked AS (SELECT 0 AS g, s.label AS y_true, CASE WHEN c0 > 0.5 THEN 1 ELSE 0 END + CASE WHEN c1 > 0.5 THEN 1 ELSE 0 END AS y_pred, spread
           FROM splits s JOIN en USING (patient_id) WHERE s.is_test)"""


def patient_models(spark, sf):
    """Cumulative probabilities per (patient, model), averaged over a patient's orders as crops."""
    rows = tables(spark, sf, "orders").selectExpr(
        f"{PATIENT} AS patient_id",
        "CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 250 - 2 AS z0",
        "CAST((o_orderkey * 104729) % 1000 AS DOUBLE) / 250 - 2 AS z1",
        "explode(array(0, 1, 2)) AS model",
    )
    z0 = F.col("z0") + 1 + F.col("model") * 0.3
    z1 = F.col("z1") + 0.5 - F.col("model") * 0.1
    crops = rows.select("patient_id", "model", O.corn_cumulative(F.array(z0, z1), 3).alias("cumulative"))
    return M.crop_average(crops, key="patient_id")


@query(
    "evaluate_locked",
    f"""WITH {SPLIT}, {LOCKED}, {metric_ctes('locked', 'g')}
        SELECT n, {ROUNDED}, (SELECT round(avg(spread), 6) + 0.0 FROM locked) AS mean_spread,
               {FINGERPRINT.format('splits')} AS fingerprint,
               3 AS n_models FROM metrics""",
    "raw_labels",
)
def evaluate_locked(spark, sf):
    splits = materialise(make_splits(majority_label(tables(spark, sf, "raw_labels"))), "splits")
    df = evaluate(patient_models(spark, sf), splits, unlock=True, bootstrap=0)
    return rounded(df, *ALL, "mean_spread").select("n", *ALL, "mean_spread", "fingerprint", F.col("n_models").cast("int").alias("n_models"))


@query(
    "evaluate_locked_interval",
    f"""WITH {SPLIT}, {LOCKED}, {metric_ctes('locked', 'g')}, {bootstrap_ctes('locked', 2000)}
        SELECT n, {ROUNDED}, (SELECT round(avg(spread), 6) + 0.0 FROM locked) AS mean_spread,
               {FINGERPRINT.format('splits')} AS fingerprint, 3 AS n_models,
               round(qwk_lo, 6) + 0.0 AS qwk_lo, round(qwk_hi, 6) + 0.0 AS qwk_hi, n_used FROM metrics, interval""",
    "raw_labels",
)
def evaluate_locked_interval(spark, sf):
    """The locked evaluation with its bootstrap interval, every draw a hash."""
    splits = materialise(make_splits(majority_label(tables(spark, sf, "raw_labels"))), "splits")
    df = evaluate(patient_models(spark, sf), splits, unlock=True, bootstrap=2000, method="hash")
    return rounded(df, *ALL, "mean_spread", "qwk_lo", "qwk_hi").select(
        "n", *ALL, "mean_spread", "fingerprint", F.col("n_models").cast("int").alias("n_models"), "qwk_lo", "qwk_hi", "n_used"
    )

"""Ordinal expressions, losses and prediction records over orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from bagspark.functions import ordinal as O
from bagspark.operators import losses as Ls
from bagspark.operators import metrics as M
from bagspark.queries.registry import query, r6, rounded, tables
from bagspark.session import scratch_path

CUM = """cum AS (SELECT *, 1 / (1 + exp(-z0)) AS c0, 1 / (1 + exp(-z0)) * (1 / (1 + exp(-z1))) AS c1 FROM predictions),
probs AS (SELECT *, 1 - c0 AS p0, c0 - c1 AS p1, c1 AS p2,
                 CASE WHEN c0 > 0.5 THEN 1 ELSE 0 END + CASE WHEN c1 > 0.5 THEN 1 ELSE 0 END AS grade,
                 0.5e0 - least(abs(c0 - 0.5), abs(c1 - 0.5)) AS ambiguity FROM cum)"""


def predictions(spark, sf):
    return tables(spark, sf, "predictions").withColumn("logits", F.array("z0", "z1"))


def with_cumulative(spark, sf):
    return predictions(spark, sf).withColumn("cumulative", O.corn_cumulative("logits", 3))


def with_records(spark, sf):
    return M.prediction_record(with_cumulative(spark, sf), n_classes=3)


@query(
    "corn_cumulative",
    f"WITH {CUM} SELECT id, round(c0, 6) + 0.0 AS c0, round(c1, 6) + 0.0 AS c1 FROM cum",
    "predictions",
)
def corn_cumulative(spark, sf):
    df = with_cumulative(spark, sf)
    return df.select("id", *[r6(F.col("cumulative")[j]).alias(f"c{j}") for j in range(2)])


@query(
    "corn_class_probs",
    f"WITH {CUM} SELECT id, round(p0, 6) + 0.0 AS p0, round(p1, 6) + 0.0 AS p1, round(p2, 6) + 0.0 AS p2 FROM probs",
    "predictions",
)
def corn_class_probs(spark, sf):
    df = with_cumulative(spark, sf).withColumn("p", O.corn_class_probs("cumulative", 3))
    return df.select("id", *[r6(F.col("p")[k]).alias(f"p{k}") for k in range(3)])


@query("corn_predict", f"WITH {CUM} SELECT id, CAST(grade AS INT) AS grade FROM probs", "predictions")
def corn_predict(spark, sf):
    return with_cumulative(spark, sf).select("id", O.corn_predict("cumulative", n_classes=3).alias("grade"))


@query(
    "prediction_record",
    f"""WITH {CUM} SELECT id, CAST(grade AS INT) AS grade, round(p1 + 2 * p2, 6) + 0.0 AS expected_grade,
        round(CASE grade WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 6) + 0.0 AS confidence,
        round(ambiguity, 6) + 0.0 AS ambiguity,
        round(-(p0 * ln(p0 + 1e-12) + p1 * ln(p1 + 1e-12) + p2 * ln(p2 + 1e-12)), 6) + 0.0 AS entropy FROM probs""",
    "predictions",
)
def prediction_record(spark, sf):
    names = ["expected_grade", "confidence", "ambiguity", "entropy"]
    return rounded(with_records(spark, sf), *names).select("id", "grade", *names)


@query(
    "cumulative_targets",
    """SELECT id, CASE WHEN y_true > 0 THEN 1.0e0 ELSE 0.0e0 END AS t0, CASE WHEN y_true > 1 THEN 1.0e0 ELSE 0.0e0 END AS t1,
       CAST(y_true AS DOUBLE) AS implied FROM predictions""",
    "predictions",
)
def cumulative_targets(spark, sf):
    df = predictions(spark, sf).withColumn("t", O.cumulative_targets("y_true"))
    return df.select("id", *[F.col("t")[j].alias(f"t{j}") for j in range(2)], O.array_sum("t").alias("implied"))


BCE = "greatest({z}, 0) - {z} * {t} + ln(1 + exp(-abs({z})))"


@query(
    "corn_loss",
    f"""SELECT round((avg({BCE.format(z='z0', t='(CASE WHEN y_true > 0 THEN 1 ELSE 0 END)')})
        + avg({BCE.format(z='z1', t='(CASE WHEN y_true > 1 THEN 1 ELSE 0 END)')}) FILTER (WHERE y_true > 0)) / 2, 6) + 0.0 AS corn
        FROM predictions""",
    "predictions",
)
def corn_loss(spark, sf):
    return rounded(Ls.corn_loss(predictions(spark, sf)), "corn")


@query(
    "corn_loss_soft",
    f"""WITH {CUM}, soft AS (SELECT greatest(least(c0, 1 - 1e-6), 1e-6) AS c0, greatest(least(c1, 1 - 1e-6), 1e-6) AS c1,
          0.7e0 * (CASE WHEN y_true > 0 THEN 1 ELSE 0 END) + 0.3e0 * (CASE WHEN y_pred > 0 THEN 1 ELSE 0 END) AS t0,
          0.7e0 * (CASE WHEN y_true > 1 THEN 1 ELSE 0 END) + 0.3e0 * (CASE WHEN y_pred > 1 THEN 1 ELSE 0 END) AS t1 FROM cum)
        SELECT round(-avg(t0 * ln(c0) + (1 - t0) * ln(1 - c0) + t1 * ln(c1) + (1 - t1) * ln(1 - c1)) / 2, 6) + 0.0 AS corn FROM soft""",
    "predictions",
)
def corn_loss_soft(spark, sf):
    mixed = F.zip_with(
        O.cumulative_targets("y_true"), O.cumulative_targets("y_pred"), lambda a, b: a * 0.7 + b * 0.3
    )
    return rounded(Ls.corn_loss_soft(predictions(spark, sf).withColumn("cum_targets", mixed)), "corn")


@query(
    "soft_qwk_loss",
    f"""WITH {CUM}, long AS (SELECT y_true AS i, unnest([0, 1, 2]) AS j, unnest([p0, p1, p2]) AS p FROM probs),
        n AS (SELECT count(*) AS n FROM predictions),
        o AS (SELECT i, j, sum(p) AS o FROM long GROUP BY i, j),
        t AS (SELECT y_true AS i, count(*) AS t FROM predictions GROUP BY y_true),
        m AS (SELECT j, sum(p) AS m FROM long GROUP BY j),
        num AS (SELECT sum((i - j) * (i - j) / 4.0e0 * o) / sum(o) AS num FROM o),
        den AS (SELECT sum((i - j) * (i - j) / 4.0e0 * t * m) / sum(t * m) AS den FROM t, m)
        SELECT round(num / den, 6) + 0.0 AS soft_qwk FROM num, den""",
    "predictions",
)
def soft_qwk_loss(spark, sf):
    df = with_cumulative(spark, sf).withColumn("probabilities", O.corn_class_probs("cumulative", 3))
    return rounded(Ls.soft_qwk_loss(df), "soft_qwk")


CROPS = f"""crops AS (SELECT id AS slide_id, m AS model, z0 + 0.3e0 * m - 0.2e0 * c AS z0, z1 - 0.1e0 * m + 0.4e0 * c AS z1
    FROM predictions, (SELECT unnest([0, 1, 2]) AS m) a, (SELECT unnest([0, 1]) AS c) b),
ccum AS (SELECT slide_id, model, 1 / (1 + exp(-z0)) AS c0, 1 / (1 + exp(-z0)) * (1 / (1 + exp(-z1))) AS c1 FROM crops),
per_model AS (SELECT slide_id, model, avg(c0) AS c0, avg(c1) AS c1 FROM ccum GROUP BY slide_id, model)"""


def model_crops(spark, sf):
    df = tables(spark, sf, "predictions").select(
        F.col("id").alias("slide_id"), "z0", "z1", F.explode(F.array(*map(F.lit, range(3)))).alias("model")
    ).withColumn("crop", F.explode(F.array(F.lit(0), F.lit(1))))
    z0 = F.col("z0") + F.col("model") * 0.3 - F.col("crop") * 0.2
    z1 = F.col("z1") - F.col("model") * 0.1 + F.col("crop") * 0.4
    return df.select("slide_id", "model", O.corn_cumulative(F.array(z0, z1), 3).alias("cumulative"))


@query(
    "crop_average",
    f"WITH {CROPS} SELECT slide_id, model, round(c0, 6) + 0.0 AS c0, round(c1, 6) + 0.0 AS c1 FROM per_model",
    "predictions",
)
def crop_average(spark, sf):
    df = M.crop_average(model_crops(spark, sf))
    return df.select("slide_id", "model", *[r6(F.col("cumulative")[j]).alias(f"c{j}") for j in range(2)])


@query(
    "ensemble_predict",
    f"""WITH {CROPS} SELECT slide_id, round(avg(c0), 6) + 0.0 AS c0, round(avg(c1), 6) + 0.0 AS c1,
        round((stddev_samp(c0) + stddev_samp(c1)) / 2, 6) + 0.0 AS spread_samp,
        round((stddev_pop(c0) + stddev_pop(c1)) / 2, 6) + 0.0 AS spread_pop, count(*) AS n_models
        FROM per_model GROUP BY slide_id""",
    "predictions",
)
def ensemble_predict(spark, sf):
    df = M.ensemble_predict(M.crop_average(model_crops(spark, sf)))
    return rounded(df, "spread_samp", "spread_pop").select(
        "slide_id", *[r6(F.col("cumulative")[j]).alias(f"c{j}") for j in range(2)], "spread_samp", "spread_pop", "n_models"
    )


@query(
    "write_predictions",
    f"""WITH {CUM} SELECT id, round(c0, 6) + 0.0 AS c0, round(c1, 6) + 0.0 AS c1, CAST(grade AS INT) AS y_pred, y_true FROM probs""",
    "predictions",
)
def write_predictions(spark, sf):
    from bagspark.sources.store import write_predictions as write

    path = scratch_path(spark, "predictions")
    df = with_cumulative(spark, sf).withColumn("y_pred", O.corn_predict("cumulative", n_classes=3))
    write(df.select("id", "cumulative", "y_pred", "y_true", F.lit(0.0).alias("fold_spread")), path)
    back = spark.read.parquet(path)
    return back.select("id", *[r6(F.col("cumulative")[j]).alias(f"c{j}") for j in range(2)], "y_pred", "y_true")

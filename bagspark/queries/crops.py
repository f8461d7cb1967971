"""Full-coverage scoring over embeddings with sparse patch ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from bagspark.plans import crops as C
from bagspark.queries.attention import NORMED, STRIDE, fixture_weights, gated_sql, head_sql, vectors
from bagspark.queries.registry import query, r6, rounded

BAG = 8


def crop_sql(*models):
    parts = [NORMED, f"""place AS (SELECT slide_id, patch_idx, CAST(floor((row_number() OVER (PARTITION BY slide_id ORDER BY patch_idx) - 1) / {BAG}) AS BIGINT) AS crop
        FROM patches_vec)"""]
    for m in models:
        parts += [
            gated_sql(m),
            f"""ca{m} AS (SELECT slide_id, crop, patch_idx, offset_no, exp(score) / sum(exp(score)) OVER (PARTITION BY slide_id, crop, offset_no, branch) AS a
                FROM gated{m} JOIN place USING (slide_id, patch_idx))""",
            f"cs{m} AS (SELECT slide_id, crop, patch_idx, offset_no AS k, avg(a) AS alpha FROM ca{m} GROUP BY ALL)",
            f"cb{m} AS (SELECT slide_id, crop, k, dim, sum(alpha * h) AS v FROM normed JOIN cs{m} USING (slide_id, patch_idx) GROUP BY ALL)",
            head_sql(f"cb{m}", m, "slide_id, crop, k"),
        ]
    heads = " UNION ALL ".join(f"SELECT slide_id, crop, model, avg(z0) AS z0, avg(z1) AS z1 FROM head{m} GROUP BY ALL" for m in models)
    return f"""{', '.join(parts)}, cz AS ({heads}), sized AS (SELECT slide_id, crop, count(*) AS n FROM place GROUP BY ALL),
cc AS (SELECT slide_id, crop, model, n, 1 / (1 + exp(-z0)) AS c0, 1 / (1 + exp(-z0)) * (1 / (1 + exp(-z1))) AS c1 FROM cz JOIN sized USING (slide_id, crop)),
pc AS (SELECT slide_id, model, avg(c0) AS c0, avg(c1) AS c1 FROM cc GROUP BY slide_id, model),
en AS (SELECT slide_id, avg(c0) AS c0, avg(c1) AS c1, (stddev_samp(c0) + stddev_samp(c1)) / 2 AS spread_samp FROM pc GROUP BY slide_id)"""


def sparse(spark, sf):
    """Patch ids with growing gaps; their order is that of the given ids."""
    return vectors(spark, sf).withColumn("patch_idx", F.col("patch_idx") * F.col("patch_idx") * 3 + F.col("slide_id"))


@query(
    "crop_predictions",
    f"""WITH {crop_sql(0, 1)} SELECT slide_id, crop, CAST(model AS INT) AS model, n, round(c0, 6) + 0.0 AS c0, round(c1, 6) + 0.0 AS c1 FROM cc""",
    "patches_vec",
)
def crop_predictions(spark, sf):
    df = C.crop_predictions(sparse(spark, sf), [fixture_weights(0), fixture_weights(1)], BAG, STRIDE)
    return df.select("slide_id", "crop", "model", "n", *[r6(F.col("cumulative")[j]).alias(f"c{j}") for j in range(2)])


@query(
    "score_crops",
    f"""WITH {crop_sql(0, 1)} SELECT slide_id, CASE WHEN c0 > 0.5 THEN 1 ELSE 0 END + CASE WHEN c1 > 0.5 THEN 1 ELSE 0 END AS grade,
        round((c0 - c1) + 2 * c1, 6) + 0.0 AS expected_grade, round(0.5e0 - least(abs(c0 - 0.5), abs(c1 - 0.5)), 6) + 0.0 AS ambiguity,
        round(spread_samp, 6) + 0.0 AS spread_samp, round(c0, 6) + 0.0 AS c0, round(c1, 6) + 0.0 AS c1 FROM en""",
    "patches_vec",
)
def score_crops(spark, sf):
    df = C.score_crops(sparse(spark, sf), [fixture_weights(0), fixture_weights(1)], BAG, STRIDE)
    names = ["expected_grade", "ambiguity", "spread_samp"]
    return rounded(df, *names).select("slide_id", "grade", *names, *[r6(F.col("cumulative")[j]).alias(f"c{j}") for j in range(2)])

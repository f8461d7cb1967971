"""Bags, attention maps, reports and scoring over lineitem and embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from bagspark.functions import ordinal as O
from bagspark.functions import vectors as V
from bagspark.operators import attention as A
from bagspark.operators import bags as B
from bagspark.operators import losses as Ls
from bagspark.operators import pooling as P
from bagspark.operators.metrics import prediction_record
from bagspark.plans import scoring as S
from bagspark.queries.ordinal import CUM
from bagspark.queries.registry import query, r6, rounded, tables
from bagspark.queries.splits import MAJORITY, labels

SOFTMAX = """soft AS (SELECT slide_id, patch_idx, k, exp(score - max(score) OVER w) AS e FROM map_scores WINDOW w AS (PARTITION BY slide_id, k)),
maps AS (SELECT slide_id, patch_idx, k, e / sum(e) OVER (PARTITION BY slide_id, k) AS alpha FROM soft)"""
SIG = """sig AS (SELECT slide_id, patch_idx, k, 1 / (1 + exp(-score)) AS s FROM map_scores),
anchor AS (SELECT slide_id, patch_idx, k, s / greatest(sum(s) OVER (PARTITION BY slide_id, k), 1e-6) AS target FROM sig)"""
ONE_MAP = """soft1 AS (SELECT slide_id, patch_idx, x, y, exp(score - max(score) OVER (PARTITION BY slide_id)) AS e FROM patches),
attn AS (SELECT slide_id, patch_idx, x, y, e / sum(e) OVER (PARTITION BY slide_id) AS alpha FROM soft1)"""


def maps(spark, sf):
    return A.masked_softmax(tables(spark, sf, "map_scores")).drop("score")


def attention(spark, sf, with_size=False):
    """One softmax map per slide with coordinates."""
    return A.masked_softmax(tables(spark, sf, "patches"), ["slide_id"], with_size=with_size).drop("score")


@query("masked_softmax", f"WITH {SOFTMAX} SELECT slide_id, patch_idx, k, round(alpha, 9) + 0.0 AS alpha FROM maps", "map_scores")
def masked_softmax(spark, sf):
    return maps(spark, sf).withColumn("alpha", F.round("alpha", 9) + 0.0)


@query("normalised_sigmoid", f"WITH {SIG} SELECT slide_id, patch_idx, k, round(target, 9) + 0.0 AS alpha FROM anchor", "map_scores")
def normalised_sigmoid(spark, sf):
    return A.normalised_sigmoid(tables(spark, sf, "map_scores")).drop("score").withColumn("alpha", F.round("alpha", 9) + 0.0)


LONG = "long AS (SELECT slide_id, patch_idx, unnest(features)::DOUBLE AS v, generate_subscripts(features, 1) - 1 AS dim FROM patches_vec)"


def vectors(spark, sf):
    return tables(spark, sf, "patches_vec")


def long_bags(df, col="bag"):
    return df.select("slide_id", F.posexplode(col).alias("dim", "v")).select("slide_id", "dim", r6("v").alias("value"))


@query("mean_pool", f"WITH {LONG} SELECT slide_id, CAST(dim AS INT) AS dim, round(avg(v), 6) + 0.0 AS value FROM long GROUP BY slide_id, dim", "patches_vec")
def mean_pool(spark, sf):
    return long_bags(A.mean_pool(vectors(spark, sf)))


@query(
    "attention_pool",
    f"""WITH {LONG}, s AS (SELECT slide_id, patch_idx, k, v * (k + 1) AS score FROM long, (SELECT unnest([0, 1, 2]) AS k) b WHERE dim = 0),
        e AS (SELECT *, exp(score) AS e FROM s), a AS (SELECT slide_id, patch_idx, k, e / sum(e) OVER (PARTITION BY slide_id, k) AS alpha FROM e),
        m AS (SELECT slide_id, k, dim, sum(alpha * v) AS v FROM long JOIN a USING (slide_id, patch_idx) GROUP BY slide_id, k, dim)
        SELECT slide_id, CAST(dim AS INT) AS dim, round(avg(v), 6) + 0.0 AS value FROM m GROUP BY slide_id, dim""",
    "patches_vec",
)
def attention_pool(spark, sf):
    rows = vectors(spark, sf)
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")
    scores = rows.select("slide_id", "patch_idx", F.col("features")[0].cast("double").alias("f"), k)
    alpha = A.masked_softmax(scores.withColumn("score", F.col("f") * (F.col("k") + 1)))
    return long_bags(A.attention_pool(rows, alpha))


@query(
    "pooling_statistics",
    f"""WITH {LONG}, nrm AS (SELECT slide_id, patch_idx, sqrt(sum(v * v)) AS nrm FROM long GROUP BY slide_id, patch_idx),
        rk AS (SELECT slide_id, patch_idx, row_number() OVER (PARTITION BY slide_id ORDER BY nrm DESC, patch_idx) AS hi,
                      row_number() OVER (PARTITION BY slide_id ORDER BY nrm, patch_idx) AS lo,
                      greatest(floor(count(*) OVER (PARTITION BY slide_id) * 0.1e0), 1) AS k FROM nrm)
        SELECT slide_id, CAST(dim AS INT) AS dim, round(avg(v), 6) + 0.0 AS mean, round(max(v), 6) + 0.0 AS max,
               round(quantile_cont(v, 0.9), 6) + 0.0 AS p90, round(stddev_pop(v), 6) + 0.0 AS std,
               round(avg(v) FILTER (WHERE hi <= k), 6) + 0.0 AS top, round(avg(v) FILTER (WHERE lo <= k), 6) + 0.0 AS bottom
        FROM long JOIN rk USING (slide_id, patch_idx) GROUP BY slide_id, dim""",
    "patches_vec",
)
def pooling_statistics(spark, sf):
    return rounded(P.pooling_statistics(vectors(spark, sf)), "mean", "max", "p90", "std", "top", "bottom")


@query(
    "top_regions",
    f"""WITH {ONE_MAP}, r AS (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY alpha DESC, patch_idx) AS rank,
             count(*) OVER (PARTITION BY slide_id) AS n FROM attn)
        SELECT slide_id, CAST(rank AS INT) AS rank, patch_idx, x, y, 448 AS size, round(alpha, 9) + 0.0 AS attention,
               round(alpha * n, 6) + 0.0 AS share_of_slide FROM r WHERE rank <= 10""",
    "patches",
)
def top_regions(spark, sf):
    df = A.top_regions(attention(spark, sf, with_size=True), 10)
    return rounded(df, "share_of_slide").withColumn("attention", F.round("attention", 9) + 0.0)


GRID = f"""{ONE_MAP}, cells AS (SELECT slide_id, CAST(floor(y / 448) AS BIGINT) AS cy, CAST(floor(x / 448) AS BIGINT) AS cx, avg(alpha) AS m
         FROM attn GROUP BY 1, 2, 3),
b AS (SELECT slide_id, quantile_cont(m, 0.5) AS lo, quantile_cont(m, 0.99) AS hi FROM cells GROUP BY slide_id),
shape AS (SELECT slide_id, max(cy) AS h, max(cx) AS w FROM cells GROUP BY slide_id),
dense AS (SELECT slide_id, cy, unnest(range(0, w + 1)) AS cx FROM (SELECT slide_id, w, unnest(range(0, h + 1)) AS cy FROM shape) s),
grid AS (SELECT d.slide_id, d.cy, d.cx,
                coalesce(sqrt(least(greatest((m - lo) / greatest(hi - lo, 1e-12), 0), 1)), 0) AS value
         FROM dense d JOIN b USING (slide_id) LEFT JOIN cells c ON d.slide_id = c.slide_id AND d.cy = c.cy AND d.cx = c.cx)"""


@query("attention_to_grid", f"WITH {GRID} SELECT slide_id, cy, cx, round(value, 6) + 0.0 AS value FROM grid", "patches")
def attention_to_grid(spark, sf):
    return rounded(A.attention_to_grid(attention(spark, sf), 448), "value")


@query(
    "resize_nearest",
    f"""WITH {GRID}, t AS (SELECT slide_id, h, w, oy, unnest(range(0, 31)) AS ox FROM (SELECT slide_id, h + 1 AS h, w + 1 AS w, unnest(range(0, 17)) AS oy FROM shape) s)
        SELECT slide_id, CAST(oy AS INT) AS oy, CAST(ox AS INT) AS ox, round(value, 6) + 0.0 AS value
        FROM t JOIN grid USING (slide_id)
        WHERE cy = least(floor(oy * h / 17.0e0), h - 1) AND cx = least(floor(ox * w / 31.0e0), w - 1)""",
    "patches",
)
def resize_nearest(spark, sf):
    return rounded(A.resize_nearest(A.attention_to_grid(attention(spark, sf), 448), 17, 31), "value")


@query(
    "overlay_alpha",
    f"""WITH {GRID} SELECT slide_id, cy, cx, 0 AS r, 220 AS g, 255 AS b,
        CASE WHEN round(value, 9) < 0.15 THEN 0 ELSE CAST(floor(least(greatest(round(value, 9) * 255 * 0.55e0, 0), 255)) AS INT) END AS a FROM grid""",
    "patches",
)
def overlay_alpha(spark, sf):
    grid = A.attention_to_grid(attention(spark, sf), 448).withColumn("value", F.round("value", 9))
    return A.overlay_alpha(grid).select("slide_id", "cy", "cx", "r", "g", "b", "a")


@query(
    "attention_informative",
    f"""WITH {ONE_MAP}, r AS (SELECT slide_id, alpha / sum(alpha) OVER (PARTITION BY slide_id) AS a, count(*) OVER (PARTITION BY slide_id) AS n,
             row_number() OVER (PARTITION BY slide_id ORDER BY alpha DESC) AS rk FROM attn),
        s AS (SELECT slide_id, max(n) AS n_patches, sum(a) FILTER (WHERE rk <= greatest(floor(n / 100), 1)) * 100 AS top,
                     -sum(a * ln(a + 1e-12)) / ln(max(n)) AS ent FROM r GROUP BY slide_id)
        SELECT slide_id, n_patches, round(top, 6) + 0.0 AS top1_share, round(ent, 6) + 0.0 AS entropy_ratio, top >= 2.0 AS informative,
               CASE WHEN top >= 2.0 THEN 'concentrated' ELSE 'uniform' END AS reason FROM s""",
    "patches",
)
def attention_informative(spark, sf):
    return rounded(A.attention_informative(attention(spark, sf)), "top1_share", "entropy_ratio")


ENTROPY = """ent AS (SELECT avg(h) AS attn_entropy FROM (SELECT slide_id, k, -sum(alpha * ln(alpha + 1e-12)) / ln(greatest(count(*), 2)) AS h
                                                FROM maps GROUP BY slide_id, k) e)"""
DIVERSITY = """nrm AS (SELECT slide_id, k, sqrt(sum(alpha * alpha)) AS nrm FROM maps GROUP BY slide_id, k),
sim AS (SELECT a.slide_id, a.k AS ka, b.k AS kb, sum(a.alpha * b.alpha) AS ab FROM maps a JOIN maps b
        ON a.slide_id = b.slide_id AND a.patch_idx = b.patch_idx AND a.k < b.k GROUP BY 1, 2, 3),
div AS (SELECT avg(ab / (x.nrm * y.nrm)) AS diversity FROM sim JOIN nrm x ON x.slide_id = sim.slide_id AND x.k = ka
        JOIN nrm y ON y.slide_id = sim.slide_id AND y.k = kb)"""
KL = """kl AS (SELECT avg(kl) AS stabilisation FROM (SELECT slide_id, k, sum(greatest(target, 1e-8) * (ln(greatest(target, 1e-8)) - ln(greatest(alpha, 1e-8)))) AS kl
                     FROM maps JOIN anchor USING (slide_id, patch_idx, k) GROUP BY slide_id, k) q)"""


@query("attention_entropy", f"WITH {SOFTMAX}, {ENTROPY} SELECT round(attn_entropy, 6) + 0.0 AS attn_entropy FROM ent", "map_scores")
def attention_entropy(spark, sf):
    return rounded(A.attention_entropy(maps(spark, sf)), "attn_entropy")


@query("branch_diversity", f"WITH {SOFTMAX}, {DIVERSITY} SELECT round(diversity, 6) + 0.0 AS diversity FROM div", "map_scores")
def branch_diversity(spark, sf):
    return rounded(A.branch_diversity(maps(spark, sf)), "diversity")


def both_maps(spark, sf):
    soft = A.masked_softmax(tables(spark, sf, "map_scores")).withColumnRenamed("alpha", "pred")
    return A.normalised_sigmoid(soft).withColumnRenamed("alpha", "target")


@query("anchor_kl", f"WITH {SOFTMAX}, {SIG}, {KL} SELECT round(stabilisation, 6) + 0.0 AS stabilisation FROM kl", "map_scores")
def anchor_kl(spark, sf):
    return rounded(A.anchor_kl(both_maps(spark, sf)), "stabilisation")


@query(
    "loss_report",
    f"""WITH {SOFTMAX}, {SIG}, {ENTROPY}, {DIVERSITY}, {KL}, {CUM},
        corn AS (SELECT (avg(greatest(z0, 0) - z0 * (CASE WHEN y_true > 0 THEN 1 ELSE 0 END) + ln(1 + exp(-abs(z0))))
                  + avg(greatest(z1, 0) - z1 * (CASE WHEN y_true > 1 THEN 1 ELSE 0 END) + ln(1 + exp(-abs(z1)))) FILTER (WHERE y_true > 0)) / 2 AS corn FROM predictions),
        lp AS (SELECT y_true AS i, unnest([0, 1, 2]) AS j, unnest([p0, p1, p2]) AS p FROM probs),
        qn AS (SELECT sum((i - j) * (i - j) * p) / sum(p) AS num FROM lp),
        t AS (SELECT y_true AS i, count(*) AS t FROM predictions GROUP BY y_true), m AS (SELECT j, sum(p) AS m FROM lp GROUP BY j),
        qd AS (SELECT sum((i - j) * (i - j) * t * m) / sum(t * m) AS den FROM t, m),
        all_parts AS (SELECT corn, 0.5e0 * num / den AS qwk, stabilisation, 0.1e0 * diversity AS diversity, 0.25e0 * attn_entropy AS attn_entropy,
                             attn_entropy AS attn_entropy_raw FROM corn, qn, qd, ent, div, kl)
        SELECT round(corn, 6) + 0.0 AS corn, round(qwk, 6) + 0.0 AS qwk, round(stabilisation, 6) + 0.0 AS stabilisation,
               round(diversity, 6) + 0.0 AS diversity, round(attn_entropy, 6) + 0.0 AS attn_entropy, round(attn_entropy_raw, 6) + 0.0 AS attn_entropy_raw,
               round(corn + qwk + stabilisation + diversity + attn_entropy, 6) + 0.0 AS total FROM all_parts""",
    "map_scores predictions",
)
def loss_report(spark, sf):
    one = F.lit(1).alias("_one")
    preds = tables(spark, sf, "predictions").withColumn("logits", F.array("z0", "z1"))
    preds = prediction_record(preds.withColumn("cumulative", O.corn_cumulative("logits")))
    both = both_maps(spark, sf)
    pred = both.withColumnRenamed("pred", "alpha")
    parts = Ls.corn_loss(preds).select("*", one)
    for part in (Ls.soft_qwk_loss(preds), A.anchor_kl(both), A.branch_diversity(pred), A.attention_entropy(pred)):
        parts = parts.join(part.select("*", one), "_one")
    df = Ls.loss_report(parts, lambda_qwk=0.5, lambda_attn_entropy=0.25)
    return rounded(df, *df.columns)


@query(
    "pairwise_maps",
    f"""WITH {SOFTMAX} SELECT p.slide_id, p.k AS a, q.k AS b, count(*) AS n,
        round(sum(p.alpha * q.alpha) / sqrt(sum(p.alpha * p.alpha) * sum(q.alpha * q.alpha)), 6) + 0.0 AS cosine,
        round(corr(p.alpha, q.alpha), 6) + 0.0 AS correlation
        FROM maps p JOIN maps q ON p.slide_id = q.slide_id AND p.patch_idx = q.patch_idx AND p.k < q.k GROUP BY 1, 2, 3""",
    "map_scores",
)
def pairwise_maps(spark, sf):
    return rounded(A.pairwise_maps(maps(spark, sf)), "cosine", "correlation")


@query(
    "subspace_topk_overlap",
    """WITH top AS (SELECT slide_id, patch_idx, k FROM map_scores
              QUALIFY row_number() OVER (PARTITION BY slide_id, k ORDER BY score DESC, patch_idx) <= 30),
        n AS (SELECT slide_id, count(*) / 4 AS n FROM map_scores GROUP BY slide_id),
        pairs AS (SELECT a.slide_id, count(*) AS c FROM top a JOIN top b ON a.slide_id = b.slide_id AND a.patch_idx = b.patch_idx AND a.k < b.k GROUP BY 1)
        SELECT slide_id, round(coalesce(c, 0) / (30.0e0 * 6), 6) + 0.0 AS overlap, round(30.0e0 / n, 6) + 0.0 AS chance FROM n LEFT JOIN pairs USING (slide_id)""",
    "map_scores",
)
def subspace_topk_overlap(spark, sf):
    df = tables(spark, sf, "map_scores").withColumnRenamed("score", "alpha")
    return rounded(A.subspace_topk_overlap(df), "overlap", "chance")


@query(
    "gather_window",
    """WITH o AS (SELECT slide_id, patch_idx, features, unnest([0, 16, 32, 48]) AS offset_at FROM patches_vec),
            w AS (SELECT slide_id, patch_idx, offset_at, features, unnest(range(0, 24)) AS p FROM o)
       SELECT slide_id, patch_idx, offset_at, CAST(p AS INT) AS pos, round(features[((offset_at + p) % 64) + 1]::DOUBLE, 6) + 0.0 AS value FROM w""",
    "patches_vec",
)
def gather_window(spark, sf):
    offsets = F.array(*[F.lit(o) for o in V.window_offsets(64, 24, 16)])
    rows = vectors(spark, sf).withColumn("offset_at", F.explode(offsets))
    window = V.wrapped_slice(F.col("features"), F.col("offset_at"), 24)
    return rows.select("slide_id", "patch_idx", "offset_at", F.posexplode(window).alias("pos", "v")).select(
        "slide_id", "patch_idx", "offset_at", "pos", r6("v").alias("value")
    )


@query(
    "pick_offsets",
    """WITH o AS (SELECT slide_id, patch_idx, features, unnest([0, 16, 40]) AS offset_at FROM patches_vec)
       SELECT slide_id, patch_idx, offset_at, round(features[offset_at + 1]::DOUBLE, 6) + 0.0 AS first FROM o""",
    "patches_vec",
)
def pick_offsets(spark, sf):
    offsets = B.pick_offsets(V.window_offsets(64, 16, 8), 3)
    rows = vectors(spark, sf).withColumn("offset_at", F.explode(F.array(*map(F.lit, offsets))))
    window = V.wrapped_slice(F.col("features"), F.col("offset_at"), 16)
    return rows.select("slide_id", "patch_idx", "offset_at", r6(window[0]).alias("first"))


NORMED = f"""{LONG}, st AS (SELECT slide_id, patch_idx, avg(v) AS m, var_pop(v) AS s FROM long GROUP BY slide_id, patch_idx),
normed AS (SELECT slide_id, patch_idx, dim, (v - m) / sqrt(s + 1e-5) AS h FROM long JOIN st USING (slide_id, patch_idx))"""


@query("layer_norm", f"WITH {NORMED} SELECT slide_id, patch_idx, CAST(dim AS INT) AS dim, round(h, 5) + 0.0 AS value FROM normed", "patches_vec")
def layer_norm(spark, sf):
    rows = vectors(spark, sf).select("slide_id", "patch_idx", F.posexplode(V.layer_norm(F.col("features"))).alias("dim", "v"))
    return rows.select("slide_id", "patch_idx", "dim", (F.round("v", 5) + 0.0).alias("value"))


@query(
    "crop_index",
    """SELECT slide_id, patch_idx, CAST(floor((row_number() OVER (PARTITION BY slide_id ORDER BY patch_idx) - 1) / 10) AS BIGINT) AS crop,
       CAST(ceil(count(*) OVER (PARTITION BY slide_id) / 10) AS BIGINT) AS n_crops FROM patches""",
    "patches",
)
def crop_index(spark, sf):
    return B.crop_index(tables(spark, sf, "patches"), 10).select("slide_id", "patch_idx", "crop", "n_crops")


def u(seed, *keys):
    return f"CAST(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 8)) AS BIGINT) / 4294967296.0e0"


@query(
    "sample_subbag",
    f"""WITH d AS (SELECT slide_id, patch_idx, unnest([0, 1]) AS draw FROM patches)
        SELECT slide_id, draw, patch_idx FROM d
        QUALIFY row_number() OVER (PARTITION BY slide_id, draw ORDER BY {u('7', 'draw', 'slide_id', 'patch_idx')}, patch_idx) <= 256""",
    "patches",
)
def sample_subbag(spark, sf):
    return B.sample_subbag(tables(spark, sf, "patches"), 256, samples_per_slide=2, seed=7)


@query(
    "evaluation_bag",
    """SELECT slide_id, 0 AS draw, patch_idx FROM patches QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY patch_idx) <= 256""",
    "patches",
)
def evaluation_bag(spark, sf):
    return B.sample_subbag(tables(spark, sf, "patches"), 256, train=False)


@query(
    "balanced_sample",
    f"""WITH {MAJORITY}, sized AS (SELECT label, count(*) AS size, row_number() OVER (ORDER BY label) - 1 AS class_no, count(*) OVER () AS k FROM labelled GROUP BY label),
        members AS (SELECT patient_id, label, row_number() OVER (PARTITION BY label ORDER BY {u('7|order', 'patient_id')}, patient_id) - 1 AS pos FROM labelled),
        draws AS (SELECT id AS draw, {u('7|class', 'id')} AS u1, {u('7|member', 'id')} AS u2 FROM (SELECT unnest(range(0, (SELECT count(*) FROM labelled))) AS id) r)
        SELECT draw, patient_id, m.label FROM draws d JOIN sized s ON s.class_no = floor(d.u1 * s.k)
        JOIN members m ON m.label = s.label AND m.pos = floor(d.u2 * s.size)""",
    "raw_labels",
)
def balanced_sample(spark, sf):
    return B.balanced_sample(labels(spark, sf), seed=7)


MIX = f"""bags AS (SELECT slide_id, max(label) AS label, count(*) AS n FROM patches_vec GROUP BY slide_id),
ord AS (SELECT *, row_number() OVER (ORDER BY {u('3|pair', 'slide_id')}, slide_id) - 1 AS p, count(*) OVER () AS nb FROM bags),
pair AS (SELECT a.slide_id, a.label, b.slide_id AS partner, b.label AS partner_label, {u('3|mix', 'a.slide_id')} < 0.7 AS mixed,
                CASE WHEN {u('3|mix', 'a.slide_id')} < 0.7 THEN (a.slide_id % 7 + 1) / 8.0e0 ELSE 1 END AS lam
         FROM ord a JOIN ord b ON b.p = (a.p + 1) % a.nb),
slots AS (SELECT p.slide_id, v.patch_idx, v.slide_id AS source_slide FROM pair p JOIN patches_vec v ON v.slide_id = p.slide_id
          WHERE {u('3|slot', 'p.slide_id', 'v.patch_idx')} < lam
          UNION ALL SELECT p.slide_id, v.patch_idx, v.slide_id FROM pair p JOIN patches_vec v ON v.slide_id = p.partner
          WHERE mixed AND {u('3|slot', 'p.slide_id', 'v.patch_idx')} >= lam),
eff AS (SELECT p.*, CASE WHEN mixed THEN (SELECT avg(CASE WHEN s.source_slide = s.slide_id THEN 1.0e0 ELSE 0 END) FROM slots s WHERE s.slide_id = p.slide_id) ELSE 1 END AS lam_eff FROM pair p)"""


def mixed(spark, sf):
    rows = vectors(spark, sf).drop("features")
    lambdas = rows.groupBy("slide_id").agg(F.max((F.col("slide_id") % 7 + 1) / 8.0).alias("lam"))
    return B.bag_mixup(rows, prob=0.7, lambdas=lambdas, seed=3)


@query("bag_mixup", f"WITH {MIX} SELECT * FROM slots", "patches_vec")
def bag_mixup(spark, sf):
    return mixed(spark, sf)[0]


@query(
    "bag_mixup_targets",
    f"""WITH {MIX} SELECT slide_id, mixed, round(lam_eff, 6) + 0.0 AS lam_eff,
        round(lam_eff * (label > 0)::INT + (1 - lam_eff) * (partner_label > 0)::INT, 6) + 0.0 AS t0,
        round(lam_eff * (label > 1)::INT + (1 - lam_eff) * (partner_label > 1)::INT, 6) + 0.0 AS t1 FROM eff""",
    "patches_vec",
)
def bag_mixup_targets(spark, sf):
    t = mixed(spark, sf)[1]
    return t.select("slide_id", "mixed", r6("lam_eff").alias("lam_eff"), *[r6(F.col("cum_targets")[j]).alias(f"t{j}") for j in (0, 1)])


# Closed-form weights: w(layer, i, j, model) = ((31 i + 17 j + 7 layer + 3 model) mod 201 - 100) / 1000.
WINDOW, STRIDE, HIDDEN, BRANCHES = 24, 16, 8, 2


def fixture_weights(model, dim=64):
    def w(layer, rows, cols):
        i, j = np.arange(rows)[:, None], np.arange(cols)[None, :]
        return ((i * 31 + j * 17 + layer * 7 + model * 3) % 201 - 100) / 1000.0

    return S.Weights(w(0, WINDOW, HIDDEN) * 20, w(1, WINDOW, HIDDEN) * 20, w(2, HIDDEN, BRANCHES) * 20, w(3, dim, HIDDEN), w(4, HIDDEN, 2) * 20)


def gated_sql(model):
    def w(layer, i, j):
        return f"((({i}) * 31 + ({j}) * 17 + {layer * 7 + model * 3}) % 201 - 100) / 50.0e0"

    return f"""win{model} AS (SELECT slide_id, patch_idx, o.o AS offset_no, p.p, v FROM long JOIN (SELECT unnest([0, 1, 2, 3]) AS o) o ON TRUE
        JOIN (SELECT unnest(range(0, {WINDOW})) AS p) p ON dim = (o.o * {STRIDE} + p.p) % 64),
hid{model} AS (SELECT slide_id, patch_idx, offset_no, h, tanh(sum(v * {w(0, 'p', 'h')})) * (1 / (1 + exp(-sum(v * {w(1, 'p', 'h')})))) AS a
        FROM win{model}, (SELECT unnest(range(0, {HIDDEN})) AS h) hh GROUP BY 1, 2, 3, 4),
gated{model} AS (SELECT slide_id, patch_idx, offset_no, branch, sum(a * {w(2, 'h', 'branch')}) AS score
        FROM hid{model}, (SELECT unnest([0, 1]) AS branch) bb GROUP BY 1, 2, 3, 4)"""


@query(
    "gated_scores",
    f"WITH {LONG}, {gated_sql(0)} SELECT slide_id, patch_idx, CAST(offset_no AS INT) AS offset_no, branch, round(score, 6) + 0.0 AS score FROM gated0",
    "patches_vec",
)
def gated_scores(spark, sf):
    return rounded(S.gated_scores(vectors(spark, sf), fixture_weights(0), STRIDE), "score")


def sub_sql(model):
    return f"""{gated_sql(model)}, sa{model} AS (SELECT slide_id, patch_idx, offset_no, exp(score) / sum(exp(score)) OVER (PARTITION BY slide_id, offset_no, branch) AS a FROM gated{model}),
sub{model} AS (SELECT slide_id, patch_idx, offset_no AS k, avg(a) AS alpha FROM sa{model} GROUP BY 1, 2, 3)"""


@query(
    "patch_attention",
    f"""WITH {LONG}, {sub_sql(0)}, {sub_sql(1)},
        a AS (SELECT slide_id, patch_idx, alpha FROM sub0 UNION ALL SELECT slide_id, patch_idx, alpha FROM sub1)
        SELECT slide_id, patch_idx, round(avg(alpha), 9) + 0.0 AS alpha FROM a GROUP BY 1, 2""",
    "patches_vec",
)
def patch_attention(spark, sf):
    df = S.patch_attention(vectors(spark, sf), [fixture_weights(0), fixture_weights(1)], STRIDE)
    return df.drop("n").withColumn("alpha", F.round("alpha", 9) + 0.0)


@query(
    "slide_bags",
    f"""WITH {NORMED}, {sub_sql(0)}
        SELECT slide_id, CAST(k AS INT) AS offset_no, CAST(dim AS INT) AS dim, round(sum(alpha * h), 5) + 0.0 AS value
        FROM normed JOIN sub0 USING (slide_id, patch_idx) GROUP BY 1, 2, 3""",
    "patches_vec",
)
def slide_bags(spark, sf):
    df = S.slide_bags(vectors(spark, sf), [fixture_weights(0)], STRIDE)
    rows = df.select("slide_id", "offset_no", F.posexplode("bag").alias("dim", "v"))
    return rows.select("slide_id", "offset_no", "dim", (F.round("v", 5) + 0.0).alias("value"))


def head_sql(source, model, key):
    """Logits z0, z1 per ``key`` of a long (key, dim, v) source; erf by its power series."""

    def w(layer, i, j, scale):
        return f"((({i}) * 31 + ({j}) * 17 + {layer * 7 + model * 3}) % 201 - 100) / {scale}e0"

    erf = "1.1283791670955126e0 * list_sum(list_transform(range(0, 60), lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * pow(u / sqrt(2), 2 * n + 1) / (gamma(n + 1) * (2 * n + 1))))"
    return f"""u{model} AS (SELECT {key}, h, sum(v * {w(3, 'dim', 'h', 1000)}) AS u FROM {source}, (SELECT unnest(range(0, {HIDDEN})) AS h) hh GROUP BY ALL),
g{model} AS (SELECT {key}, h, 0.5e0 * u * (1 + {erf}) AS g FROM u{model}),
head{model} AS (SELECT {key}, {model} AS model, sum(g * {w(4, 'h', '0', 50)}) AS z0, sum(g * {w(4, 'h', '1', 50)}) AS z1 FROM g{model} GROUP BY {key})"""


def score_sql(*models):
    parts = [f"{NORMED}"]
    for m in models:
        parts.append(sub_sql(m))
        parts.append(f"bag{m} AS (SELECT slide_id, k, dim, sum(alpha * h) AS v FROM normed JOIN sub{m} USING (slide_id, patch_idx) GROUP BY ALL)")
        parts.append(head_sql(f"bag{m}", m, "slide_id, k"))
    heads = " UNION ALL ".join(f"SELECT slide_id, model, avg(z0) AS z0, avg(z1) AS z1 FROM head{m} GROUP BY slide_id, model" for m in models)
    return f"""{', '.join(parts)}, pm AS ({heads}),
pc AS (SELECT slide_id, 1 / (1 + exp(-z0)) AS c0, 1 / (1 + exp(-z0)) * (1 / (1 + exp(-z1))) AS c1 FROM pm),
en AS (SELECT slide_id, avg(c0) AS c0, avg(c1) AS c1, (stddev_samp(c0) + stddev_samp(c1)) / 2 AS spread_samp,
              (stddev_pop(c0) + stddev_pop(c1)) / 2 AS spread_pop FROM pc GROUP BY slide_id),
graded AS (SELECT *, CASE WHEN c0 > 0.5 THEN 1 ELSE 0 END + CASE WHEN c1 > 0.5 THEN 1 ELSE 0 END AS grade,
                  (c0 - c1) + 2 * c1 AS expected_grade, 0.5e0 - least(abs(c0 - 0.5), abs(c1 - 0.5)) AS ambiguity FROM en),
rec AS (SELECT *, CASE grade WHEN 0 THEN 1 - c0 WHEN 1 THEN c0 - c1 ELSE c1 END AS confidence FROM graded)"""


@query(
    "mlp_head",
    f"""WITH {LONG}, pooled AS (SELECT slide_id, dim, avg(v) AS v FROM long GROUP BY slide_id, dim), {head_sql('pooled', 0, 'slide_id')}
        SELECT slide_id, round(z0, 6) + 0.0 AS z0, round(z1, 6) + 0.0 AS z1 FROM head0""",
    "patches_vec",
)
def mlp_head(spark, sf):
    bags = A.mean_pool(vectors(spark, sf)).withColumn("model", F.lit(0))
    logits = S.mlp_head(bags, [fixture_weights(0)])
    return logits.select("slide_id", *[r6(F.col("logits")[j]).alias(f"z{j}") for j in range(2)])


@query(
    "score_slides",
    f"""WITH {score_sql(0, 1)} SELECT slide_id, CAST(grade AS INT) AS grade, round(expected_grade, 6) + 0.0 AS expected_grade,
        round(confidence, 6) + 0.0 AS confidence, round(ambiguity, 6) + 0.0 AS ambiguity, round(spread_samp, 6) + 0.0 AS spread_samp,
        round(spread_pop, 6) + 0.0 AS spread_pop, round(c0, 6) + 0.0 AS c0, round(c1, 6) + 0.0 AS c1 FROM rec""",
    "patches_vec",
)
def score_slides(spark, sf):
    df = S.score_slides(vectors(spark, sf), [fixture_weights(0), fixture_weights(1)], STRIDE)
    names = ["expected_grade", "confidence", "ambiguity", "spread_samp", "spread_pop"]
    return rounded(df, *names).select("slide_id", "grade", *names, *[r6(F.col("cumulative")[j]).alias(f"c{j}") for j in range(2)])


@query(
    "review_list",
    f"""WITH {score_sql(0, 1)},
        a AS (SELECT slide_id, patch_idx, avg(alpha) AS alpha FROM (SELECT * FROM sub0 UNION ALL SELECT * FROM sub1) s GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY alpha DESC, patch_idx) AS rank, count(*) OVER (PARTITION BY slide_id) AS n FROM a)
        SELECT slide_id, CAST(grade AS INT) AS grade, round(confidence, 6) + 0.0 AS confidence, round(ambiguity, 6) + 0.0 AS ambiguity,
               CAST(rank AS INT) AS rank, patch_idx, (patch_idx % 24) * 448 AS x, CAST(floor(patch_idx / 24) * 448 AS BIGINT) AS y,
               round(alpha, 9) + 0.0 AS attention, round(alpha * n, 6) + 0.0 AS share_of_slide
        FROM r JOIN rec USING (slide_id) WHERE rank <= 5""",
    "patches_vec",
)
def review_list(spark, sf):
    """Grade, confidence, ambiguity and the five patches to look at first, for every slide."""
    rows = vectors(spark, sf)
    models = [fixture_weights(0), fixture_weights(1)]
    graded = S.score_slides(rows, models, STRIDE).select("slide_id", "grade", "confidence", "ambiguity")
    attn = S.patch_attention(rows, models, STRIDE).withColumns(
        {"x": (F.col("patch_idx") % 24) * 448, "y": F.floor(F.col("patch_idx") / 24) * 448}
    )
    regions = A.top_regions(attn, 5).drop("size").withColumn("attention", F.round("attention", 9) + 0.0)
    return rounded(graded.join(regions, "slide_id"), "confidence", "ambiguity", "share_of_slide")


def audit_sql(model, arm):
    return f"""st{model} AS (SELECT slide_id, k, max(alpha) / avg(alpha) AS pk FROM sub{model} GROUP BY 1, 2),
co{model} AS (SELECT slide_id, avg(c) AS c FROM (SELECT p.slide_id, corr(p.alpha, q.alpha) AS c FROM sub{model} p JOIN sub{model} q
        ON p.slide_id = q.slide_id AND p.patch_idx = q.patch_idx AND p.k < q.k GROUP BY p.slide_id, p.k, q.k) z GROUP BY 1),
en{model} AS (SELECT slide_id, max(a) / avg(a) AS e FROM (SELECT slide_id, patch_idx, avg(alpha) AS a FROM sub{model} GROUP BY 1, 2) z GROUP BY 1),
arm{model} AS (SELECT '{arm}' AS arm, (SELECT count(*) FROM en{model}) AS n, (SELECT avg(m) FROM (SELECT avg(pk) AS m FROM st{model} GROUP BY slide_id) z) AS peakedness,
        (SELECT avg(c) FROM co{model}) AS correlation, (SELECT avg(e) FROM en{model}) AS ensembled)"""


@query(
    "attention_audit",
    f"""WITH {LONG}, {sub_sql(0)}, {sub_sql(7)}, {audit_sql(0, 'trained')}, {audit_sql(7, 'control')},
        arms AS (SELECT * FROM arm0 UNION ALL SELECT * FROM arm7)
        SELECT arm, n, round(peakedness, 6) + 0.0 AS peakedness, round(correlation, 6) + 0.0 AS correlation, round(ensembled, 6) + 0.0 AS ensembled,
               (SELECT peakedness FROM arm0) > (SELECT peakedness FROM arm7) AS more_peaked FROM arms""",
    "patches_vec",
)
def attention_audit(spark, sf):
    df = S.attention_audit(vectors(spark, sf), fixture_weights(0), fixture_weights(7), stride=STRIDE)
    return rounded(df, "peakedness", "correlation", "ensembled")

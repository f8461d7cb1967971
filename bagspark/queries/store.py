"""Feature store and cohort queries over embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from bagspark.operators import cohort as K
from bagspark.operators.bags import crop_index
from bagspark.queries.registry import query, r6, tables
from bagspark.session import scratch_path
from bagspark.sources import store as S
from bagspark.sources.layout import Layout, read_bucketed, write_bucketed

# Encoder number of a slide in the fixture: its position in the registry table.
def encoder_of():
    return F.element_at(F.array(*[F.lit(e[0]) for e in K.ENCODERS]), (F.col("slide_id") % 10 + 1).cast("int"))


REGISTRY = "registry(num, encoder, embed_dim, commercial_ok, pooling) AS (VALUES " + ", ".join(
    f"({i}, '{n}', {w}, {ok}, '{p}')" for i, (n, w, _, ok, _, _, p) in enumerate(K.ENCODERS)
) + ")"


def patches(spark, sf):
    return tables(spark, sf, "patches_vec")


def stored(spark, sf):
    path = scratch_path(spark, "features")
    rows = patches(spark, sf).withColumns(
        {
            "x": (F.col("patch_idx") % 24) * 448,
            "y": F.floor(F.col("patch_idx") / 24) * 448,
            "encoder": F.lit("h-optimus-0"),
            "pooling": F.when(F.col("label") == 0, "cls_mean").otherwise("cls"),
        }
    )
    S.write_features(rows, path)
    return path


def inventory(spark, sf):
    return S.slide_inventory(patches(spark, sf)).withColumn("encoder", encoder_of())


INVENTORY = f"""{REGISTRY}, inventory AS (
  SELECT slide_id, count(*) AS n_patches, CAST(max(len(features)) AS INT) AS width, max(r.encoder) AS encoder
  FROM patches_vec JOIN registry r ON slide_id % 10 = r.num GROUP BY slide_id)"""


@query(
    "write_features",
    """SELECT slide_id, patch_idx, CASE WHEN label = 0 THEN 'cls_mean' ELSE 'cls' END AS pooling,
       CAST(len(features) AS INT) AS width, round(list_sum(list_transform(features, lambda v: v::DOUBLE)), 6) + 0.0 AS total FROM patches_vec""",
    "patches_vec",
)
def write_features(spark, sf):
    total = F.aggregate(F.col("features").cast("array<double>"), F.lit(0.0), lambda a, v: a + v)
    return spark.read.parquet(stored(spark, sf)).select(
        "slide_id", "patch_idx", "pooling", F.size("features").alias("width"), r6(total).alias("total")
    )


@query(
    "read_features",
    """SELECT slide_id, patch_idx, (patch_idx % 24) * 448 AS x, CAST(floor(patch_idx / 24) * 448 AS BIGINT) AS y,
       round(features[1]::DOUBLE, 6) + 0.0 AS f0 FROM patches_vec WHERE label = 1 AND patch_idx >= 5""",
    "patches_vec",
)
def read_features(spark, sf):
    wanted = patches(spark, sf).where("label = 1 AND patch_idx >= 5")
    rows = S.read_features(spark, stored(spark, sf), wanted, with_coords=True)
    return rows.select("slide_id", "patch_idx", "x", "y", r6(F.col("features")[0]).alias("f0"))


@query(
    "prefer_source",
    """WITH a AS (SELECT slide_id, patch_idx, 0 AS priority FROM patches_vec WHERE label <> 1),
            b AS (SELECT slide_id, patch_idx, 1 AS priority FROM patches_vec WHERE label <> 2)
       SELECT * FROM a UNION ALL SELECT * FROM b WHERE slide_id NOT IN (SELECT slide_id FROM a)""",
    "patches_vec",
)
def prefer_source(spark, sf):
    rows = patches(spark, sf)
    keep = ["slide_id", "patch_idx", "priority"]
    return S.prefer_source([(rows.where("label <> 1"), 0), (rows.where("label <> 2"), 1)]).select(*keep)


LAYOUT = Layout(buckets=16, stretch=10)


def bucketed(spark, sf):
    """The vectors as a bucketed table under the shared folder."""
    path = scratch_path(spark, "bucketed")
    table = "bucketed_" + path.rpartition("-")[2]
    write_bucketed(patches(spark, sf), table, LAYOUT, path)
    return read_bucketed(spark, table)


@query(
    "bucketed_bags",
    """WITH slides AS (SELECT DISTINCT slide_id, label FROM patches_vec WHERE label <> 1),
            place AS (SELECT slide_id, patch_idx, row_number() OVER (PARTITION BY slide_id ORDER BY patch_idx) - 1 AS p, count(*) OVER (PARTITION BY slide_id) AS n FROM patches_vec)
       SELECT slide_id, patch_idx, label, CAST(floor(p / 7) AS BIGINT) AS crop, CAST(greatest(ceil(n / 7.0e0), 1) AS BIGINT) AS n_crops, round(features[1]::DOUBLE, 6) + 0.0 AS f0
       FROM patches_vec JOIN slides USING (slide_id, label) JOIN place USING (slide_id, patch_idx)""",
    "patches_vec",
)
def bucketed_bags(spark, sf):
    """Labels and crops joined to vectors that stay in their buckets."""
    rows = bucketed(spark, sf)
    slides = rows.where("label <> 1").select("slide_id", "label").distinct()
    bags = K.attach_bags(slides, slides, rows.drop("label"), LAYOUT)
    crops = crop_index(rows.drop("label"), 7, LAYOUT).select("slide_id", "patch_idx", "crop", "n_crops")
    return bags.join(crops, ["slide_id", "patch_idx"]).select("slide_id", "patch_idx", "label", "crop", "n_crops", r6(F.col("features")[0]).alias("f0"))


@query("slide_inventory", f"WITH {INVENTORY} SELECT * FROM inventory", "patches_vec")
def slide_inventory(spark, sf):
    rows = patches(spark, sf)
    provenance = rows.groupBy("slide_id").agg(F.lit(1).alias("_")).select("slide_id", encoder_of().alias("encoder"))
    return S.slide_inventory(rows, provenance)


@query(
    "store_inventory",
    """SELECT slide_id, count(*) AS n_patches, CAST(max(len(features)) AS INT) AS width, 'h-optimus-0' AS encoder,
              CASE WHEN label = 0 THEN 'cls_mean' ELSE 'cls' END AS pooling FROM patches_vec GROUP BY slide_id, label""",
    "patches_vec",
)
def store_inventory(spark, sf):
    """From the statistics written with the store."""
    return S.store_inventory(spark, stored(spark, sf))


@query(
    "verify_cohort",
    f"""WITH {INVENTORY}, asked AS (SELECT slide_id * 3 AS slide_id FROM inventory),
        j AS (SELECT a.slide_id, i.* EXCLUDE (slide_id), i.slide_id IS NULL AS gone FROM asked a LEFT JOIN inventory i USING (slide_id))
        SELECT count(*) FILTER (WHERE NOT gone) AS present, count(*) FILTER (WHERE gone) AS missing,
               count(DISTINCT width) AS n_widths, count(DISTINCT encoder) AS n_encoders,
               CAST(floor(median(n_patches)) AS BIGINT) AS median_patches, min(n_patches) AS min_patches,
               max(n_patches) AS max_patches, CAST(sum(n_patches) AS BIGINT) AS total_patches,
               (SELECT string_agg(slide_id, ',' ORDER BY slide_id) FROM (SELECT slide_id FROM j WHERE gone ORDER BY slide_id LIMIT 20) f) AS missing_first
        FROM j""",
    "patches_vec",
)
def verify_cohort(spark, sf):
    inv = inventory(spark, sf)
    return K.verify_cohort(inv.select((F.col("slide_id") * 3).alias("slide_id")), inv)


@query(
    "suggest_bag_size",
    """WITH n AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey)
       SELECT CAST(least(greatest(256, round_even(floor(median(n) / 2) / 256, 0) * 256), 4096) AS INT) AS bag_size FROM n""",
)
def suggest_bag_size(spark, sf):
    slides = tables(spark, sf, "patches").groupBy("slide_id").agg(F.count(F.lit(1)).alias("n_patches"))
    return K.suggest_bag_size(slides)


@query(
    "cohort_bytes",
    f"""WITH {INVENTORY} SELECT CAST(sum(n_patches * width * 4) AS BIGINT) AS bytes,
        sum(n_patches * width * 4) < 1e6 * 0.25 AS cache FROM inventory""",
    "patches_vec",
)
def cohort_bytes(spark, sf):
    return K.cohort_bytes(inventory(spark, sf), 1_000_000)


@query(
    "attach_bags",
    "SELECT slide_id, patch_idx, CAST(slide_id % 3 AS INT) AS label FROM patches_vec WHERE slide_id % 3 <> 0",
    "patches_vec",
)
def attach_bags(spark, sf):
    rows = patches(spark, sf)
    labels = rows.where("label <> 0").groupBy("slide_id").agg(F.max("label").cast("int").alias("label"))
    return K.attach_bags(labels, labels, rows.drop("label")).select("slide_id", "patch_idx", "label")


@query(
    "licence_gate",
    f"""WITH {REGISTRY}, used AS (SELECT coalesce(r.encoder, 'unlisted') AS encoder, r.commercial_ok AS ok
          FROM patches_vec LEFT JOIN registry r ON slide_id % 12 = r.num)
        SELECT encoder, count(*) AS n,
               CASE WHEN max(ok::INT) IS NULL THEN 'unknown' WHEN max(ok::INT) = 0 THEN 'blocked' ELSE 'ok' END AS status
        FROM used GROUP BY encoder""",
    "patches_vec",
)
def licence_gate(spark, sf):
    names = F.array(*[F.lit(e[0]) for e in K.ENCODERS])
    encoder = F.coalesce(F.get(names, (F.col("slide_id") % 12).cast("int")), F.lit("unlisted"))
    return K.licence_status(patches(spark, sf).withColumn("encoder", encoder), K.encoder_registry(spark))


@query(
    "expected_width",
    f"""WITH {INVENTORY} SELECT slide_id, encoder, width,
        CAST(CASE WHEN pooling = 'cls_mean' THEN embed_dim ELSE embed_dim * 2 END AS BIGINT) AS expected_width,
        CASE WHEN pooling = 'cls_mean' THEN embed_dim ELSE embed_dim * 2 END = width AS width_ok
        FROM inventory JOIN registry USING (encoder)""",
    "patches_vec",
)
def expected_width(spark, sf):
    df = K.expected_width(inventory(spark, sf), K.encoder_registry(spark), pooling="cls_mean")
    return df.select("slide_id", "encoder", "width", "expected_width", "width_ok")


@query(
    "normalise_pixels",
    """SELECT slide_id, y, x, round((r / 255 - 0.707223) / 0.211883, 6) + 0.0 AS r_norm,
       round((g / 255 - 0.578729) / 0.230117, 6) + 0.0 AS g_norm, round((b / 255 - 0.703617) / 0.177517, 6) + 0.0 AS b_norm
       FROM pixels""",
    "pixels",
)
def normalise_pixels(spark, sf):
    df = K.normalise_pixels(tables(spark, sf, "pixels"), K.encoder_registry(spark), "h-optimus-0")
    return df.select("slide_id", "y", "x", *[r6(f"{c}_norm").alias(f"{c}_norm") for c in "rgb"])


@query(
    "cls_mean_pool",
    """WITH long AS (SELECT tile_id, token, unnest(features)::DOUBLE AS v, generate_subscripts(features, 1) - 1 AS dim FROM tokens)
       SELECT tile_id, CAST(dim AS INT) AS dim, round(max(v) FILTER (WHERE token = 0), 6) + 0.0 AS value FROM long GROUP BY tile_id, dim
       UNION ALL
       SELECT tile_id, CAST(dim + 64 AS INT), round(avg(v) FILTER (WHERE token > 0), 6) + 0.0 FROM long GROUP BY tile_id, dim""",
    "tokens",
)
def cls_mean_pool(spark, sf):
    df = K.cls_mean_pool(tables(spark, sf, "tokens"))
    return df.select("tile_id", F.posexplode("features").alias("dim", "v")).select("tile_id", "dim", r6("v").alias("value"))


def _mean_std_encoder():
    """A two-number stand-in encoder: mean and deviation of each tile."""
    return lambda batch: np.stack([batch.mean(axis=1), batch.std(axis=1)], axis=1)


@query(
    "encode_tiles",
    """WITH long AS (SELECT slide_id, patch_idx, unnest(features)::DOUBLE AS v FROM patches_vec)
       SELECT slide_id, patch_idx, round(avg(v), 4) + 0.0 AS mean, round(stddev_pop(v), 4) + 0.0 AS std
       FROM long GROUP BY slide_id, patch_idx""",
    "patches_vec",
)
def encode_tiles(spark, sf):
    tiles = patches(spark, sf).select("slide_id", "patch_idx", F.col("features").cast("array<double>").alias("pixels"))
    out = K.encode_tiles(tiles, _mean_std_encoder, width=2)
    return out.select(
        "slide_id", "patch_idx",
        (F.round(F.col("features")[0].cast("double"), 4) + 0.0).alias("mean"),
        (F.round(F.col("features")[1].cast("double"), 4) + 0.0).alias("std"),
    )

"""Geometry over part, pixels over lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from bagspark.operators import tiles as T
from bagspark.operators import tissue as Ti
from bagspark.plans.tiling import build_tiles as build
from bagspark.queries.registry import query, rounded, tables
from bagspark.session import materialise

THUMB = 24


def geometry(spark, sf):
    rows = tables(spark, sf, "geometry")
    names = {"openslide.mpp-x": "mpp_prop", T.UNIT_KEY: "tiff_unit", T.RESOLUTION_KEY: "tiff_xres"}
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in names.items()])
    return rows.select(
        "slide_id", "w0", "h0", F.array(F.lit(1.0), F.lit(4.0), F.lit(16.0)).alias("level_downsamples"),
        F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())).alias("props"),
    )


def pixels(spark, sf):
    """The pixel table, written once: masks read it several times."""
    return materialise(tables(spark, sf, "pixels"), "pixels")


def sized(spark, sf, thumbnail_px=2048):
    return T.tile_geometry(T.pick_level(T.resolve_mpp(geometry(spark, sf))), thumbnail_px=thumbnail_px)


def geo_sql(thumb=2048):
    return f"""mpp AS (SELECT *, coalesce(CASE WHEN TRY_CAST(mpp_prop AS DOUBLE) > 0 THEN TRY_CAST(mpp_prop AS DOUBLE) END,
      CASE WHEN tiff_unit = 'centimeter' THEN 10000.0e0 / TRY_CAST(tiff_xres AS DOUBLE) WHEN tiff_unit = 'inch' THEN 25400.0e0 / TRY_CAST(tiff_xres AS DOUBLE) END, 0.25e0) AS base_mpp FROM geometry),
lev AS (SELECT *, CASE WHEN base_mpp * 16 <= 0.500001e0 THEN 2 WHEN base_mpp * 4 <= 0.500001e0 THEN 1 ELSE 0 END AS level FROM mpp),
sca AS (SELECT *, CASE level WHEN 2 THEN 16 WHEN 1 THEN 4 ELSE 1 END AS ds, 0.5e0 / (base_mpp * CASE level WHEN 2 THEN 16 WHEN 1 THEN 4 ELSE 1 END) AS scale FROM lev),
rd AS (SELECT *, CAST(greatest(1, round_even(224 * scale, 0)) AS INT) AS read_px, least({thumb}.0e0 / greatest(w0, h0), 1.0e0) AS thumb_ratio FROM sca),
geo AS (SELECT *, CAST(round_even(read_px * ds, 0) AS INT) AS level0_px, CAST(greatest(1, floor(w0 * thumb_ratio)) AS INT) AS thumb_w,
               CAST(greatest(1, floor(h0 * thumb_ratio)) AS INT) AS thumb_h FROM rd),
tiles AS (SELECT slide_id, iy * nx + ix AS tile_idx, ix * level0_px AS x, iy * level0_px AS y, level, read_px, level0_px, thumb_ratio, thumb_w, thumb_h
          FROM (SELECT *, unnest(range(0, nx)) AS ix FROM (SELECT *, unnest(range(0, CAST(greatest(floor((h0 - level0_px) / level0_px) + 1, 1) AS BIGINT))) AS iy,
                CAST(greatest(floor((w0 - level0_px) / level0_px) + 1, 1) AS BIGINT) AS nx FROM geo) a) b)"""


HSV = """h0 AS (SELECT *, greatest(r, g, b) AS mx, greatest(r, g, b) / 255.0e0 - least(r, g, b) / 255.0e0 AS diff FROM pixels),
hsv AS (SELECT slide_id, y, x, CASE WHEN diff <= 1e-8 THEN 0 WHEN r = mx THEN ((g / 255.0e0 - b / 255.0e0) / diff + CASE WHEN g < b THEN 6 ELSE 0 END)
               WHEN g = mx THEN (b / 255.0e0 - r / 255.0e0) / diff + 2 ELSE (r / 255.0e0 - g / 255.0e0) / diff + 4 END / 6 AS hue,
               CASE WHEN mx > 0 THEN diff / (mx / 255.0e0) ELSE 0 END AS sat, mx / 255.0e0 AS val FROM h0)"""
PEN = "(hue > 0.20 AND hue < 0.45 AND sat > 0.35) OR (hue > 0.50 AND hue < 0.75 AND sat > 0.35) OR val < 0.18"
OTSU = f"""{HSV}, rng AS (SELECT slide_id, min(sat) AS lo, max(sat) AS hi FROM hsv GROUP BY slide_id),
bn AS (SELECT slide_id, lo, hi, CAST(least(floor((sat - lo) / (hi - lo) * 256), 255) AS INT) AS bin FROM hsv JOIN rng USING (slide_id)),
hi AS (SELECT slide_id, lo, hi, bin, count(*) AS c, lo + (bin + 0.5e0) * (hi - lo) / 256 AS ctr FROM bn GROUP BY 1, 2, 3, 4),
cu AS (SELECT *, sum(c) OVER w AS w0, sum(c * ctr) OVER w AS m0, sum(c) OVER (PARTITION BY slide_id) AS wt, sum(c * ctr) OVER (PARTITION BY slide_id) AS mt
       FROM hi WINDOW w AS (PARTITION BY slide_id ORDER BY bin)),
bt AS (SELECT *, w0 * (wt - w0) * (m0 / w0 - (mt - m0) / (wt - w0)) * (m0 / w0 - (mt - m0) / (wt - w0)) AS between_var FROM cu WHERE wt > w0),
otsu AS (SELECT slide_id, ctr AS threshold FROM bt QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY between_var DESC, bin) = 1)"""
MASK = f"""{OTSU}, raw AS (SELECT h.*, sat > greatest(threshold, 0.05) AND val < 0.96 AND val > 0.05 AS raw_tissue FROM hsv h JOIN otsu USING (slide_id)),
px AS (SELECT slide_id, y, x, y * 100000 + x AS id FROM raw WHERE raw_tissue),
nb AS (SELECT a.slide_id, a.id AS a, b.id AS b FROM px a JOIN px b ON a.slide_id = b.slide_id
       AND ((b.y = a.y AND b.x = a.x + 1) OR (b.x = a.x AND b.y = a.y + 1))),
nbr AS (SELECT slide_id, a, b FROM nb UNION ALL SELECT slide_id, b, a FROM nb),
reach AS (SELECT slide_id, id, id AS root FROM px UNION SELECT r.slide_id, e.b, r.root FROM reach r JOIN nbr e ON e.slide_id = r.slide_id AND e.a = r.id),
roots AS (SELECT slide_id, id, min(root) AS root FROM reach GROUP BY slide_id, id),
big AS (SELECT slide_id, root FROM roots GROUP BY slide_id, root
        HAVING count(*) >= greatest(16, (SELECT floor(count(*) / 20000) FROM pixels p WHERE p.slide_id = roots.slide_id))),
kept AS (SELECT slide_id, id FROM roots JOIN big USING (slide_id, root)),
mask AS (SELECT raw.*, k.id IS NOT NULL AS tissue, k.id IS NOT NULL AND NOT ({PEN}) AS keep
         FROM raw LEFT JOIN kept k ON k.slide_id = raw.slide_id AND k.id = y * 100000 + x)"""


def joined_sql(mask):
    return f"""side AS (SELECT *, CAST(greatest(1, round_even(level0_px * thumb_ratio, 0)) AS INT) AS tw, CAST(floor(x * thumb_ratio) AS INT) AS tx,
      CAST(floor(y * thumb_ratio) AS INT) AS ty FROM tiles),
wy AS (SELECT slide_id, tile_idx, tx, tw, thumb_w, unnest(range(ty, least(ty + tw, thumb_h))) AS py FROM side),
wx AS (SELECT slide_id, tile_idx, py, unnest(range(tx, least(tx + tw, thumb_w))) AS pxl FROM wy),
joined AS (SELECT w.slide_id, w.tile_idx, CAST(w.py AS INT) AS y, CAST(w.pxl AS INT) AS x, coalesce(m.keep, FALSE) AS keep
           FROM wx w LEFT JOIN {mask} m ON m.slide_id = w.slide_id AND m.y = w.py AND m.x = w.pxl)"""


@query("resolve_mpp", f"WITH {geo_sql()} SELECT slide_id, round(base_mpp, 6) + 0.0 AS base_mpp FROM geo", "geometry")
def resolve_mpp(spark, sf):
    return rounded(T.resolve_mpp(geometry(spark, sf)), "base_mpp").select("slide_id", "base_mpp")


@query("pick_level", f"WITH {geo_sql()} SELECT slide_id, level, round(scale, 6) + 0.0 AS scale FROM geo", "geometry")
def pick_level(spark, sf):
    return rounded(T.pick_level(T.resolve_mpp(geometry(spark, sf))), "scale").select("slide_id", "level", "scale")


@query(
    "tile_geometry",
    f"WITH {geo_sql()} SELECT slide_id, read_px, level0_px, round(thumb_ratio, 6) + 0.0 AS thumb_ratio, thumb_w, thumb_h FROM geo",
    "geometry",
)
def tile_geometry(spark, sf):
    return rounded(sized(spark, sf), "thumb_ratio").select("slide_id", "read_px", "level0_px", "thumb_ratio", "thumb_w", "thumb_h")


@query("tile_grid", f"WITH {geo_sql()} SELECT slide_id, tile_idx, x, y, level, read_px, level0_px FROM tiles", "geometry")
def tile_grid(spark, sf):
    return T.tile_grid(sized(spark, sf)).drop("thumb_ratio", "thumb_w", "thumb_h")


@query("rgb_to_hsv", f"WITH {HSV} SELECT slide_id, y, x, round(hue, 6) + 0.0 AS hue, round(sat, 6) + 0.0 AS sat, round(val, 6) + 0.0 AS val FROM hsv", "pixels")
def rgb_to_hsv(spark, sf):
    return rounded(Ti.rgb_to_hsv(tables(spark, sf, "pixels")), "hue", "sat", "val").drop("r", "g", "b")


@query("pen_mask", f"WITH {HSV} SELECT slide_id, y, x, ({PEN}) AS pen FROM hsv", "pixels")
def pen_mask(spark, sf):
    return Ti.pen_mask(tables(spark, sf, "pixels")).select("slide_id", "y", "x", "pen")


@query("otsu_threshold", f"WITH {OTSU} SELECT slide_id, round(threshold, 6) + 0.0 AS threshold FROM otsu", "pixels")
def otsu_threshold(spark, sf):
    hsv = Ti.rgb_to_hsv(pixels(spark, sf))
    return rounded(Ti.otsu_threshold(hsv, value="sat", spread=["y", "x"]), "threshold")


@query("tissue_mask", f"WITH RECURSIVE {MASK} SELECT slide_id, y, x, tissue FROM mask", "pixels")
def tissue_mask(spark, sf):
    return Ti.tissue_mask(pixels(spark, sf)).select("slide_id", "y", "x", "tissue")


@query("tile_pixel_join", f"WITH {geo_sql(THUMB)}, {HSV}, pens AS (SELECT slide_id, y, x, ({PEN}) AS keep FROM hsv), {joined_sql('pens')} SELECT * FROM joined", "geometry pixels")
def tile_pixel_join(spark, sf):
    mask = Ti.pen_mask(tables(spark, sf, "pixels")).withColumnRenamed("pen", "keep")
    return T.tile_pixel_join(T.tile_grid(sized(spark, sf, THUMB)), mask)


@query(
    "tissue_fraction",
    f"""WITH {geo_sql(THUMB)}, {HSV}, pens AS (SELECT slide_id, y, x, ({PEN}) AS keep FROM hsv), {joined_sql('pens')}
        SELECT slide_id, tile_idx, round(avg(keep::INT), 6) + 0.0 AS fraction, avg(keep::INT) >= 0.35 AS kept FROM joined GROUP BY 1, 2""",
    "geometry pixels",
)
def tissue_fraction(spark, sf):
    return rounded(T.tissue_fraction(tile_pixel_join(spark, sf)), "fraction")


@query(
    "tile_tissue",
    f"""WITH {geo_sql(THUMB)}, {HSV}, pens AS (SELECT slide_id, y, x, ({PEN}) AS keep FROM hsv), {joined_sql('pens')}
        SELECT slide_id, tile_idx, round(avg(keep::INT), 6) + 0.0 AS fraction, avg(keep::INT) >= 0.35 AS kept FROM joined GROUP BY 1, 2""",
    "geometry pixels",
)
def tile_tissue(spark, sf):
    mask = Ti.pen_mask(pixels(spark, sf)).withColumnRenamed("pen", "keep")
    return rounded(T.tile_tissue(sized(spark, sf, THUMB), mask), "fraction")


def cap_sql(n):
    key = "md5(concat_ws('|', '11', slide_id, tile_idx))"
    return f"row_number() OVER (PARTITION BY slide_id ORDER BY CAST(('0x' || substr({key}, 1, 8)) AS BIGINT), tile_idx) <= {n}"


@query("cap_patches", f"WITH {geo_sql()} SELECT slide_id, tile_idx, x, y FROM tiles QUALIFY {cap_sql(20)}", "geometry")
def cap_patches(spark, sf):
    return T.cap_patches(T.tile_grid(sized(spark, sf)), 20, seed=11).select("slide_id", "tile_idx", "x", "y")


@query(
    "build_tiles",
    f"""WITH RECURSIVE {geo_sql(THUMB)}, {MASK}, {joined_sql('mask')},
        share AS (SELECT slide_id, tile_idx, avg(keep::INT) AS fraction FROM joined GROUP BY 1, 2)
        SELECT slide_id, tile_idx, x, y, level, read_px, level0_px, round(fraction, 6) + 0.0 AS fraction
        FROM tiles JOIN share USING (slide_id, tile_idx) WHERE fraction >= 0.25 QUALIFY {cap_sql(6)}""",
    "geometry pixels",
)
def build_tiles(spark, sf):
    df = build(geometry(spark, sf), pixels(spark, sf), tissue_frac=0.25, max_patches=6, seed=11, thumbnail_px=THUMB)
    return rounded(df, "fraction")

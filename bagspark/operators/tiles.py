"""Slide geometry and tile grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagspark.functions.hashing import hash_uniform
from bagspark.skew import attach_stats, smallest_by_hash

# Property keys in order of preference, and pixel units in micrometres.
MPP_KEYS = ("openslide.mpp-x", "aperio.MPP")
UNIT_KEY, RESOLUTION_KEY = "tiff.ResolutionUnit", "tiff.XResolution"
UNITS = {"centimeter": 10_000.0, "inch": 25_400.0}
DEFAULT_MPP = 0.25


def _positive(text: Column) -> Column:
    """The number in a text property when it is one and above zero, else null."""
    v = text.try_cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (v > 0), v)


def resolve_mpp(geom: DataFrame, fallback: float | None = DEFAULT_MPP) -> DataFrame:
    """Adds ``base_mpp`` from the ``props`` map; without ``fallback`` a slide lacking it is an error."""
    props = F.col("props")
    unit = F.lower(F.coalesce(F.try_element_at(props, F.lit(UNIT_KEY)), F.lit("")))
    res = _positive(F.try_element_at(props, F.lit(RESOLUTION_KEY)))
    from_tiff = F.lit(None).cast("double")
    for name, scale in UNITS.items():
        from_tiff = F.when(unit == name, F.lit(scale) / res).otherwise(from_tiff)
    last = (
        F.lit(float(fallback)) if fallback is not None
        else F.raise_error(F.concat(F.lit("no resolution metadata for slide "), F.col("slide_id").cast("string"))).cast("double")
    )
    stated = [_positive(F.try_element_at(props, F.lit(k))) for k in MPP_KEYS]
    return geom.withColumn("base_mpp", F.coalesce(*stated, from_tiff, last))


def pick_level(geom: DataFrame, target_mpp: float = 0.5) -> DataFrame:
    """Adds ``level`` (the last one not coarser than the target) and ``scale`` = target / level mpp."""
    downs = F.col("level_downsamples")
    fits = F.filter(
        F.sequence(F.lit(0), F.size(downs) - 1),
        lambda i: F.col("base_mpp") * F.get(downs, i) <= F.lit(target_mpp + 1e-6),
    )
    found = F.array_max(fits)
    level_mpp = F.when(found.isNull(), F.col("base_mpp")).otherwise(F.col("base_mpp") * F.get(downs, found))
    return geom.withColumns({"level": F.coalesce(found, F.lit(0)), "scale": F.lit(target_mpp) / level_mpp})


def tile_geometry(
    geom: DataFrame, out_px: int = 224, target_mpp: float = 0.5, thumbnail_px: int = 2048
) -> DataFrame:
    """Adds read_px, level0_px (both half-to-even), thumb_ratio, thumb_w, thumb_h."""
    if "level" not in geom.columns:
        geom = pick_level(geom, target_mpp)
    read = F.greatest(F.lit(1), F.bround(F.lit(float(out_px)) * F.col("scale")).cast("int"))
    geom = geom.withColumn("read_px", read)
    step = F.bround(F.col("read_px") * F.get("level_downsamples", F.col("level"))).cast("int")
    ratio = F.least(F.lit(float(thumbnail_px)) / F.greatest("w0", "h0"), F.lit(1.0))
    geom = geom.withColumns({"level0_px": step, "thumb_ratio": ratio})
    return geom.withColumns(
        {
            f"thumb_{n}": F.greatest(F.lit(1), F.floor(F.col(f"{n}0") * F.col("thumb_ratio")).cast("int"))
            for n in ("w", "h")
        }
    )


def sized_grid(geom: DataFrame) -> DataFrame:
    """Adds the number of tile columns ``_nx`` and rows ``_ny``."""
    step = F.greatest("level0_px", F.lit(1))

    def count(size: str) -> Column:
        return F.greatest(F.floor((F.col(size) - step) / step) + 1, F.lit(1))

    return geom.withColumns({"_nx": count("w0"), "_ny": count("h0")})


STRIPE_TILES, TASK_TILES = 100_000, 1_000_000
"""About so many tiles are listed from one row of geometry, and by one task."""


def tile_grid(geom: DataFrame) -> DataFrame:
    """One row per non-overlapping tile that lies fully inside, at least one per slide.

    A small table of slides lists many tiles, so slides, and stripes of large ones, are dealt to tasks by the number of tiles first.
    """
    step = F.greatest("level0_px", F.lit(1))
    sized = sized_grid(geom)
    deep = F.greatest(F.floor(F.lit(STRIPE_TILES) / F.col("_nx")), F.lit(1))
    cut = sized.withColumn("_rows", deep).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_ny") - 1, F.col("_rows"))))
    n_tiles = sized.agg(F.sum(F.col("_nx") * F.col("_ny"))).first()[0] or 0
    parallel = geom.sparkSession.sparkContext.defaultParallelism
    dealt = cut.repartition(max(parallel, -(-n_tiles // TASK_TILES)), "slide_id", "_from") if n_tiles > TASK_TILES else cut
    last = F.least(F.col("_from") + F.col("_rows"), F.col("_ny")) - 1
    rows = dealt.withColumn("_iy", F.explode(F.sequence(F.col("_from"), last)))
    cells = rows.withColumn("_ix", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_nx") - 1)))
    return cells.select(
        "slide_id", (F.col("_iy") * F.col("_nx") + F.col("_ix")).alias("tile_idx"),
        (F.col("_ix") * step).alias("x"), (F.col("_iy") * step).alias("y"),
        "level", "read_px", "level0_px", "thumb_ratio", "thumb_w", "thumb_h",
    )


BLOCK = 64
"""Side of the blocks of a mask: one word of bits per line of a block."""


def mask_blocks(mask: DataFrame) -> DataFrame:
    """(slide_id, _by, _bx, _lines): the kept pixels of each block of 64 x 64, as a map from line to a word of bits."""
    bit = F.expr(f"shiftleft(1L, cast(pmod(x, {BLOCK}) AS int))")
    words = mask.where("keep").groupBy("slide_id", F.col("y").cast("bigint").alias("_y"), F.floor(F.col("x") / BLOCK).alias("_bx")).agg(
        F.bit_or(bit).alias("_word")
    )
    lines = F.map_from_entries(F.collect_list(F.struct("_y", "_word")))
    return words.groupBy("slide_id", F.floor(F.col("_y") / BLOCK).alias("_by"), "_bx").agg(lines.alias("_lines"))


def tile_pixel_join(tiles: DataFrame, mask: DataFrame) -> DataFrame:
    """(slide_id, tile_idx, y, x, keep): every thumbnail pixel under a tile with its mask value.

    Each tile has a pixel window (at least one pixel, clipped to the thumbnail) and is joined with the blocks of the mask
    that it touches; pixels are listed after the join. Pixels without a mask row count as not kept.
    """
    last = {n: F.least(_start(F.col(n)) + _side(), F.col(f"thumb_{s}")) - 1 for n, s in (("x", "w"), ("y", "h"))}
    windows = tiles.select(
        "slide_id", "tile_idx", *[_start(F.col(n)).alias(f"_{n}0") for n in "xy"], *[last[n].alias(f"_{n}1") for n in "xy"]
    ).where("_x0 <= _x1 AND _y0 <= _y1")
    for n in "yx":
        at = F.sequence(F.floor(F.col(f"_{n}0") / BLOCK), F.floor(F.col(f"_{n}1") / BLOCK))
        windows = windows.withColumn(f"_b{n}", F.explode(at))
    met = windows.join(mask_blocks(mask), ["slide_id", "_by", "_bx"], "left")

    def pixels(n: str) -> Column:
        lo = F.greatest(F.col(f"_{n}0").cast("bigint"), F.col(f"_b{n}") * BLOCK)
        hi = F.least(F.col(f"_{n}1").cast("bigint"), F.col(f"_b{n}") * BLOCK + (BLOCK - 1))
        return F.sequence(lo, hi)

    lines = met.select("slide_id", "tile_idx", pixels("x").alias("_xs"), "_lines", F.explode(pixels("y")).alias("y"))
    lines = lines.select("slide_id", "tile_idx", "y", "_xs", F.coalesce(F.try_element_at("_lines", F.col("y")), F.lit(0)).alias("_word"))
    cells = lines.select("slide_id", "tile_idx", "y", "_word", F.explode("_xs").alias("x"))
    return cells.select(
        "slide_id", "tile_idx", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"),
        F.getbit("_word", F.pmod("x", F.lit(BLOCK)).cast("int")).cast("boolean").alias("keep"),
    )


def tissue_fraction(joined: DataFrame, tissue_frac: float = 0.35) -> DataFrame:
    """(slide_id, tile_idx, fraction, kept): share of kept pixels per tile."""
    share = joined.groupBy("slide_id", "tile_idx").agg(
        F.avg(F.col("keep").cast("double")).alias("fraction")
    )
    return share.withColumn("kept", F.col("fraction") >= tissue_frac)


def _side() -> Column:
    """Thumbnail pixels along the footprint of a tile."""
    return F.greatest(F.lit(1), F.bround(F.col("level0_px") * F.col("thumb_ratio")).cast("int"))


def _start(at: Column) -> Column:
    return F.floor(at * F.col("thumb_ratio")).cast("int")


def _window_area() -> Column:
    """Thumbnail pixels under the tile at (x, y), clipped to the thumbnail."""

    def extent(at: str, limit: str) -> Column:
        return F.greatest(F.least(_start(F.col(at)) + _side(), F.col(limit)) - _start(F.col(at)), F.lit(0))

    return extent("x", "thumb_w") * extent("y", "thumb_h")


def kept_per_tile(geom: DataFrame, mask: DataFrame) -> DataFrame:
    """(slide_id, tile_idx, n_kept) of the tiles with at least one kept pixel.

    A pixel knows the tiles it falls under from the slide's step and ratio, so pixels are neither
    joined with tiles nor shuffled before they are counted.
    """
    kept_pixels = mask.where("keep").select("slide_id", "y", "x")
    sizes = kept_pixels.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n"))
    shape = sized_grid(geom).join(sizes, "slide_id").select(
        "slide_id", "n", "_nx", "_ny", "thumb_w", "thumb_h", "thumb_ratio", _side().alias("_side"),
        F.greatest("level0_px", F.lit(1)).alias("_step"),
    )
    rows = attach_stats(kept_pixels, shape, ["slide_id"], ["y", "x"]).where("y < thumb_h AND x < thumb_w")

    def candidates(pixel: str, count: str) -> Column:
        pitch = F.col("_step") * F.col("thumb_ratio")
        lo = F.greatest(F.floor((F.col(pixel) - F.col("_side")) / pitch), F.lit(0))
        hi = F.least(F.floor((F.col(pixel) + 1) / pitch), F.col(count) - 1)
        return F.filter(
            F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>")),
            lambda i: (_start(i * F.col("_step")) <= F.col(pixel)) & (F.col(pixel) < _start(i * F.col("_step")) + F.col("_side")),
        )

    hits = rows.select("slide_id", "_nx", candidates("x", "_nx").alias("_xs"), F.explode(candidates("y", "_ny")).alias("_iy"))
    hits = hits.select("slide_id", "_nx", "_iy", F.explode("_xs").alias("_ix"))
    return hits.groupBy("slide_id", (F.col("_iy") * F.col("_nx") + F.col("_ix")).alias("tile_idx")).agg(
        F.count(F.lit(1)).alias("n_kept")
    )


def tile_tissue(geom: DataFrame, mask: DataFrame, tissue_frac: float = 0.35) -> DataFrame:
    """The same (slide_id, tile_idx, fraction, kept) for all tiles, computed from the kept pixels alone."""
    sized = tile_grid(geom).select("slide_id", "tile_idx", _window_area().alias("_area")).where("_area > 0")
    share = F.coalesce("n_kept", F.lit(0)) / F.col("_area")
    return sized.join(kept_per_tile(geom, mask), ["slide_id", "tile_idx"], "left").select(
        "slide_id", "tile_idx", share.alias("fraction"), (share >= tissue_frac).alias("kept")
    )


TILE_COLUMNS = ["slide_id", "tile_idx", "x", "y", "level", "read_px", "level0_px", "fraction"]


def tissue_tiles(geom: DataFrame, mask: DataFrame, tissue_frac: float = 0.35) -> DataFrame:
    """Tiles with at least ``tissue_frac`` kept pixels, with position and fraction.

    Above zero only tiles with kept pixels qualify, and their position follows from the index, so
    the grid is never listed.
    """
    if tissue_frac <= 0:
        share = tile_tissue(geom, mask, tissue_frac).where("kept")
        return tile_grid(geom).join(share, ["slide_id", "tile_idx"]).select(*TILE_COLUMNS)
    grid = sized_grid(geom).withColumn("n", F.col("_nx") * F.col("_ny"))
    step = F.greatest("level0_px", F.lit(1))
    placed = attach_stats(kept_per_tile(geom, mask), grid, ["slide_id"], ["tile_idx"]).withColumns(
        {"x": F.col("tile_idx") % F.col("_nx") * step, "y": F.floor(F.col("tile_idx") / F.col("_nx")) * step}
    )
    return placed.withColumn("fraction", F.col("n_kept") / _window_area()).where(F.col("fraction") >= tissue_frac).select(*TILE_COLUMNS)


def cap_patches(tiles: DataFrame, max_patches: int, seed: int = 0) -> DataFrame:
    """At most ``max_patches`` tiles per slide: a seeded uniform subset."""
    keyed = tiles.withColumn("_u", hash_uniform(seed, "slide_id", "tile_idx"))
    return smallest_by_hash(keyed, ["slide_id"], "_u", max_patches, ["tile_idx"]).drop("_u")

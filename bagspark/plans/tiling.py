"""From slide geometry and thumbnail pixels to the tiles worth encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagspark.operators.tiles import cap_patches, pick_level, resolve_mpp, tile_geometry, tissue_tiles
from bagspark.operators.tissue import pen_condition, tissue_mask
from bagspark.session import materialise


def build_tiles(
    geom: DataFrame,
    pixels: DataFrame,
    out_px: int = 224,
    target_mpp: float = 0.5,
    tissue_frac: float = 0.35,
    max_patches: int | None = None,
    seed: int = 0,
    thumbnail_px: int = 2048,
    fallback_mpp: float | None = 0.25,
) -> DataFrame:
    """(slide_id, tile_idx, x, y, level, read_px, level0_px, fraction) of the kept tiles."""
    sized = tile_geometry(pick_level(resolve_mpp(geom, fallback_mpp), target_mpp), out_px, target_mpp, thumbnail_px)
    mask = tissue_mask(pixels).select("slide_id", "y", "x", (F.col("tissue") & ~pen_condition()).alias("keep"))
    mask = materialise(mask.where("keep"), "mask")
    kept = tissue_tiles(sized, mask, tissue_frac)
    return kept if max_patches is None else cap_patches(materialise(kept, "tiles"), max_patches, seed)

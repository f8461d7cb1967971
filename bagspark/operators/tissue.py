"""Tissue masks over pixel tables (slide_id, y, x, r, g, b)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bagspark.session import materialise
from bagspark.skew import attach_stats


def rgb_to_hsv(pixels: DataFrame) -> DataFrame:
    """Adds hue, sat, val in [0, 1]; ties of the largest channel go red, green, blue."""
    r, g, b = (F.col(c) / F.lit(255.0) for c in "rgb")
    peak = F.greatest("r", "g", "b")
    top = peak / F.lit(255.0)
    diff = top - F.least("r", "g", "b") / F.lit(255.0)
    hue = (
        F.when(diff <= 1e-8, F.lit(0.0))
        .when(F.col("r") == peak, F.pmod((g - b) / diff, F.lit(6.0)))
        .when(F.col("g") == peak, (b - r) / diff + 2)
        .otherwise((r - g) / diff + 4)
    )
    sat = F.when(top > 1e-8, diff / top).otherwise(F.lit(0.0))
    return pixels.withColumns({"hue": hue / 6.0, "sat": sat, "val": top})


def pen_condition() -> Column:
    hue, sat, val = F.col("hue"), F.col("sat"), F.col("val")
    inked = sat > 0.35
    green = (hue > 0.20) & (hue < 0.45) & inked
    blue = (hue > 0.50) & (hue < 0.75) & inked
    return green | blue | (val < 0.18)


def pen_mask(pixels: DataFrame) -> DataFrame:
    """Adds ``pen``: green, blue or black marker ink."""
    if "hue" not in pixels.columns:
        pixels = rgb_to_hsv(pixels)
    return pixels.withColumn("pen", pen_condition())


def otsu_threshold(
    values: DataFrame, bins: int = 256, by: str = "slide_id", value: str = "value", spread: Sequence[str] | None = None
) -> DataFrame:
    """(by, threshold): histogram bin centre with the largest between-class variance, first one wins.

    Rows are only counted into at most ``bins`` cells per group; the last bin is closed on the
    right and constant input spans value +- 0.5. A single occupied bin has no valid cut and gives
    the middle centre.
    """
    v = F.col(value).cast("double")
    span = values.groupBy(by).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count(F.lit(1)).alias("n"))
    flat = F.col("_lo") == F.col("_hi")
    span = span.select(
        by, "n", F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_a"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_z"),
    )
    rows = attach_stats(values.select(by, v.alias("_v"), *(spread or [])), span, [by], spread or ["_v"])
    width = F.col("_z") - F.col("_a")
    slot = F.least(F.floor((F.col("_v") - F.col("_a")) / width * bins), F.lit(bins - 1)).cast("int")
    hist = rows.groupBy(by, "_a", "_z", slot.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"))
    centre = F.col("_a") + (F.col("_bin") + 0.5) * width / bins
    hist = hist.withColumn("_centre", centre).withColumn("_m", F.col("_c") * F.col("_centre"))
    upto = W.partitionBy(by).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(by)
    cuts = hist.withColumns(
        {
            "_w0": F.sum("_c").over(upto).cast("double"), "_m0": F.sum("_m").over(upto),
            "_wt": F.sum("_c").over(whole).cast("double"), "_mt": F.sum("_m").over(whole),
        }
    )
    w1 = F.col("_wt") - F.col("_w0")
    gap = F.col("_m0") / F.col("_w0") - F.try_divide(F.col("_mt") - F.col("_m0"), w1)
    between = F.when(w1 > 0, F.col("_w0") * w1 * gap * gap)
    middle = F.col("_a") + (F.lit(bins // 2) + 0.5) * width / bins
    return cuts.withColumn("_between", between).groupBy(by).agg(
        F.coalesce(
            F.max_by("_centre", F.when(F.col("_between").isNotNull(), F.struct("_between", -F.col("_bin")))), F.max(middle)
        ).alias("threshold")
    )


def raw_tissue(
    pixels: DataFrame, min_saturation: float = 0.05, max_value: float = 0.96, min_value: float = 0.05
) -> DataFrame:
    """Pixels with hue, sat, val and ``tissue`` before small components are dropped."""
    hsv = rgb_to_hsv(pixels)
    cut = otsu_threshold(hsv, value="sat", spread=["y", "x"])
    sizes = pixels.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n"))
    rows = attach_stats(hsv, cut.join(sizes, "slide_id"), ["slide_id"], ["y", "x"])
    level = F.greatest("threshold", F.lit(min_saturation))
    tissue = (F.col("sat") > level) & (F.col("val") < max_value) & (F.col("val") > min_value)
    return rows.withColumn("tissue", tissue).drop("threshold", "n")


def block_labels(mask: DataFrame, block: int) -> DataFrame:
    """(slide_id, y, x, comp): components inside blocks of ``block`` x ``block`` pixels.

    A group is one block, so it never exceeds block^2 pixels. The label is y * 2^31 + x of the
    component's first pixel.
    """
    slide_type = mask.schema["slide_id"].dataType.simpleString()

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        y, x = rows["y"].to_numpy(np.int64), rows["x"].to_numpy(np.int64)
        grid = np.full((block + 1, block + 1), -1, dtype=np.int64)
        order = np.lexsort((x, y))
        y, x = y[order], x[order]
        n = len(y)
        grid[y % block, x % block] = np.arange(n)
        right, down = grid[y % block, x % block + 1], grid[y % block + 1, x % block]
        a = np.concatenate([np.flatnonzero(right >= 0), np.flatnonzero(down >= 0)])
        b = np.concatenate([right[right >= 0], down[down >= 0]])
        root = np.arange(n)
        while True:
            low = np.minimum(root[a], root[b])
            after = root.copy()
            np.minimum.at(after, a, low)
            np.minimum.at(after, b, low)
            np.minimum.at(after, root[a], low)
            np.minimum.at(after, root[b], low)
            after = after[after]
            if np.array_equal(after, root):
                break
            root = after
        return pd.DataFrame({"slide_id": rows["slide_id"].iloc[0], "y": y, "x": x, "comp": (y << 31)[root] + x[root]})

    keyed = mask.select(
        "slide_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"),
        F.floor(F.col("y") / block).alias("_by"), F.floor(F.col("x") / block).alias("_bx"),
    )
    return keyed.groupBy("slide_id", "_by", "_bx").applyInPandas(
        lambda rows: label(rows), f"slide_id {slide_type}, y bigint, x bigint, comp bigint"
    )


def merge_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(slide_id, comp, root): smallest label reachable over undirected ``edges`` (slide_id, a, b).

    Rounds of minimum-over-neighbours, hooking of roots and pointer jumping; each round is written
    out, and the loop ends at the fix-point.
    """
    edges = materialise(edges.select("slide_id", "a", "b").distinct(), "edges")
    labels = nodes.select("slide_id", "comp", F.col("comp").alias("root"))
    if edges.isEmpty():
        return labels
    both = edges.unionByName(edges.select("slide_id", F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(labels, "labels")
    while True:
        seen = both.join(labels.select("slide_id", F.col("comp").alias("b"), F.col("root").alias("_m")), ["slide_id", "b"])
        low = seen.groupBy("slide_id", F.col("a").alias("comp")).agg(F.min("_m").alias("_m"))
        met = labels.join(low, ["slide_id", "comp"], "left").withColumn("_m", F.least("root", F.coalesce("_m", "root")))
        hooks = met.groupBy("slide_id", F.col("root").alias("comp")).agg(F.min("_m").alias("_h"))
        hooked = met.join(hooks, ["slide_id", "comp"], "left").select(
            "slide_id", "comp", F.col("root").alias("_old"), F.least("_m", F.coalesce("_h", "_m")).alias("root")
        )
        sizes = hooked.groupBy("slide_id", "root").agg(F.count(F.lit(1)).alias("n"))
        target = hooked.select("slide_id", F.col("comp").alias("root"), F.col("root").alias("_next")).join(sizes, ["slide_id", "root"])
        jumped = attach_stats(hooked, target, ["slide_id", "root"], ["comp"])
        stepped = materialise(
            jumped.select("slide_id", "comp", "_old", F.least("root", "_next").alias("root")), "labels"
        )
        labels = stepped.drop("_old")
        if stepped.where("root <> _old").isEmpty():
            return labels


def connected_components(mask: DataFrame, block: int = 128) -> tuple[DataFrame, DataFrame]:
    """4-connected components of mask pixels (slide_id, y, x): (pixel labels, label roots).

    Pixels are labelled block by block; only pairs of labels that touch across a block border
    enter the iterative merge, a graph far smaller than the image.
    """
    pixels = materialise(block_labels(mask, block), "blocks")
    here = pixels.select("slide_id", "y", "x", F.col("comp").alias("a"))
    step_x = here.where(F.col("x") % block == block - 1).withColumn("x", F.col("x") + 1)
    step_y = here.where(F.col("y") % block == block - 1).withColumn("y", F.col("y") + 1)
    there = pixels.where((F.col("x") % block == 0) | (F.col("y") % block == 0)).select("slide_id", "y", "x", F.col("comp").alias("b"))
    edges = step_x.unionByName(step_y).join(there, ["slide_id", "y", "x"])
    return pixels, merge_components(pixels.select("slide_id", "comp").distinct(), edges)


def tissue_mask(
    pixels: DataFrame, min_saturation: float = 0.05, max_value: float = 0.96, min_value: float = 0.05, block: int = 128
) -> DataFrame:
    """Adds hue, sat, val and ``tissue``: saturated, neither bright nor dark, in a component of at
    least max(16, pixels / 20000) pixels."""
    raw = raw_tissue(pixels, min_saturation, max_value, min_value)
    labelled, roots = connected_components(raw.where("tissue").select("slide_id", "y", "x"), block)
    parts = labelled.groupBy("slide_id", "comp").agg(F.count(F.lit(1)).alias("_c")).join(roots, ["slide_id", "comp"])
    sizes = parts.groupBy("slide_id", "root").agg(F.sum("_c").alias("_size"))
    needed = pixels.groupBy("slide_id").agg(
        F.greatest(F.lit(16), F.floor(F.count(F.lit(1)) / 20000)).alias("_min")
    )
    big = sizes.join(needed, "slide_id").where(F.col("_size") >= F.col("_min")).select("slide_id", "root")
    kept_parts = parts.join(big, ["slide_id", "root"], "left_semi").select("slide_id", "comp")
    kept = labelled.join(kept_parts, ["slide_id", "comp"], "left_semi").select("slide_id", "y", "x", F.lit(True).alias("_kept"))
    return raw.drop("tissue").join(kept, ["slide_id", "y", "x"], "left").withColumn(
        "tissue", F.coalesce("_kept", F.lit(False))
    ).drop("_kept")

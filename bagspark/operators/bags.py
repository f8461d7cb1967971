"""Bags and sub-bags: crops, draws, class balance, bag mixing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bagspark.functions.hashing import hash_uniform
from bagspark.functions.ordinal import cumulative_targets
from bagspark.session import materialise
from bagspark.skew import attach_stats, hash_rank, ranged_prefix, smallest_by_hash
from bagspark.sources.layout import Layout, beside_patches


def positions(patches: DataFrame) -> DataFrame:
    """(slide_id, patch_idx, position): the 0-based place of each patch in its slide by patch_idx, which may have gaps."""
    return ranged_prefix(patches.select("slide_id", "patch_idx"), ["patch_idx"], ["slide_id"], out="position")


def crop_index(patches: DataFrame, bag_size: int, layout: Layout | None = None) -> DataFrame:
    """Adds ``crop`` (floor(position / bag_size)) and ``n_crops``; every patch is in one crop.

    Only keys are ranked. With the ``layout`` of a bucketed table crops are sent to the vectors. Without one, where the ids of
    a slide have no gaps, the position is patch_idx itself.
    """
    sizes = patches.groupBy("slide_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("patch_idx").alias("_low"), F.max("patch_idx").alias("_high")
    )
    n_crops = F.greatest(F.ceil(F.col("n") / F.lit(bag_size)), F.lit(1))
    sizes = materialise(sizes.withColumn("n_crops", n_crops), "sizes")
    narrow = sizes.drop("_low", "_high")
    crop = F.floor(F.col("position") / F.lit(bag_size))
    if layout is not None:
        keys = attach_stats(positions(patches), narrow, ["slide_id"], ["patch_idx"], written=True).withColumn("crop", crop)
        return beside_patches(patches, keys.drop("n", "position"), layout)
    if sizes.where((F.col("_low") != 0) | (F.col("_high") != F.col("n") - 1)).isEmpty():
        placed = patches.withColumn("position", F.col("patch_idx"))
    else:
        placed = patches.join(positions(patches), ["slide_id", "patch_idx"])
    crops = attach_stats(placed, narrow, ["slide_id"], ["patch_idx"], written=True)
    return crops.withColumn("crop", crop).drop("n", "position")


def sample_subbag(
    patches: DataFrame, bag_size: int = 2048, samples_per_slide: int = 1, train: bool = True, seed: int = 0
) -> DataFrame:
    """(slide_id, draw, patch_idx): independent draws without replacement, or the first patches.

    Slides of at most ``bag_size`` patches are kept whole. Evaluation takes the positions below ``bag_size``.
    """
    rows = patches.select("slide_id", "patch_idx")
    if not train:
        return positions(rows).where(F.col("position") < bag_size).drop("position").withColumn("draw", F.lit(0))
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(samples_per_slide - 1))))
    drawn = drawn.withColumn("_u", hash_uniform(seed, "draw", "slide_id", "patch_idx"))
    return smallest_by_hash(drawn, ["slide_id", "draw"], "_u", bag_size, ["patch_idx"]).drop("_u")


def balanced_sample(labels: DataFrame, n: int | None = None, seed: int = 0) -> DataFrame:
    """``n`` draws with replacement, each row weighted by 1 / its class count: (draw, patient_id, label).

    The weights make every class equally likely, so a draw picks a class and then a member; both
    are indices, and the member is found by an equi-join.
    """
    total = labels.count() if n is None else n
    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    classes = counts.select(
        "label", "size",
        (F.row_number().over(W.partitionBy(F.lit(0)).orderBy("label")) - 1).alias("class_no"),
        F.count(F.lit(1)).over(W.partitionBy(F.lit(0))).alias("n_classes"),
    )
    by_class = classes.groupBy("n_classes").agg(
        F.map_from_entries(F.collect_list(F.struct("class_no", F.struct("label", "size")))).alias("classes")
    )
    draws = (
        labels.sparkSession.range(total)
        .select(
            F.col("id").alias("draw"),
            hash_uniform(f"{seed}|class", "id").alias("_u1"),
            hash_uniform(f"{seed}|member", "id").alias("_u2"),
            F.lit(1).alias("_one"),
        )
        .join(F.broadcast(by_class.withColumn("_one", F.lit(1))), "_one")
    )
    chosen = F.element_at("classes", F.floor(F.col("_u1") * F.col("n_classes")).cast("int"))
    draws = draws.select("draw", "_u2", chosen.alias("c")).select(
        "draw", "c.label", F.floor(F.col("_u2") * F.col("c.size")).alias("_position")
    )
    keyed = labels.select("patient_id", "label").withColumn("_u", hash_uniform(f"{seed}|order", "patient_id"))
    members = hash_rank(keyed, ["label"], "_u", ["patient_id"], out="_position").drop("_u")
    return draws.join(members, ["label", "_position"]).select("draw", "patient_id", "label")


def beta_weights(bags: DataFrame, alpha: float, seed: int) -> DataFrame:
    """(slide_id, lam): a reproducible Beta(alpha, alpha) draw per bag."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lam = [np.random.default_rng([seed, h]).beta(alpha, alpha) for h in batch["_h"]]
            yield pd.DataFrame({"slide_id": batch["slide_id"], "lam": lam})

    slide_type = bags.schema["slide_id"].dataType.simpleString()
    keyed = bags.select("slide_id", F.pmod(F.xxhash64("slide_id"), F.lit(2**62)).alias("_h"))
    return keyed.mapInPandas(draw, f"slide_id {slide_type}, lam double")


def bag_mixup(
    bags: DataFrame,
    n_classes: int = 3,
    alpha: float = 0.4,
    prob: float = 0.5,
    lambdas: DataFrame | None = None,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Swap patches between paired bags: (members, targets).

    ``bags`` holds (slide_id, patch_idx, label); a bag's slots are its patch positions. A bag is
    mixed with probability ``prob``; its partner is the next bag in hash order. Each slot of a
    mixed bag keeps its own patch with probability lambda and takes the partner's patch of the
    same slot otherwise. Members are (slide_id, patch_idx, source_slide); targets are
    (slide_id, lam_eff, cum_targets) with the share of patches that really came from each side.
    The choice per slot is a hash of (bag, slot), so both sides are filtered without a slot join.
    """
    slides = bags.groupBy("slide_id").agg(F.max("label").alias("label"), F.count(F.lit(1)).alias("n"))
    lam = beta_weights(slides, alpha, seed) if lambdas is None else lambdas
    keyed = slides.withColumn("_u", hash_uniform(f"{seed}|pair", "slide_id"))
    placed = hash_rank(keyed, [], "_u", ["slide_id"], out="_p").drop("_u")
    n_bags = slides.count()
    ahead = placed.select(
        F.pmod(F.col("_p") - 1, F.lit(max(n_bags, 1))).alias("_p"),
        F.col("slide_id").alias("partner"), F.col("label").alias("partner_label"), F.col("n").alias("partner_n"),
    )
    mixes = (hash_uniform(f"{seed}|mix", "slide_id") < prob) & F.lit(n_bags > 1)
    pairs = (
        placed.join(ahead, "_p")
        .join(lam, "slide_id")
        .withColumn("mixed", mixes)
        .withColumn("lam", F.when(F.col("mixed"), F.col("lam")).otherwise(F.lit(1.0)))
        .drop("_p")
    )
    rows = bags.select("slide_id", "patch_idx")
    keep_self = hash_uniform(f"{seed}|slot", "slide_id", "patch_idx") < F.col("lam")
    own = attach_stats(rows, pairs.select("slide_id", "lam", "n"), ["slide_id"], ["patch_idx"]).where(keep_self)
    own = own.select("slide_id", "patch_idx", F.col("slide_id").alias("source_slide"))
    reverse = pairs.where("mixed").select(
        F.col("partner").alias("source_slide"), F.col("slide_id").alias("_target"), "lam", F.col("partner_n").alias("n")
    )
    swapped = attach_stats(
        rows.withColumnRenamed("slide_id", "source_slide"), reverse, ["source_slide"], ["patch_idx"]
    ).withColumnRenamed("_target", "slide_id").where(~keep_self)
    mixed_rows = own.unionByName(swapped.select("slide_id", "patch_idx", "source_slide"))

    from_self = F.count_if(F.col("source_slide") == F.col("slide_id"))
    shares = mixed_rows.groupBy("slide_id").agg(from_self.alias("_own"), F.count(F.lit(1)).alias("_all"))
    known = pairs.join(shares, "slide_id", "left")
    empty = F.col("_all").isNull()
    lam_eff = F.when(~F.col("mixed") | empty, F.lit(1.0)).otherwise(F.col("_own") / F.col("_all"))
    blended = F.zip_with(
        cumulative_targets("label", n_classes),
        cumulative_targets("partner_label", n_classes),
        lambda a, b: F.col("lam_eff") * a + (F.lit(1.0) - F.col("lam_eff")) * b,
    )
    targets = known.withColumn("lam_eff", lam_eff).select(
        "slide_id", "mixed", "lam_eff", blended.alias("cum_targets")
    )
    emptied = known.where(empty).select("slide_id")
    restored = rows.join(emptied, "slide_id", "left_semi").withColumn("source_slide", F.col("slide_id"))
    return mixed_rows.unionByName(restored), targets


def pick_offsets(offsets: list[int], n: int | None = None) -> list[int]:
    """``n`` evenly spaced entries of the offset list; all of them when n is None or too large."""
    if n is None or not 0 < n < len(offsets):
        return list(offsets)
    return [offsets[int(i * len(offsets) / n)] for i in range(n)]

"""Checks over the slides of a cohort: presence, width, encoder, licence, size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bagspark.skew import attach_stats
from bagspark.sources.layout import Layout, beside_slides

# Name, vector width, licence, commercial use, channel mean, channel deviation, pooling.
_IMAGENET = ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225))
ENCODERS = [
    ("h-optimus-0", 1536, "Apache-2.0", True, (0.707223, 0.578729, 0.703617), (0.211883, 0.230117, 0.177517), "cls"),
    ("virchow", 2560, "Apache-2.0", True, *_IMAGENET, "cls_mean"),
    ("hibou-l", 1024, "Apache-2.0", True, (0.7068, 0.5755, 0.7220), (0.1950, 0.2316, 0.1816), "cls"),
    ("midnight", 3072, "MIT", True, (0.5, 0.5, 0.5), (0.5, 0.5, 0.5), "cls_mean"),
    ("uni", 1024, "CC-BY-NC-ND-4.0", False, *_IMAGENET, "cls"),
    ("uni2-h", 1536, "CC-BY-NC-ND-4.0", False, *_IMAGENET, "cls"),
    ("prov-gigapath", 1536, "Apache-2.0 tag, no-deploy terms", False, *_IMAGENET, "cls"),
    ("virchow2", 2560, "CC-BY-NC-ND-4.0", False, *_IMAGENET, "cls_mean"),
    ("h-optimus-1", 1536, "CC-BY-NC-ND-4.0", False, *_IMAGENET, "cls"),
    ("phikon-v2", 1024, "Owkin non-commercial", False, *_IMAGENET, "cls"),
]


class CohortError(ValueError):
    """The feature store and the request do not fit together."""


def encoder_registry(spark: SparkSession) -> DataFrame:
    """The encoders as a ten-row dimension table."""
    rows = [
        F.struct(
            F.lit(name).alias("encoder"), F.lit(width).alias("embed_dim"), F.lit(licence).alias("licence"),
            F.lit(free).alias("commercial_ok"), F.lit(224).alias("patch_px"), F.lit(0.5).alias("target_mpp"),
            F.array(*map(F.lit, mean)).alias("mean"), F.array(*map(F.lit, std)).alias("std"),
            F.lit(pooling).alias("pooling"),
        )
        for name, width, licence, free, mean, std, pooling in ENCODERS
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def verify_cohort(ids: DataFrame, inventory: DataFrame) -> DataFrame:
    """One row: present, missing (and the first 20), distinct widths and encoders, patch statistics."""
    asked = ids.select("slide_id").distinct()
    known = asked.join(inventory.withColumn("_here", F.lit(True)), "slide_id", "left")
    missing = known.where(F.col("_here").isNull()).select("slide_id").orderBy("slide_id").limit(20)
    first = missing.agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("slide_id")), lambda i: i.cast("string"))).alias("missing_first"),
        F.lit(1).alias("_one"),
    )
    totals = known.agg(
        F.count("_here").alias("present"),
        F.count_if(F.col("_here").isNull()).alias("missing"),
        F.countDistinct("width").alias("n_widths"),
        F.countDistinct("encoder").alias("n_encoders"),
        F.floor(F.percentile("n_patches", F.lit(0.5))).alias("median_patches"),
        F.min("n_patches").alias("min_patches"),
        F.max("n_patches").alias("max_patches"),
        F.sum("n_patches").alias("total_patches"),
        F.lit(1).alias("_one"),
    )
    return totals.join(first, "_one").drop("_one")


def check_cohort(ids: DataFrame, inventory: DataFrame) -> dict:
    """The :func:`verify_cohort` row; raises on mixed widths or encoders."""
    row = verify_cohort(ids, inventory).first().asDict()
    if row["n_widths"] > 1:
        raise CohortError(f"{row['n_widths']} different vector widths in one cohort")
    if row["n_encoders"] > 1:
        raise CohortError(f"{row['n_encoders']} different encoders in one cohort")
    return row


def suggest_bag_size(inventory: DataFrame, cap: int = 4096) -> DataFrame:
    """Half the median patch count, to the nearest multiple of 256 (half to even) within [256, cap]."""
    median = F.percentile("n_patches", F.lit(0.5))
    half = F.floor(median / 2)
    size = F.least(F.greatest(F.lit(256), F.bround(half / 256) * 256), F.lit(cap)).cast("int")
    return inventory.agg(F.coalesce(F.when(F.count("n_patches") > 0, size), F.lit(2048)).alias("bag_size"))


def cohort_bytes(inventory: DataFrame, available_bytes: int, fraction: float = 0.25) -> DataFrame:
    """float32 bytes of the distinct slides, and whether they fit ``fraction`` of the memory."""
    slides = inventory.groupBy("slide_id").agg(F.max("n_patches").alias("n"), F.max("width").alias("w"))
    need = F.coalesce(F.sum(F.col("n") * F.col("w") * 4), F.lit(0))
    return slides.agg(need.alias("bytes"), (need < F.lit(available_bytes * fraction)).alias("cache"))


def bag_presence(ids: DataFrame, labels: DataFrame, patches: DataFrame) -> DataFrame:
    """(slide_id, label, n): requested slides with their label and patch count, null where absent."""
    sizes = patches.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n"))
    return ids.select("slide_id").distinct().join(labels, "slide_id", "left").join(sizes, "slide_id", "left")


def attach_bags(ids: DataFrame, labels: DataFrame, patches: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Patches of the requested slides with their label; raises when any request has no patches.

    With the ``layout`` of a bucketed table labels are sent to the vectors."""
    bags = bag_presence(ids, labels, patches)
    absent = bags.where("n IS NULL").select("slide_id")
    n_absent = absent.count()
    if n_absent:
        sample = [r[0] for r in absent.orderBy("slide_id").limit(5).collect()]
        raise CohortError(f"{n_absent} requested slides have no features, e.g. {sample}")
    bags = bags.where("label IS NOT NULL")
    if layout is not None:
        return beside_slides(patches, bags.drop("n"), layout)
    return attach_stats(patches, bags, ["slide_id"], ["patch_idx"]).drop("n")


def licence_status(features: DataFrame, registry: DataFrame, allow_noncommercial: bool = False) -> DataFrame:
    """(encoder, n, status) with status ok / blocked / unknown for each encoder in a store."""
    used = features.groupBy(F.lower("encoder").alias("encoder")).agg(F.count(F.lit(1)).alias("n"))
    status = (
        F.when(F.col("commercial_ok").isNull(), "unknown")
        .when(~F.col("commercial_ok") & F.lit(not allow_noncommercial), "blocked")
        .otherwise("ok")
    )
    return used.join(registry.select("encoder", "commercial_ok"), "encoder", "left").select(
        "encoder", "n", status.alias("status")
    )


def licence_gate(features: DataFrame, registry: DataFrame, allow_noncommercial: bool = False) -> DataFrame:
    """``features`` unchanged, or an error naming what may not be used and what may."""
    refused = licence_status(features, registry, allow_noncommercial).where("status <> 'ok'")
    bad = refused.orderBy("encoder").limit(20).collect()
    if bad:
        usable = [r[0] for r in registry.where("commercial_ok").select("encoder").orderBy("encoder").collect()]
        listed = ", ".join(f"{r['encoder']} ({r['status']})" for r in bad)
        raise CohortError(f"{refused.count()} encoders not usable, e.g. {listed}; usable commercially: {usable}")
    return features


def expected_width(inventory: DataFrame, registry: DataFrame, pooling: str | None = None) -> DataFrame:
    """Adds expected_width and width_ok: the registry width under a pooling override.

    cls -> cls_mean doubles, cls_mean -> cls halves (an odd width raises).
    """
    if pooling not in (None, "cls", "cls_mean"):
        raise CohortError(f"unknown pooling {pooling!r}")
    dims = registry.select("encoder", "embed_dim", F.col("pooling").alias("_native"))
    wanted = F.lit(pooling) if pooling else F.col("_native")
    halved = F.when(
        F.col("embed_dim") % 2 == 1, F.raise_error(F.concat(F.lit("odd width cannot be halved: "), "encoder"))
    ).otherwise(F.floor(F.col("embed_dim") / 2))
    width = (
        F.when(wanted == F.col("_native"), F.col("embed_dim").cast("bigint"))
        .when(wanted == "cls_mean", F.col("embed_dim").cast("bigint") * 2)
        .otherwise(halved.cast("bigint"))
    )
    return (
        inventory.join(dims, "encoder", "left")
        .withColumn("expected_width", width)
        .withColumn("width_ok", F.col("expected_width") == F.col("width"))
        .drop("embed_dim", "_native")
    )


def normalise_pixels(pixels: DataFrame, registry: DataFrame, encoder: str) -> DataFrame:
    """(v / 255 - mean) / std per channel with the constants of one encoder."""
    row = registry.where(F.col("encoder") == encoder).first()
    if row is None:
        raise CohortError(f"unknown encoder {encoder!r}")
    return pixels.withColumns(
        {
            f"{c}_norm": (F.col(c) / F.lit(255.0) - F.lit(row["mean"][i])) / F.lit(row["std"][i])
            for i, c in enumerate("rgb")
        }
    )


def cls_mean_pool(tokens: DataFrame, n_prefix: int = 1) -> DataFrame:
    """Per tile: the CLS token followed by the mean of the tokens after the prefix.

    A tile without one of the two has nulls in that half. Null vectors are no tokens.
    """
    there = tokens.where(F.col("features").isNotNull())
    values = F.col("features").cast("array<double>")
    cls = there.where("token = 0").groupBy("tile_id").agg(F.max(values).alias("_cls"))
    means = there.where(F.col("token") >= n_prefix).groupBy("tile_id").agg(Summarizer.mean(array_to_vector(values), F.lit(1.0)).alias("v"))
    pooled = cls.join(means.select("tile_id", vector_to_array("v").alias("_mean")), "tile_id", "full")

    def half(name: str, other: str) -> Column:
        return F.coalesce(name, F.transform(other, lambda v: F.lit(None).cast("double")))

    return pooled.select("tile_id", F.concat(half("_cls", "_mean"), half("_mean", "_cls")).alias("features"))


def encode_tiles(
    tiles: DataFrame,
    encode_fn: Callable[[], Callable[[np.ndarray], np.ndarray]],
    width: int,
    batch_size: int = 64,
    keys: tuple[str, ...] = ("slide_id", "patch_idx"),
    value: str = "pixels",
) -> DataFrame:
    """Run a user encoder over tile rows in batches of constant size.

    ``encode_fn()`` builds the encoder once per partition; it maps [batch_size, ...] arrays to
    [batch_size, width]. The last batch is padded by repeating its final row and cut again. A
    wrong shape or any exception fails the job. Keys travel with the rows, so order is irrelevant.
    """
    key_types = ", ".join(f"{k} {tiles.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encode_fn()

        def flush(rows: pd.DataFrame) -> pd.DataFrame:
            data = np.stack(rows[value].to_numpy())
            short = batch_size - len(data)
            if short:
                data = np.concatenate([data, np.repeat(data[-1:], short, axis=0)])
            out = np.asarray(encode(data), dtype=np.float32)
            if out.shape != (batch_size, width):
                raise CohortError(f"encoder returned {out.shape}, expected {(batch_size, width)}")
            result = rows[list(keys)].reset_index(drop=True)
            result["features"] = list(out[: len(rows)])
            return result

        held: list[pd.DataFrame] = []
        n_held = 0
        for batch in batches:
            held.append(batch)
            n_held += len(batch)
            if n_held < batch_size:
                continue
            ready = pd.concat(held, ignore_index=True)
            full = n_held - n_held % batch_size
            for at in range(0, full, batch_size):
                yield flush(ready.iloc[at : at + batch_size])
            held, n_held = [ready.iloc[full:]], n_held - full
        if n_held:
            yield flush(pd.concat(held, ignore_index=True))

    return tiles.select(*keys, value).mapInPandas(run, f"{key_types}, features array<float>")

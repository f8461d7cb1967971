"""The feature store: one row per patch, Parquet partitioned by encoder and pooling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagspark.session import materialise
from bagspark.skew import attach_stats
from bagspark.sources.layout import Layout, beside_slides

KEYS = ["slide_id", "patch_idx"]
SIDECAR = "_inventory"


def write_features(df: DataFrame, path: str, mode: str = "append", rows_per_file: int = 1_000_000) -> None:
    """Range-partitioned by (slide, patch), so files carry tight statistics and hot slides are split.

    The output committer makes a partial write invisible. The inventory beside the store is brought up to date.
    """
    (
        df.repartitionByRange("encoder", "pooling", *KEYS)
        .sortWithinPartitions("encoder", "pooling", *KEYS)
        .write.mode(mode)
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy("encoder", "pooling")
        .parquet(path)
    )
    update_inventory(df.sparkSession, path)


def update_inventory(spark: SparkSession, path: str) -> None:
    """Counts patches and widths per (file, slide) of files that ``path/_inventory`` does not know yet. Only those are read."""
    store = spark.read.parquet(path)
    files, known = set(store.inputFiles()), _inventoried(spark, path)
    fresh = sorted(files - ({r["file"] for r in known.select("file").distinct().collect()} if known is not None else set()))
    if not fresh:
        return
    rows = spark.read.schema(store.schema).option("basePath", path).parquet(*fresh).withColumn("file", F.input_file_name())
    counted = rows.groupBy("file", "slide_id", "encoder", "pooling").agg(F.count(F.lit(1)).alias("n_patches"), F.max(F.size("features")).alias("width"))
    counted.write.mode("append").parquet(f"{path}/{SIDECAR}")


def _inventoried(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/{SIDECAR}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def store_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(slide_id, n_patches, width, encoder, pooling) of a store from its written statistics; no vector is read.

    Files that are no longer there do not count, and files without statistics, written by other means, are counted first.
    A slide in several encodings has a row for each."""
    update_inventory(spark, path)
    there = spark.createDataFrame([(f,) for f in spark.read.parquet(path).inputFiles()], "file string")
    known = _inventoried(spark, path)
    if known is None:
        known = spark.createDataFrame([], "file string, slide_id bigint, encoder string, pooling string, n_patches bigint, width int")
    rows = known.dropDuplicates(["file", "slide_id", "encoder", "pooling"]).join(there, "file", "left_semi")
    return rows.groupBy("slide_id", "encoder", "pooling").agg(F.sum("n_patches").alias("n_patches"), F.max("width").alias("width")).select(
        "slide_id", "n_patches", "width", "encoder", "pooling"
    )


def read_features(
    spark: SparkSession, path: str, wanted: DataFrame | None = None, with_coords: bool = False
) -> DataFrame:
    """Patch vectors as float32, all of them or those in ``wanted`` (slide_id, patch_idx)."""
    coords = ["x", "y"] if with_coords else []
    rows = spark.read.parquet(path).select(*KEYS, *coords, F.col("features").cast("array<float>").alias("features"))
    if wanted is not None:
        rows = rows.join(wanted.select(*KEYS), KEYS, "left_semi")
    return rows


def prefer_source(stores: Sequence[tuple[DataFrame, int]], layout: Layout | None = None) -> DataFrame:
    """Rows of each slide from the store with the smallest priority number that has the slide.

    Priorities are compared on slides alone. With the ``layout`` of bucketed tables the choice is sent to the vectors."""
    sizes = None
    for df, priority in stores:
        part = df.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n")).withColumn("priority", F.lit(priority))
        sizes = part if sizes is None else sizes.unionByName(part)
    sizes = materialise(sizes, "sizes")
    best = sizes.join(sizes.groupBy("slide_id").agg(F.min("priority").alias("priority")), ["slide_id", "priority"])
    merged = None
    for df, priority in stores:
        chosen = best.where(F.col("priority") == priority)
        rows = beside_slides(df, chosen.drop("n"), layout) if layout else attach_stats(df, chosen, ["slide_id"], ["patch_idx"]).drop("n")
        merged = rows if merged is None else merged.unionByName(rows)
    return merged


def slide_inventory(patches: DataFrame, provenance: DataFrame | None = None) -> DataFrame:
    """(slide_id, n_patches, width) and the provenance columns, if given."""
    sizes = patches.groupBy("slide_id").agg(
        F.count(F.lit(1)).alias("n_patches"), F.max(F.size("features")).alias("width")
    )
    return sizes if provenance is None else sizes.join(provenance, "slide_id", "left")


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)

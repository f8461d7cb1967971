"""Incremental feature ingestion with exactly-once rows per (slide, patch)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from bagspark.session import materialise
from bagspark.streaming.store_index import suspects, write_index

FEATURES_SCHEMA = (
    "slide_id bigint, patch_idx bigint, x bigint, y bigint, encoder string, pooling string, features array<float>"
)
KEYS = ["slide_id", "patch_idx"]
KNOWN_BY = [*KEYS, "pooling"]
ROW = ["_file", "_row"]
"""Where a row of a batch has landed, which stays the same when the batch is read again."""
BUCKETS = 256
LISTED = 5000
"""Up to so many earlier directories are read by name; more are read through the store, pruned to the buckets of the batch."""


def bucket_of() -> Column:
    return F.pmod(F.xxhash64("slide_id"), F.lit(BUCKETS)).cast("int")


def repeats(batch: DataFrame) -> DataFrame:
    """(_file, _row) of the rows of a batch that give way to another with the same key."""
    twice = materialise(batch.groupBy(*KNOWN_BY).count().where("count > 1").select(*KNOWN_BY), "repeats")
    same = batch.join(twice, KNOWN_BY, "left_semi").select(*KNOWN_BY, "encoder", F.xxhash64("features").alias("_hash"), *ROW)
    first = W.partitionBy(*KNOWN_BY).orderBy("encoder", "_hash", *ROW)
    return materialise(same.withColumn("_rn", F.row_number().over(first)).where("_rn > 1").select(*ROW), "surplus")


def earlier_keys(spark: SparkSession, path: str, index: str, name: str, slides: DataFrame, schema: StructType) -> list[DataFrame]:
    """Keys of other ingests that may repeat a key of the batch: none, or those of the directories that may hold its slides."""
    hits, unknown = suspects(spark, path, index, name, slides)
    reader = spark.read.schema(schema).option("basePath", path)
    buckets = sorted({b for _, b in hits})
    out = []
    if len(hits) > LISTED:
        out.append(reader.parquet(path).where((F.col("ingest") != name) & F.col("bucket").isin(buckets)))
    elif hits:
        out.append(reader.parquet(*[f"{path}/ingest={i}/bucket={b}" for i, b in hits]))
    if unknown:
        touched = [r["bucket"] for r in slides.select("bucket").distinct().collect()]  # at most BUCKETS
        out.append(reader.parquet(*[f"{path}/ingest={i}" for i in unknown]).where(F.col("bucket").isin(touched)))
    return [df.select(*KNOWN_BY) for df in out]


def stream_ingest(
    spark: SparkSession,
    src: str,
    store: str,
    checkpoint: str,
    pooling: str = "cls",
    schema: str = FEATURES_SCHEMA,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Append arriving Parquet files of ``src`` to ``store/accepted``; other poolings go to ``store/diverted``.

    Processes what has landed and stops, so short bounded runs add up to the cohort. Every
    micro-batch owns one partition directory that a retry overwrites, and drops rows that the rest
    of the store already has, so neither a retry nor a second checkpoint can duplicate a row. A row is
    known by slide, patch and pooling; of several in one batch the first by encoder, then by a hash of
    its vector, stays. A missing pooling attribute counts as cls.

    The store is laid out in buckets by a hash of the slide. ``store/index`` has a Bloom filter of the slides in each (ingest,
    bucket) directory; a batch asks these and joins the keys of directories that may hold one of its slides, so a batch of
    new slides reads no earlier key. An ingest without complete filters, after a crash, is joined as a whole. Repeats are
    decided on keys: vectors are read again for rows whose key repeats within the batch, and moved once, to be written.
    """
    accepted, diverted = f"{store}/accepted", f"{store}/diverted"
    tag = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    empty = spark.createDataFrame([], schema)
    for path in (accepted, diverted):
        empty.write.mode("ignore").parquet(f"{path}/ingest=none/bucket=0")
    stored_schema = empty.schema.add("ingest", "string").add("bucket", "integer")
    def keep(batch: DataFrame, batch_id: int) -> None:
        name = f"{tag}-{batch_id}"
        session = batch.sparkSession
        named = batch.withColumn("pooling", F.coalesce("pooling", F.lit("cls"))).withColumn("bucket", bucket_of())
        slides = materialise(named.select("slide_id", "bucket").distinct(), "slides")
        surplus = repeats(named)
        for part, chosen in (("accepted", F.col("pooling") == pooling), ("diverted", F.col("pooling") != pooling)):
            path, index = f"{store}/{part}", f"{store}/index/{part}"
            rows = named.where(chosen)
            gone = surplus
            for earlier in earlier_keys(session, path, index, name, slides, stored_schema):
                gone = gone.unionByName(rows.join(earlier, KNOWN_BY, "left_semi").select(*ROW))
            fresh = rows.join(gone.distinct(), ROW, "left_anti").drop(*ROW)
            ranged = fresh.repartitionByRange("bucket", *KEYS).sortWithinPartitions("bucket", *KEYS)
            ranged.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/ingest={name}")
            write_index(session, path, index, name)

    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    place = [F.col("_metadata.file_path").alias(ROW[0]), F.col("_metadata.row_index").alias(ROW[1])]
    return (
        reader.parquet(src)
        .select("*", *place)
        .writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

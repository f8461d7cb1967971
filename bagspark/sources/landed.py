"""Listings, label files, journals and run manifests that other jobs have landed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bagspark.operators.catalog import describe_files
from bagspark.sources.digests import file_digests

LISTING_SCHEMA = (
    "data struct<hits: array<struct<file_id: string, file_name: string, file_size: bigint, md5sum: string,"
    " project_id: string, data_format: string, experimental_strategy: string>>>"
)
JOURNAL_SCHEMA = (
    "slide_id bigint, shard bigint, ts timestamp, ok boolean, n_patches bigint, "
    "encode_seconds double, grid_seconds double, write_seconds double"
)
HEARTBEAT_SCHEMA = "shard bigint, status string, done bigint, failed bigint, total bigint, updated_at double"
LARGEST_VALUE = (1 << 31) - 1


def read_catalog(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Listing documents (``data.hits[]``) as catalogue rows ordered by patient and file name.

    A missing size becomes 0, a missing checksum stays null; every landed page is read.
    """
    pages = spark.read.schema(LISTING_SCHEMA).json(path, multiLine=multi_line)
    hits = pages.select(F.explode("data.hits").alias("h")).select("h.*")
    files = hits.withColumn("file_size", F.coalesce("file_size", F.lit(0))).withColumnRenamed("md5sum", "md5")
    return describe_files(files).orderBy("patient_id", "file_name")


def read_labels(
    spark: SparkSession, path: str, id_col: str = "patient_id", label_col: str = "label",
    pos_col: str | None = None,
) -> DataFrame:
    """(patient_id, label, pos) votes from CSV; ``pos`` is the row order that settles ties.

    Without ``pos_col`` rows count in the order of their file's path, then of their place in the file. How Spark packs
    files into tasks does not matter: blocks of files are ranked, and rows are numbered within their block.
    """
    names = spark.read.csv(path, header=True, inferSchema=False)
    vote = [F.col(id_col).alias("patient_id"), F.col(label_col).cast("int").alias("label")]
    if pos_col:
        return names.select(*vote, F.col(pos_col).cast("bigint").alias("pos"))
    block = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start")]
    rows = names.select(*vote, *block, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))
    ranks = rows.select("_path", "_start").distinct().withColumn("_rank", F.row_number().over(W.orderBy("_path", "_start")).cast("bigint"))
    pos = F.shiftleft("_rank", 33) + F.col("_row")
    return rows.join(ranks, ["_path", "_start"]).select("patient_id", "label", pos.alias("pos"))


def read_journal(spark: SparkSession, path: str, schema: str = JOURNAL_SCHEMA) -> DataFrame:
    """JSON-lines journal; unreadable documents are skipped."""
    rows = (
        spark.read.schema(schema + ", _corrupt_record string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )
    return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_heartbeats(spark: SparkSession, path: str, schema: str = HEARTBEAT_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(heartbeats, one row ``n_unreadable``): one indented JSON document per shard file, with its file name.

    Documents that cannot be read are left out and counted.
    """
    name = F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file_name")
    parsed = F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    documents = spark.read.text(path, wholetext=True).select(name, parsed.alias("d"))
    broken = F.col("d").isNull() | F.col("d._broken").isNotNull()
    return documents.where(~broken).select("d.*", "file_name").drop("_broken"), documents.agg(F.count_if(broken).alias("n_unreadable"))


def scan_landed(spark: SparkSession, path: str, with_md5: bool = True, largest_value: int = LARGEST_VALUE) -> DataFrame:
    """(file_name, length, md5) of landed files. Without checksums no content is loaded.

    A task cannot hold a file of 2 GiB or more as one value; these are read in blocks, one file per task.
    Spark's listing leaves empty files out, so a file that landed empty counts as missing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("file_name")
    if not with_md5:
        return files.select(name, "length", F.lit(None).cast("string").alias("md5"))
    small = files.where(F.col("length") < largest_value).select(name, "length", F.md5("content").alias("md5"))
    # a listing of paths; so large files number one in 2 GiB of the data at most
    large = [r["path"] for r in files.where(F.col("length") >= largest_value).select("path").collect()]
    return small.unionByName(file_digests(spark, large).select(name, "length", "md5"))


MANIFEST_SCHEMA = (
    "encoder string, status string, elapsed_hours double, "
    "cohort struct<n_usable: bigint, median_patches: bigint, total_patches: bigint>, "
    "cv struct<qwk: struct<mean: double, std: double>, macro_f1: struct<mean: double, std: double>>, "
    "test struct<metrics: struct<qwk: double, macro_f1: double, adjacent_accuracy: double>>"
)


def collect_runs(spark: SparkSession, root: str) -> DataFrame:
    """One row per run directory under ``root``: status and headline numbers.

    A run with a failure marker is failed whatever its manifest says; one without a manifest is
    incomplete.
    """

    def run_of(path):
        return F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1)

    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    )
    files = listing.select(run_of("path").alias("run"), F.element_at(F.split("path", "/"), -1).alias("name"))
    runs = files.groupBy("run").agg(
        F.max(F.col("name") == "TRAINING_FAILED.txt").alias("failed"),
        F.max(F.col("name") == "MANIFEST.json").alias("released"),
    )
    manifests = (
        spark.read.schema(MANIFEST_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "MANIFEST.json")
        .json(root, multiLine=True)
        .withColumn("run", run_of(F.input_file_name()))
    )
    status = (
        F.when(F.col("failed"), "failed").when(~F.col("released"), "incomplete").otherwise("complete")
    )
    return runs.join(manifests, "run", "left").select(
        "run",
        status.alias("run_status"),
        "encoder",
        F.col("cohort.n_usable").alias("n_usable"),
        F.col("cohort.total_patches").alias("total_patches"),
        F.col("cv.qwk.mean").alias("cv_qwk_mean"),
        F.col("cv.qwk.std").alias("cv_qwk_std"),
        F.col("test.metrics.qwk").alias("test_qwk"),
        F.col("test.metrics.macro_f1").alias("test_macro_f1"),
        F.col("test.metrics.adjacent_accuracy").alias("test_adjacent_accuracy"),
        "elapsed_hours",
    )

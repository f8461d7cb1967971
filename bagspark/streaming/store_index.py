"""Bloom filters over the slides of a feature store, one per (ingest, bucket) directory.

They are written with every ingest and read before any key: a new batch joins only directories that may hold one of its
slides. Filters are words of 64 bits in an array column, built and asked with column expressions alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS_PER_SLIDE = 20
HASHES = 7
"""With these two a filter wrongly answers yes once in about 5000 slides."""
INDEX_SCHEMA = "bucket int, words int, bits array<bigint>"


def places(slide: str, words: Column) -> Column:
    """The bits of a slide in a filter of so many words."""
    size = (words * 64).cast("bigint")
    return F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda i: F.pmod(F.xxhash64(slide, i), size))


def filters(keys: DataFrame, by: Sequence[str] = ("bucket",)) -> DataFrame:
    """(*by, words, bits) over the distinct slides of each group."""
    by = list(by)
    slides = keys.select(*by, "slide_id").distinct()
    words = F.ceil(F.count(F.lit(1)) * BITS_PER_SLIDE / 64).cast("int").alias("words")
    sizes = slides.groupBy(*by).agg(words)
    marks = slides.join(sizes, by).select(*by, F.explode(places("slide_id", F.col("words"))).alias("_p")).select(
        *by, F.expr("_p div 64").cast("int").alias("word"), F.expr("shiftleft(1L, cast(_p % 64 as int))").alias("mask")
    )
    blank = sizes.select(*by, F.explode(F.sequence(F.lit(0), F.col("words") - 1)).alias("word"), F.lit(0).cast("bigint").alias("mask"))
    bits = marks.unionByName(blank).groupBy(*by, "word").agg(F.bit_or("mask").alias("mask"))
    rows = bits.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("_b"))
    return rows.select(*by, F.size("_b").alias("words"), F.col("_b.mask").alias("bits"))


def bit(bits: Column, place: Column) -> Column:
    """Whether the bit at ``place`` is set."""
    word = F.get(bits, F.floor(place / 64).cast("int"))
    return F.call_function("shiftrightunsigned", word, F.pmod(place, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1


def may_hold(index: DataFrame, slides: DataFrame, by: Sequence[str] = ("ingest", "bucket")) -> DataFrame:
    """(*by): the filters that may know one of the (slide_id, bucket) rows of ``slides``. None that knows one is left out."""
    asked = slides.select("slide_id", "bucket").distinct()
    known = F.forall(places("slide_id", F.col("words")), lambda p: bit(F.col("bits"), p))
    return index.where("words > 0").join(asked, "bucket").where(known).select(*by).distinct()


def names_in(spark: SparkSession, path: str) -> set[str]:
    """The ingests that have a directory under ``path``, on whatever file system it is."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(target):
        return set()
    found = (s.getPath().getName() for s in files.listStatus(target))
    return {n.removeprefix("ingest=") for n in found if n.startswith("ingest=")}


def write_index(spark: SparkSession, rows: str, index: str, name: str) -> None:
    """Filters of the ingest ``name`` from the keys it has written under ``rows``. A mark says that they are complete."""
    keys = spark.read.schema("slide_id bigint, bucket int").parquet(f"{rows}/ingest={name}")
    mark = spark.range(1).selectExpr("-1 AS bucket", "0 AS words", "CAST(array() AS array<bigint>) AS bits")
    filters(keys).unionByName(mark).coalesce(1).write.mode("overwrite").parquet(f"{index}/ingest={name}")


def suspects(spark: SparkSession, rows: str, index: str, name: str, slides: DataFrame) -> tuple[list[tuple[str, int]], list[str]]:
    """((ingest, bucket) directories that may hold a slide of ``slides``, ingests without complete filters), ``name`` left out."""
    there = names_in(spark, rows) - {name, "none"}
    if not there:
        return [], []
    if not names_in(spark, index):
        return [], sorted(there)
    known = spark.read.schema(f"{INDEX_SCHEMA}, ingest string").parquet(index).where(F.col("ingest") != name)
    marked = {r["ingest"] for r in known.where("bucket = -1").select("ingest").distinct().collect()}
    hits = may_hold(known, slides).collect()
    return sorted((r["ingest"], r["bucket"]) for r in hits if r["ingest"] in marked), sorted(there - marked)

"""The corpus pipeline: raw documents to a training order.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept, which are written as
Parquet and read again in between. Null and empty texts, repeated rows and empty tables follow the rules in
each operator's docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagspark.llm.decontamination import decontaminated
from bagspark.llm.jaccard_join import one_per_component
from bagspark.llm.mixing import mix
from bagspark.llm.quality_classifier import accepted
from bagspark.llm.substring_dedup import substring_dedup
from bagspark.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
QUALITY_FROM = 0.3
RUN_WORDS = 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.3 or more."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), QUALITY_FROM).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near copies."""
    return one_per_component(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has are cut out; n_chars follows the text."""
    out = substring_dedup(docs, length=RUN_WORDS, carry=("lang", "source", "n_chars"), keep_whole=True)
    cut = F.col("n_removed") > 0
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: one row per pass over a document, by position; documents of which nothing is taken are left out."""
    return mix(docs, carry=("text", "lang", "n_chars")).where("pass_no > 0")


STAGES = [
    ("quality_classifier", quality), ("jaccard_join", near_copies), ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_items), ("mixing", mixture),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = materialise(docs, name) if k < len(STAGES) - 1 else docs
    return docs

"""Bloom filters in front of the feature store."""

import pytest
from pyspark.sql import functions as F

from bagspark.streaming import ingest as I
from bagspark.streaming import store_index as X


def patches(spark, slides, patches_each=3, pooling="cls"):
    rows = spark.range(slides.start, slides.stop).select(F.col("id").alias("slide_id"), F.explode(F.expr(f"sequence(0L, {patches_each - 1}L)")).alias("patch_idx"))
    return rows.select(
        "*", F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), F.lit("e").alias("encoder"), F.lit(pooling).alias("pooling"),
        F.array(F.col("patch_idx").cast("float")).alias("features"),
    )


def test_filters_know_all_their_slides_and_few_others(spark):
    keys = patches(spark, range(5000), 1).withColumn("bucket", F.pmod("slide_id", F.lit(7)).cast("int")).withColumn("ingest", F.lit("a"))
    index = X.filters(keys, ["ingest", "bucket"]).persist()
    ask = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("slide_id"), F.pmod("id", F.lit(7)).cast("int").alias("bucket"))
    assert X.may_hold(index, ask(0, 5000)).count() == 7
    asked = ask(10_000, 40_000).withColumn("ingest", F.lit("a"))
    yes = index.join(asked, ["ingest", "bucket"]).where(F.forall(X.places("slide_id", F.col("words")), lambda p: X.bit(F.col("bits"), p))).count()
    assert yes < 30
    for s in (0, 17, 4999):
        assert [tuple(r) for r in X.may_hold(index, ask(s, s + 1)).collect()] == [("a", s % 7)]


@pytest.fixture
def history(spark, folder):
    """50 earlier ingests of 20 slides each, with their filters."""
    store = f"{folder}/store"
    old = patches(spark, range(1000)).withColumn("bucket", I.bucket_of()).withColumn("ingest", F.concat(F.lit("old-"), F.expr("slide_id div 20").cast("string")))
    old.repartition(4, "ingest").write.partitionBy("ingest", "bucket").parquet(f"{store}/accepted")
    marks = old.select("ingest").distinct().selectExpr("ingest", "-1 AS bucket", "0 AS words", "CAST(array() AS array<bigint>) AS bits")
    X.filters(old, ["ingest", "bucket"]).unionByName(marks).repartition(4, "ingest").write.partitionBy("ingest").parquet(f"{store}/index/accepted")
    return store


def test_new_slides_read_no_earlier_key(spark, history):
    path, index = f"{history}/accepted", f"{history}/index/accepted"
    new = patches(spark, range(10**6, 10**6 + 1000), 1).withColumn("bucket", I.bucket_of())
    hits, unknown = X.suspects(spark, path, index, "now", new)
    assert unknown == [] and len(hits) <= 3
    mixed = patches(spark, range(40, 45), 1).withColumn("bucket", I.bucket_of())
    hits, unknown = X.suspects(spark, path, index, "now", mixed)
    assert unknown == [] and {i for i, _ in hits} == {"old-2"} and len(hits) <= 5


def landed(spark, folder, name, df):
    df.write.mode("append").parquet(f"{folder}/{name}")
    return f"{folder}/{name}"


def test_ingest_with_false_answers_stays_exactly_once(spark, folder, history, monkeypatch):
    """Filters that always say yes cost reads, never rows; so do directories without filters."""
    src = landed(spark, folder, "src", patches(spark, range(990, 1010)).repartition(3))
    I.stream_ingest(spark, src, history, f"{folder}/c1").awaitTermination()
    kept = spark.read.parquet(f"{history}/accepted").select("slide_id", "patch_idx")
    assert kept.count() == kept.distinct().count() == 3030
    monkeypatch.setattr(X, "may_hold", lambda index, slides, by=("ingest", "bucket"): index.where("words > 0").select(*by).distinct())
    landed(spark, folder, "src", patches(spark, range(1005, 1015)))
    I.stream_ingest(spark, src, history, f"{folder}/c2").awaitTermination()
    monkeypatch.setattr(I, "LISTED", 3)
    landed(spark, folder, "src", patches(spark, range(1010, 1020)))
    I.stream_ingest(spark, src, history, f"{folder}/c3").awaitTermination()
    kept = spark.read.parquet(f"{history}/accepted").select("slide_id", "patch_idx")
    assert kept.count() == kept.distinct().count() == 3060


def test_ingests_without_filters_are_joined_whole(spark, folder):
    store = f"{folder}/store"
    patches(spark, range(30)).withColumn("bucket", I.bucket_of()).write.partitionBy("bucket").parquet(f"{store}/accepted/ingest=crashed")
    src = landed(spark, folder, "src", patches(spark, range(25, 40)))
    I.stream_ingest(spark, src, store, f"{folder}/c1").awaitTermination()
    kept = spark.read.parquet(f"{store}/accepted").select("slide_id", "patch_idx")
    assert kept.count() == kept.distinct().count() == 120
    assert X.names_in(spark, f"{store}/index/accepted") != set() and X.names_in(spark, f"{folder}/none") == set()


def test_of_repeats_in_a_batch_the_first_by_encoder_stays(spark, folder):
    rows = patches(spark, range(10))
    other = rows.withColumn("encoder", F.lit("a")).withColumn("features", F.array(F.lit(9.0).cast("float")))
    src = landed(spark, folder, "src", rows.unionByName(other).unionByName(rows).coalesce(1))
    I.stream_ingest(spark, src, f"{folder}/store", f"{folder}/c1").awaitTermination()
    kept = spark.read.parquet(f"{folder}/store/accepted")
    assert kept.count() == 30 and {r["encoder"] for r in kept.collect()} == {"a"}

"""Joins beside a bucketed feature table: vectors stay, results are those of the plain joins."""

import pytest
from pyspark.sql import functions as F

from bagspark.operators import attention as A
from bagspark.operators import bags as B
from bagspark.operators import cohort as K
from bagspark.sources import layout as L
from bagspark.sources.store import prefer_source

LAYOUT = L.Layout(buckets=5, stretch=4)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rows = spark.range(200).select(
        F.when(F.col("id") < 120, 0).otherwise(F.col("id") % 7).alias("slide_id"), (F.col("id") * 3 - 30).alias("patch_idx"),
        F.array(F.col("id").cast("float"), (F.col("id") % 5).cast("float")).alias("features"),
    )
    L.write_bucketed(rows, "layout_test", LAYOUT, str(tmp_path_factory.mktemp("run") / "store"))
    yield L.read_bucketed(spark, "layout_test")
    spark.sql("DROP TABLE layout_test")


def stay(df):
    exchanged = L.moved(df)
    assert not any("features" in columns or "v" in columns and "slide_id" not in columns for columns in exchanged), exchanged
    return df


def test_a_hot_slide_is_spread_over_buckets(store):
    files = store.where("slide_id = 0").select(F.input_file_name().alias("f")).distinct().count()
    assert files == LAYOUT.buckets


def test_attention_pool_sends_weights(spark, store):
    alpha = store.select("slide_id", "patch_idx", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).withColumn("alpha", F.abs(F.col("patch_idx") + 0.5) * (F.col("k") + 1))
    plain = {r["slide_id"]: r["bag"] for r in A.attention_pool(store.drop("stretch"), alpha).collect()}
    df = A.attention_pool(store, alpha, LAYOUT)
    assert not any("features" in columns for columns in L.moved(df))
    found = {r["slide_id"]: r["bag"] for r in df.collect()}
    assert found.keys() == plain.keys() == set(range(7))
    expected = {}
    for r in store.collect():
        w = abs(r["patch_idx"] + 0.5)
        s = expected.setdefault(r["slide_id"], [0, 0, 0])
        s[0], s[1], s[2] = s[0] + w, s[1] + w * r["features"][0], s[2] + w * r["features"][1]
    for s, (w, a, b) in expected.items():
        for bag in (found[s], plain[s]):
            assert bag == pytest.approx([a / w, b / w])


def test_bags_crops_and_sources_stay(store):
    key = lambda df, *c: sorted(tuple(r) for r in df.select("slide_id", "patch_idx", *c).collect())
    slides = store.where("slide_id <> 3").select("slide_id", (F.col("slide_id") % 3).cast("int").alias("label")).distinct()
    assert key(stay(K.attach_bags(slides, slides, store, LAYOUT)), "label") == key(K.attach_bags(slides, slides, store), "label")
    assert key(stay(B.crop_index(store, 6, LAYOUT)), "crop", "n_crops") == key(B.crop_index(store, 6), "crop", "n_crops")
    stores = [(store.where("slide_id < 3"), 0), (store.where("slide_id > 1"), 1)]
    assert key(stay(prefer_source(stores, LAYOUT)), "priority") == key(prefer_source(stores), "priority")


def test_maps_without_mass_do_not_count(spark, store):
    some = store.where("slide_id = 1")
    alpha = some.select("slide_id", "patch_idx", F.lit(0).alias("k"), F.lit(1.0).alias("alpha"))
    dead = alpha.withColumns({"k": F.lit(1), "alpha": F.lit(0.0)})
    assert A.attention_pool(some, alpha.unionByName(dead)).first()["bag"] == pytest.approx(A.attention_pool(some, alpha).first()["bag"])

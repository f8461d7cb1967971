import numpy as np
import pytest
from pyspark.sql import functions as F

from bagspark.operators import bags as B
from bagspark.operators import cohort as K
from bagspark.session import materialise
from bagspark.sources import store


@pytest.fixture(scope="module")
def patches(spark):
    sizes = {0: 16, 1: 100, 2: 900}
    rows = [(s, i, s % 3) for s, n in sizes.items() for i in range(n)]
    return materialise(spark.createDataFrame(rows, "slide_id bigint, patch_idx bigint, label int"))


def test_crops_cover_every_patch_once(patches):
    out = B.crop_index(patches, 256).groupBy("slide_id").agg(F.count("*").alias("n"), F.countDistinct("crop").alias("c"), F.max("n_crops").alias("m"))
    assert {tuple(r) for r in out.collect()} == {(0, 16, 1, 1), (1, 100, 1, 1), (2, 900, 4, 4)}


def test_draws_are_bounded_distinct_and_reproducible(patches):
    out = B.sample_subbag(patches, 128, samples_per_slide=4, seed=3)
    sizes = {(r["slide_id"], r["draw"]): r["count"] for r in out.groupBy("slide_id", "draw").count().collect()}
    assert sizes == {(s, d): min(n, 128) for s, n in ((0, 16), (1, 100), (2, 900)) for d in range(4)}
    assert out.distinct().count() == out.count()
    a, b = out.where("slide_id = 2 AND draw = 0").select("patch_idx"), out.where("slide_id = 2 AND draw = 1").select("patch_idx")
    assert a.exceptAll(b).count() > 0
    assert out.exceptAll(B.sample_subbag(patches.repartition(9), 128, 4, seed=3)).count() == 0
    first = B.sample_subbag(patches, 128, train=False)
    assert first.where("slide_id = 2").agg(F.max("patch_idx")).first()[0] == 127


def test_balanced_sample_evens_out_classes(spark):
    labels = materialise(spark.createDataFrame([(f"p{i}", 0 if i < 20 else 1) for i in range(400)], "patient_id string, label int"))
    out = B.balanced_sample(labels, n=2000, seed=1)
    per = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert sum(per.values()) == 2000 and abs(per[0] - 1000) < 150
    assert out.where("label = 0").select("patient_id").distinct().count() == 20


@pytest.mark.parametrize("prob", [0.0, 1.0])
def test_mixup_only_swaps_real_patches(patches, prob):
    members, targets = B.bag_mixup(patches, prob=prob, seed=2)
    rows = members.collect()
    assert len({(r["slide_id"], r["patch_idx"]) for r in rows}) == len(rows)
    sizes = {0: 16, 1: 100, 2: 900}
    assert all(r["patch_idx"] < sizes[r["source_slide"]] for r in rows)
    share = {}
    for r in rows:
        share.setdefault(r["slide_id"], []).append(r["source_slide"] == r["slide_id"])
    for t in targets.collect():
        assert t["mixed"] == (prob == 1.0)
        assert np.isclose(t["lam_eff"], np.mean(share[t["slide_id"]]))
    if prob == 0.0:
        assert all(r["source_slide"] == r["slide_id"] for r in rows) and len(rows) == sum(sizes.values())


def test_mixup_of_one_bag_changes_nothing(patches):
    members, targets = B.bag_mixup(patches.where("slide_id = 1"), prob=1.0)
    assert members.count() == 100 and not targets.first()["mixed"]


def test_mixup_empty_result_falls_back(spark):
    one = spark.createDataFrame([(0, 0, 0), (1, 5, 2)], "slide_id bigint, patch_idx bigint, label int")
    lam = spark.createDataFrame([(0, 0.0), (1, 0.0)], "slide_id bigint, lam double")
    members, targets = B.bag_mixup(one, prob=1.0, lambdas=lam)
    assert {tuple(r) for r in members.collect()} == {(0, 5, 1), (1, 0, 0)}
    assert all(r["lam_eff"] == 0.0 for r in targets.collect())


def test_pick_offsets():
    offs = list(range(0, 1536, 64))
    assert B.pick_offsets(offs, None) == offs and B.pick_offsets(offs, 99) == offs
    assert B.pick_offsets(offs, 5) == [offs[int(i * 24 / 5)] for i in range(5)]


def test_bag_size_rounds_half_to_even(spark):
    def size(*n):
        return K.suggest_bag_size(spark.createDataFrame([(i, v) for i, v in enumerate(n)], "slide_id bigint, n_patches bigint")).first()[0]

    assert size(1280) == 512 and size(768) == 512 and size(1792) == 1024 and size(5) == 256 and size(10**6) == 4096
    assert K.suggest_bag_size(spark.createDataFrame([], "slide_id bigint, n_patches bigint")).first()[0] == 2048


def test_store_round_trip_and_priority(spark, folder):
    rows = spark.createDataFrame(
        [(s, i, i * 10, 0, "e", "cls", [float(s), float(i)]) for s in range(3) for i in range(4)],
        "slide_id bigint, patch_idx bigint, x bigint, y bigint, encoder string, pooling string, features array<float>",
    )
    store.write_features(rows, f"{folder}/f")
    assert store.read_features(spark, f"{folder}/f", with_coords=True).count() == 12
    wanted = rows.where("slide_id = 1 AND patch_idx > 1")
    back = store.read_features(spark, f"{folder}/f", wanted)
    assert back.columns == ["slide_id", "patch_idx", "features"] and back.count() == 2
    merged = store.prefer_source([(rows.where("slide_id < 2"), 0), (rows.where("slide_id > 0"), 1)])
    assert {tuple(r) for r in merged.groupBy("slide_id", "priority").count().collect()} == {(0, 0, 4), (1, 0, 4), (2, 1, 4)}


def test_cohort_checks(spark):
    inv = spark.createDataFrame([(0, 500, 64, "a"), (1, 300, 64, "a"), (2, 10, 128, "b")], "slide_id bigint, n_patches bigint, width int, encoder string")
    ids = spark.createDataFrame([(0,), (1,), (7,)], "slide_id bigint")
    row = K.check_cohort(ids, inv)
    assert (row["present"], row["missing"], row["missing_first"], row["median_patches"]) == (2, 1, "7", 400)
    with pytest.raises(K.CohortError, match="width"):
        K.check_cohort(inv, inv)
    with pytest.raises(K.CohortError, match="encoders"):
        K.check_cohort(inv, inv.withColumn("width", F.lit(64)))
    labels = spark.createDataFrame([(0, 1), (7, 2)], "slide_id bigint, label int")
    patches = spark.createDataFrame([(0, 0), (0, 1)], "slide_id bigint, patch_idx bigint")
    with pytest.raises(K.CohortError, match="1 requested"):
        K.attach_bags(labels, labels, patches)
    assert K.attach_bags(labels.where("slide_id = 0"), labels, patches).count() == 2


def test_licences_and_widths(spark):
    reg = K.encoder_registry(spark)
    assert reg.count() == 10
    ok = spark.createDataFrame([("H-Optimus-0",)], "encoder string")
    K.licence_gate(ok, reg)
    with pytest.raises(K.CohortError, match="uni .blocked"):
        K.licence_gate(spark.createDataFrame([("uni",)], "encoder string"), reg)
    K.licence_gate(spark.createDataFrame([("uni",)], "encoder string"), reg, allow_noncommercial=True)
    with pytest.raises(K.CohortError, match="unknown"):
        K.licence_gate(spark.createDataFrame([("nope",)], "encoder string"), reg, True)
    inv = spark.createDataFrame([(0, "h-optimus-0", 3072), (1, "virchow", 2560)], "slide_id bigint, encoder string, width int")
    assert [r["width_ok"] for r in K.expected_width(inv, reg, "cls_mean").orderBy("slide_id").collect()] == [True, True]
    got = K.expected_width(inv, reg, "cls").orderBy("slide_id").collect()
    assert [r["expected_width"] for r in got] == [1536, 1280]


def test_encoder_batches_and_failures(spark):
    rows = materialise(spark.createDataFrame([(0, i, [float(i), 1.0]) for i in range(150)], "slide_id bigint, patch_idx bigint, pixels array<double>"))
    sizes = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(sizes)
    spark.conf.set(sizes, "17")
    try:
        def build():
            def encode(batch):
                assert batch.shape == (64, 2)
                return batch * 2
            return encode
        out = K.encode_tiles(rows.coalesce(1), build, 2, 64)
        assert {r["patch_idx"]: r["features"][0] for r in out.collect()} == {i: 2.0 * i for i in range(150)}
        with pytest.raises(Exception, match="expected"):
            K.encode_tiles(rows, build, 3, 64).collect()
    finally:
        spark.conf.set(sizes, old)


def test_token_pooling_keeps_cls_first(spark):
    x = np.random.default_rng(0).normal(0, 1, (2, 5, 3)).astype(np.float32)
    rows = [(t, k, [float(v) for v in x[t, k]]) for t in range(2) for k in range(5)]
    out = K.cls_mean_pool(spark.createDataFrame(rows, "tile_id bigint, token bigint, features array<float>")).collect()
    for r in out:
        assert np.allclose(r["features"], np.r_[x[r["tile_id"], 0], x[r["tile_id"], 1:].mean(0)], atol=1e-6)


def test_tiles_without_cls_or_patch_tokens_are_pooled(spark):
    rows = [(1, 0, [1.0, 2.0]), (2, 1, [3.0, 4.0]), (2, 3, [5.0, 8.0]), (3, 0, [0.5, 0.0]), (3, 1, None), (4, 0, None), (4, 2, [1.0, 1.0])]
    out = K.cls_mean_pool(spark.createDataFrame(rows, "tile_id bigint, token bigint, features array<float>")).collect()
    none = [None, None]
    assert {r["tile_id"]: r["features"] for r in out} == {1: [1.0, 2.0, *none], 2: [*none, 4.0, 6.0], 3: [0.5, 0.0, *none], 4: [*none, 1.0, 1.0]}


def test_sparse_patch_ids_are_cropped_by_position(spark):
    df = spark.createDataFrame([(1, 1000 * k) for k in range(25)] + [(2, 7)], "slide_id bigint, patch_idx bigint")
    out = B.crop_index(df, 10).orderBy("slide_id", "patch_idx").collect()
    assert [r["crop"] for r in out] == [k // 10 for k in range(25)] + [0] and {r["n_crops"] for r in out if r["slide_id"] == 1} == {3}
    assert B.sample_subbag(df, 10, train=False).groupBy("slide_id").count().orderBy("slide_id").collect() == [(1, 10), (2, 1)]


def test_erf_is_exact_and_other_widths_are_refused(spark):
    import math

    import numpy as np

    from bagspark.plans import scoring

    x = np.concatenate([np.linspace(-8, 8, 4001), [0.0, 1e-300, -1e-9]])
    assert np.abs(scoring.erf(x) - np.array([math.erf(v) for v in x])).max() < 1e-14
    model = scoring.random_weights(64, 16, 4, 2)
    patches = spark.createDataFrame([(1, 0, [0.5] * 48)], "slide_id bigint, patch_idx bigint, features array<float>")
    with pytest.raises(Exception, match="width 48"):
        scoring.score_arrays(patches, [model]).collect()

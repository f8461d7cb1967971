"""Crops: every patch once, one kernel pass, no vector in an exchange."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagspark.operators.splits import SplitError
from bagspark.plans import crops as C
from bagspark.plans import scoring as S
from bagspark.session import materialise

MODELS = [S.random_weights(6, 4, 3, 2, seed=k) for k in range(2)]
STRIDE = 3


@pytest.fixture(scope="module")
def patches(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s, n in (("a", 23), ("b", 1), ("c", 8), ("hot", 90)):
        ids = np.sort(rng.choice(10**6, n, replace=False)) - 500
        rows += [(s, int(i), [float(v) for v in rng.normal(size=6).astype(np.float32)], "x", 1) for i in ids]
    rng.shuffle(rows)
    return materialise(spark.createDataFrame([tuple(r) for r in rows], "slide_id string, patch_idx long, features array<float>, crop string, n int").repartition(5))


def plain(patches, bag_size):
    """Each crop on its own through numpy."""
    groups = {}
    for r in sorted(patches.collect(), key=lambda r: (r["slide_id"], r["patch_idx"])):
        groups.setdefault(r["slide_id"], []).append(r["features"])
    out = {}
    for s, vs in groups.items():
        for c in range(0, len(vs), bag_size):
            x = np.array(vs[c : c + bag_size], np.float32).astype(float)
            h = (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + S.EPS)
            for m, w in enumerate(MODELS):
                logits = []
                for o in range(0, 6, STRIDE):
                    e = np.exp(w.scores(x[:, (o + np.arange(w.window)) % 6]))
                    logits.append(w.head(((e / e.sum(0)).T @ h).mean(0)[None])[0])
                p = 1 / (1 + np.exp(-np.mean(logits, axis=0)))
                out[s, c // bag_size, m] = (len(x), np.cumprod(p))
    return out


@pytest.mark.parametrize("bag_size,at_once", [(8, 10**6), (1000, 10**6), (1, 7), (5, 3)])
def test_crops_equal_the_model_on_each_crop(patches, monkeypatch, bag_size, at_once):
    monkeypatch.setattr(C, "CROPS_AT_ONCE", at_once)
    found = {(r["slide_id"], r["crop"], r["model"]): (r["n"], r["cumulative"]) for r in C.crop_predictions(patches, MODELS, bag_size, STRIDE).collect()}
    expected = plain(patches, bag_size)
    assert found.keys() == expected.keys()
    for key, (n, cum) in expected.items():
        assert found[key][0] == n and np.allclose(found[key][1], cum, atol=1e-9)


def test_clustered_stores_give_the_same_and_leave_only_logits(patches):
    ordered = materialise(patches.orderBy("slide_id", "patch_idx").coalesce(1))
    parts = C.crop_parts(ordered, MODELS, C.Starts.of(C.crop_bounds(ordered, 8)), STRIDE, clustered=True).collect()
    assert all(p["logits"] is not None and p["total"] is None for p in parts) and len(parts) == 2 * (3 + 1 + 1 + 12)
    a, b = (sorted((r["slide_id"], r["grade"], round(r["ambiguity"], 9)) for r in C.score_crops(p, MODELS, 8, STRIDE, clustered=c).collect()) for p, c in ((patches, False), (ordered, True)))
    assert a == b and len(a) == 4


def test_one_crop_is_the_whole_slide(patches):
    whole = {r["slide_id"]: r["expected_grade"] for r in S.score_slides(patches, MODELS, STRIDE).collect()}
    crops = {r["slide_id"]: r["expected_grade"] for r in C.score_crops(patches, MODELS, 10**6, STRIDE).collect()}
    assert whole.keys() == crops.keys() and all(abs(whole[s] - crops[s]) < 1e-9 for s in whole)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_vector_is_exchanged_and_bounds_read_keys_only(patches):
    bounds = C.crop_bounds(patches, 8)
    assert "features" not in plan(bounds)
    kernel = plan(C.crop_parts(patches, MODELS, C.Starts.of(bounds), STRIDE))
    assert "Exchange" not in kernel and "features" in kernel


def test_only_asked_slides_are_scored_and_the_lock_holds(spark, patches):
    asked = spark.createDataFrame([("a",), ("c",), ("absent",)], "slide_id string")
    assert {r["slide_id"] for r in C.score_crops(patches, MODELS, 8, STRIDE, slides=asked).collect()} == {"a", "c"}
    splits = spark.createDataFrame([("a", 0, True, None), ("c", 2, True, None), ("b", 1, False, 0)], "patient_id string, label int, is_test boolean, fold int")
    with pytest.raises(SplitError):
        C.evaluate_crops(patches, MODELS, splits, 8)
    row = C.evaluate_crops(patches, MODELS, splits, 8, unlock=True, bootstrap=0, stride=STRIDE).first()
    assert row["n"] == 2 and row["n_models"] == 2


def test_repeated_ids_stay_together_and_empty_input_gives_nothing(patches):
    twice = patches.unionByName(patches.where("slide_id = 'a'"))
    rows = C.crop_predictions(twice, MODELS[:1], 8, STRIDE).where("slide_id = 'a'").collect()
    assert sum(r["n"] for r in rows) == 46
    assert C.score_crops(patches.where(F.lit(False)), MODELS, 8, STRIDE).collect() == []
    with pytest.raises(ValueError):
        C.crop_bounds(patches, 0)

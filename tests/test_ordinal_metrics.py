import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagspark.functions import ordinal as O
from bagspark.operators import losses, metrics
from bagspark.plans.evaluate import evaluate_locked
from bagspark.operators.splits import SplitError


def sig(x):
    return 1 / (1 + np.exp(-np.asarray(x)))


@pytest.fixture(scope="module")
def logits(spark):
    rng = np.random.default_rng(0)
    z = np.vstack([rng.normal(0, 3, (60, 2)), [[9, 9], [-9, 9], [9, -9]]])
    y = rng.integers(0, 3, len(z))
    df = spark.createDataFrame([(i, [float(a) for a in r], int(t)) for i, (r, t) in enumerate(zip(z, y))], "id bigint, logits array<double>, y_true int")
    return metrics.prediction_record(df.withColumn("cumulative", O.corn_cumulative("logits"))), z, y


def test_cumulative_is_monotone_and_probabilities_sum_to_one(logits):
    df, z, _ = logits
    for r in df.collect():
        cum = np.cumprod(sig(z[r["id"]]))
        assert np.allclose(r["cumulative"], cum) and cum[1] <= cum[0]
        assert np.isclose(sum(r["probabilities"]), 1.0) and min(r["probabilities"]) >= 0
        assert r["grade"] == int((cum > 0.5).sum())
        assert np.isclose(r["confidence"], r["probabilities"][r["grade"]])


def test_saturated_logits(logits):
    df, z, _ = logits
    got = {r["id"]: r["grade"] for r in df.where("id >= 60").collect()}
    assert [got[i] for i in (60, 61, 62)] == [2, 0, 1]


def test_threshold_is_strict(spark):
    row = spark.range(1).select(O.corn_predict(F.array(F.lit(0.5), F.lit(0.5))).alias("g")).first()
    assert row["g"] == 0


def test_ambiguity_orders_slides(spark):
    df = spark.createDataFrame([([0.97, 0.03],), ([0.51, 0.49],)], "cumulative array<double>")
    a, b = [r[0] for r in df.select(O.ambiguity("cumulative")).collect()]
    assert a < 0.05 < 0.45 < b


def test_losses_match_numpy(logits):
    df, z, y = logits
    p = sig(z)
    bce = lambda q, t: -(t * np.log(q) + (1 - t) * np.log(1 - q))
    want = np.mean([bce(p[:, 0], y > 0).mean(), bce(p[y > 0, 1], y[y > 0] > 1).mean()])
    assert np.isclose(losses.corn_loss(df).first()["corn"], want)
    assert losses.corn_loss(df.where("y_true > 99")).first()["corn"] == 0.0
    only_zero = df.where("y_true = 0")
    assert np.isclose(losses.corn_loss(only_zero).first()["corn"], bce(p[y == 0, 0], 0).mean())
    cum = np.clip(np.cumprod(p, axis=1), 1e-6, 1 - 1e-6)
    t = np.stack([y > 0, y > 1], axis=1)
    soft = df.withColumn("cum_targets", O.cumulative_targets("y_true"))
    assert np.isclose(losses.corn_loss_soft(soft).first()["corn"], bce(cum, t).mean())


def kappa(t, p, k=3):
    o = np.zeros((k, k))
    for a, b in zip(t, p):
        o[a, b] += 1
    w = (np.arange(k)[:, None] - np.arange(k)) ** 2
    e = np.outer(o.sum(1), o.sum(0)) / len(t)
    return 1 - (w * o).sum() / (w * e).sum()


def frame(spark, t, p):
    return spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(t, p))], "id bigint, y_true int, y_pred int")


def test_metrics_edge_cases(spark):
    t = [0, 1, 2, 1, 0, 2]
    assert metrics.grading_metrics(frame(spark, t, t)).first()["qwk"] == 1.0
    assert metrics.grading_metrics(frame(spark, t, [2 - v for v in t])).first()["qwk"] < 0
    off = metrics.grading_metrics(frame(spark, [0, 1, 1, 2], [1, 0, 2, 1])).first()
    assert off["adjacent_accuracy"] == 1.0 and off["accuracy"] == 0.0 and off["mean_absolute_error"] == 1.0
    one = metrics.grading_metrics(frame(spark, [1, 1, 1], [1, 1, 1])).first()
    assert one["qwk"] is None and one["balanced_accuracy"] == 1.0 and one["f1_0"] == 0.0
    empty = metrics.grading_metrics(frame(spark, [0], [0]).where("id > 5")).first()
    assert empty["n"] == 0 and empty["qwk"] is None
    assert metrics.confusion(frame(spark, [0], [2])).count() == 9


def test_bootstrap_brackets_and_matches_row_resampling(spark):
    rng = np.random.default_rng(1)
    t = rng.integers(0, 3, 150)
    p = np.clip(t + rng.integers(-1, 2, 150) * (rng.random(150) < 0.4), 0, 2)
    ci = metrics.bootstrap_qwk_ci(frame(spark, t, p), n_boot=1500).first()
    assert ci["qwk_lo"] < kappa(t, p) < ci["qwk_hi"]
    brute = [kappa(t[i], p[i]) for i in rng.integers(0, 150, (1500, 150))]
    assert np.allclose([ci["qwk_lo"], ci["qwk_hi"]], np.percentile(brute, [2.5, 97.5]), atol=0.03)
    same = metrics.bootstrap_qwk_ci(frame(spark, t, p), n_boot=1500).first()
    assert same == ci
    single = metrics.bootstrap_qwk_ci(frame(spark, [1] * 9, [0, 1, 2] * 3), n_boot=50).first()
    assert single["n_used"] == 0 and single["qwk_lo"] is None


def test_auc_and_selective_prediction(spark):
    rng = np.random.default_rng(2)
    t, p = rng.integers(0, 3, 200), rng.integers(0, 3, 200)
    signal = np.round(rng.random(200), 1)
    df = spark.createDataFrame([(i, int(a), int(b), float(s)) for i, (a, b, s) in enumerate(zip(t, p, signal))], "id bigint, y_true int, y_pred int, ambiguity double")
    pos, neg = signal[t != p], signal[t == p]
    want = np.mean([(1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg])
    assert np.isclose(metrics.error_detection_auc(df, ["ambiguity"]).first()["auc"], want)
    curve = sorted(metrics.selective_prediction(df, buckets=7).collect(), key=lambda r: r["bucket"])
    order = sorted(range(200), key=lambda i: (signal[i], i))
    edges = np.cumsum([29] * 4 + [28] * 3)
    assert [r["n"] for r in curve] == list(edges)
    assert np.isclose(curve[2]["qwk"], kappa(t[order[:87]], p[order[:87]]))


def test_corrected_t_widens_the_interval(spark):
    rows = [(r, f, a, float(s)) for r in range(4) for f in range(5) for a, s in (("x", 0.3 + f / 50), ("y", 0.32 + (r * f % 3) / 40))]
    out = metrics.corrected_resampled_t(spark.createDataFrame(rows, "repeat int, fold int, arm string, score double"), "x", "y", 0.25).first()
    assert out["n"] == 20
    assert np.isclose(out["corrected_se"] / out["naive_se"], np.sqrt((1 / 20 + 0.25) / (1 / 20)))


def test_contextualise_band(spark):
    df = spark.createDataFrame([(0.49,), (0.50,), (0.70,), (0.71,), (None,)], "qwk double")
    assert [r["band"] for r in metrics.contextualise(df).collect()] == ["below", "inside", "inside", "exceeds", None]


def test_ensemble_spread_of_one_model(spark):
    df = spark.createDataFrame([(1, 0, [0.9, 0.2])], "slide_id bigint, model int, cumulative array<double>")
    row = metrics.ensemble_predict(df).first()
    assert row["spread_samp"] is None and row["spread_pop"] == 0.0


def test_locked_evaluation_needs_the_key(spark):
    cums = spark.createDataFrame([("a", 0, [0.9, 0.2]), ("b", 0, [0.1, 0.05])], "patient_id string, model int, cumulative array<double>")
    splits = spark.createDataFrame([("a", 1, True, None), ("b", 0, False, 0)], "patient_id string, label int, is_test boolean, fold int")
    with pytest.raises(SplitError):
        evaluate_locked(cums, splits)
    row = evaluate_locked(cums, splits, unlock=True, bootstrap=20).first()
    assert row["n"] == 1 and row["accuracy"] == 1.0


def test_loss_report_parts(spark):
    parts = spark.createDataFrame([(1.0, 0.5, 0.2, 0.4, 0.9)], "corn double, soft_qwk double, stabilisation double, diversity double, attn_entropy double")
    row = losses.loss_report(parts).first()
    assert row["qwk"] is None and row["attn_entropy"] is None and row["attn_entropy_raw"] == 0.9
    assert np.isclose(row["total"], 1.0 + 0.2 + 0.04)
    mixed = losses.loss_report(parts, lambda_qwk=1.0, mixed=True).first()
    assert mixed["qwk"] is None


def test_grades_outside_the_classes_are_counted(spark):
    from bagspark.operators.metrics import grading_metrics

    df = spark.createDataFrame([(0, 0), (1, 1), (3, 3), (2, 3)], "y_true int, y_pred int")
    r = grading_metrics(df).first()
    assert (r["n"], r["accuracy"], r["adjacent_accuracy"], r["mean_absolute_error"]) == (4, 0.75, 1.0, 0.25)
    assert r["f1_2"] == 0.0 and r["qwk"] == 1.0


def test_both_bootstraps_agree_and_odd_inputs_have_a_result(spark):
    rows = [(i % 3, (i + (i % 5 == 0)) % 3) for i in range(240)]
    preds = spark.createDataFrame(rows, "y_true int, y_pred int")
    a, b = (metrics.bootstrap_qwk_ci(preds, n_boot=1500, seed=4, method=m).first() for m in ("multinomial", "hash"))
    assert a["n_used"] == b["n_used"] == 1500
    assert abs(a["qwk_lo"] - b["qwk_lo"]) < 0.02 and abs(a["qwk_hi"] - b["qwk_hi"]) < 0.02
    again = metrics.bootstrap_qwk_ci(preds.repartition(7), n_boot=1500, seed=4, method="hash").first()
    assert again == b and metrics.bootstrap_qwk_ci(preds, n_boot=1500, seed=5, method="hash").first() != b
    for odd in (preds.where("false"), preds.where("y_true = 1")):
        assert tuple(metrics.bootstrap_qwk_ci(odd, n_boot=20, method="hash").first()) == (None, None, 0)
    with pytest.raises(ValueError):
        metrics.bootstrap_qwk_ci(preds, method="other")


def test_hashed_draws_count_every_row_of_every_resample(spark):
    counts = np.array([3, 0, 1, 0, 5, 2, 1, 0, 2])
    kappas = metrics._hashed_kappas(spark, counts, 30, 0, 3).collect()
    expected = []
    for b in range(30):
        table = np.zeros(9)
        for d in range(14):
            word = hashlib.md5(f"0|{b}|{d // 4}".encode()).hexdigest()[8 * (d % 4) : 8 * (d % 4) + 8]
            table[np.searchsorted(np.cumsum(counts), int(word, 16) / 2**32 * 14 // 1, side="right")] += 1
        expected.append(float(metrics.resampled_kappa(table.reshape(3, 3))))
    assert sorted(round(r["qwk"], 9) for r in kappas) == sorted(round(k, 9) for k in expected if k == k)

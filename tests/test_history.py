"""Batch and streaming early stopping against a sequential restatement."""

import numpy as np
import pytest

from bagspark.operators import history as H
from bagspark.session import materialise, scratch_path
from bagspark.streaming import monitor as M


def restated(values, patience=20, min_delta=0.002, min_epochs=20, mode="max"):
    sign = 1 if mode == "max" else -1
    best, best_epoch, smooth, bad, stop = None, None, [], 0, None
    for e, raw in enumerate(values):
        v = raw * sign
        if best is None or v > best + min_delta:
            best, best_epoch = v, e
        med = float(np.median([x * sign for x in values[max(0, e - 4) : e + 1]]))
        bad = 0 if not smooth or med > max(smooth) + min_delta else bad + 1
        smooth.append(med)
        slope = np.polyfit(range(10), smooth[-10:], 1)[0] if len(smooth) >= 10 else None
        if stop is None and e >= min_epochs:
            if bad >= patience:
                stop = (e, "patience", bad)
            elif slope is not None and abs(slope) < 0.001 and bad >= patience // 2:
                stop = (e, "plateau", bad)
    return stop or (None, None, None), best * sign, best_epoch


def curves():
    rng = np.random.default_rng(0)
    flat = [0.5] * 60
    spike = [0.4 + 0.0001 * e for e in range(60)]
    spike[12] = 0.9
    climbing = [0.01 * e for e in range(60)]
    drop = [0.3 + 0.01 * min(e, 25) - 0.008 * max(0, e - 25) for e in range(60)]
    shaped = [1 / (1 + e) for e in range(60)]
    settled = [0.05 * min(e, 9) for e in range(60)]
    return [flat, spike, climbing, drop, shaped, settled] + [list(rng.normal(0.5, 0.1, 60)) for _ in range(6)] + [list(rng.normal(0.5, 0.003, 60)) for _ in range(4)]


@pytest.fixture(scope="module")
def histories(spark):
    rows = [(r, 0, e, float(v)) for r, c in enumerate(curves()) for e, v in enumerate(c)]
    return materialise(spark.createDataFrame(rows, "run bigint, fold bigint, epoch int, metric double").repartition(3))


@pytest.mark.parametrize("mode", ["max", "min"])
def test_batch_matches_sequence(histories, mode):
    stops = {r["run"]: (r["stop_epoch"], r["reason"], r["num_bad"]) for r in H.early_stopping(histories, mode=mode).collect()}
    bests = {r["run"]: (r["best"], r["best_epoch"]) for r in H.best_epoch(histories, mode=mode).collect()}
    for run, curve in enumerate(curves()):
        stop, best, at = restated(curve, mode=mode)
        assert stops[run] == stop, run
        assert np.isclose(bests[run][0], best) and bests[run][1] == at
    if mode == "max":
        assert stops[0][1] == "patience" and stops[5][1] == "plateau" and stops[2][0] is None


def test_stream_matches_batch_over_several_batches(spark, histories):
    src, ckpt = scratch_path(spark, "m"), scratch_path(spark, "c")
    out = scratch_path(spark, "d")
    for lo, hi in ((0, 15), (15, 40), (40, 60)):
        histories.where(f"epoch >= {lo} AND epoch < {hi}").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(histories.schema).parquet(src)
        got = M.drain(M.stream_early_stop(stream), out, ckpt)
    rows = got.collect()
    assert len(rows) == histories.count()
    first = {}
    for r in sorted(rows, key=lambda r: r["epoch"]):
        if r["stop"]:
            first.setdefault(r["run"], (r["epoch"], r["reason"], r["num_bad"]))
    for run, curve in enumerate(curves()):
        stop, best, at = restated(curve)
        assert first.get(run, (None, None, None)) == stop
        last = [r for r in rows if r["run"] == run and r["epoch"] == 59][0]
        assert np.isclose(last["best"], best) and last["best_epoch"] == at
    histories.where("epoch < 3").coalesce(1).write.mode("append").parquet(src)
    again = M.drain(M.stream_early_stop(spark.readStream.schema(histories.schema).parquet(src)), out, ckpt)
    assert again.count() == len(rows)


def test_median_prune_exempts_startup_and_warmup(spark):
    rows = [(0, t, s, 0.1 if t in (2, 9) else 0.5 + 0.001 * t) for t in range(10) for s in range(4)]
    out = {r["trial"]: r["pruned_at"] for r in H.median_prune(spark.createDataFrame(rows, "study int, trial int, step int, score double")).collect()}
    assert out[2] is None and out[9] == 2 and all(out[t] is None for t in range(9))


def test_weight_selection_needs_a_strict_gain(spark):
    rows = [(0, "best-epoch", 0.4), (0, "ema", 0.4), (1, "best-epoch", 0.4), (1, "ema", 0.5), (2, "best-epoch", 0.3)]
    out = {r["fold"]: r["selected"] for r in H.weight_selection(spark.createDataFrame(rows, "fold int, weights string, score double")).collect()}
    assert out == {0: "best-epoch", 1: "ema", 2: "best-epoch"}


def test_slopes_at_the_threshold_are_decided_as_in_sql(spark):
    """Ten values in hundredths whose exact slope is the limit: rounding decides, and must do so as the SQL does."""
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(7)
    weights, runs = 2 * np.arange(10) - 9, []
    while len(runs) < 300:
        cents = rng.exponential(5000, 10).astype(int)
        cents[9] += (8250 - cents @ weights) // 9
        missing = 8250 - cents @ weights  # 0 to 8 ninths: made up by the pair (8, 9), whose weights are 7 and 9
        cents[8] += (4 * missing) % 9
        cents[9] += (missing - 7 * ((4 * missing) % 9)) // 9
        if cents @ weights == 8250 and 0 <= cents.min() and cents.max() < 90_000:
            runs.append([0.0] * 12 + [2.0] + [int(c) / 100 / 500 for c in cents])
    rows = [(r, 0, e, v) for r, values in enumerate(runs) for e, v in enumerate(values, 1)]
    con = duckdb.connect()
    con.execute("CREATE TABLE h (run BIGINT, fold BIGINT, epoch INT, metric DOUBLE)")
    con.executemany("INSERT INTO h VALUES (?, ?, ?, ?)", rows)
    slopes = "SELECT run, epoch, abs(regr_slope(metric, epoch) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) < 0.001 AS flat FROM h"
    want = dict(con.execute(f"SELECT run, flat FROM ({slopes}) s WHERE epoch = 23").fetchall())
    assert 0 < sum(want.values()) < 300
    history = materialise(spark.createDataFrame(rows, "run bigint, fold bigint, epoch int, metric double"))
    batch = {r["run"]: r["reason"] == "plateau" for r in H.early_stopping(history, smooth_window=1).collect()}
    assert batch == want
    src = scratch_path(spark, "m")
    history.write.parquet(src)
    stream = M.stream_early_stop(spark.readStream.schema(history.schema).parquet(src), smooth_window=1)
    online = M.drain(stream, scratch_path(spark, "d"), scratch_path(spark, "c")).where("epoch = 23").collect()
    assert {r["run"]: r["reason"] == "plateau" for r in online} == want


def test_slope_with_missing_and_unbounded_values(spark):
    values = [0.1 * e for e in range(12)]
    values[3], nan = None, [0.5] * 11 + [float("nan")]
    rows = [(r, 0, e, v) for r, series in enumerate((values, nan)) for e, v in enumerate(series)]
    out = H.plateau_slope(spark.createDataFrame(rows, "run bigint, fold bigint, epoch int, smoothed double")).collect()
    at = {(r["run"], r["epoch"]): r["slope"] for r in out}
    assert at[0, 8] is None and np.isclose(at[0, 9], 0.1) and np.isclose(at[0, 11], 0.1)
    assert at[1, 9] == 0 and np.isnan(at[1, 11])

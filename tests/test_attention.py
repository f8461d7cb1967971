"""Attention operators and the scoring job against numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bagspark.functions import vectors as V
from bagspark.operators import attention as A
from bagspark.plans import scoring as S
from bagspark.session import materialise

DIM, STRIDE = 32, 8


@pytest.fixture(scope="module")
def bags(spark):
    rng = np.random.default_rng(0)
    data = {s: rng.normal(0, 1, (n, DIM)).astype(np.float32) for s, n in enumerate([1, 7, 40, 300])}
    rows = [(s, i, [float(v) for v in x]) for s, m in data.items() for i, x in enumerate(m)]
    return materialise(spark.createDataFrame(rows, "slide_id bigint, patch_idx bigint, features array<float>")), data


@pytest.fixture(scope="module")
def models():
    return [S.random_weights(DIM, 12, 6, 3, seed=s) for s in (1, 2)]


def softmax(z):
    e = np.exp(z - z.max(axis=0))
    return e / e.sum(axis=0)


def reference(x, models):
    """(grade inputs, patch attention) of one slide, restated with plain matrices."""
    x = x.astype(float)
    h = (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5)
    cums, attention = [], np.zeros(len(x))
    offsets = range(0, DIM, STRIDE)
    for m in models:
        logits = 0
        for o in offsets:
            w = np.concatenate([x[:, o:], x[:, :o]], axis=1)[:, : m.window]
            a = np.tanh(w @ m.value + m.value_bias) / (1 + np.exp(-(w @ m.gate + m.gate_bias)))
            alpha = softmax(a @ m.score + m.score_bias)
            attention += alpha.mean(1) / (len(offsets) * len(models))
            u = (alpha.T @ h).mean(0) @ m.head_in + m.head_in_bias
            gelu = 0.5 * u * (1 + np.array([math.erf(v / math.sqrt(2)) for v in u]))
            logits = logits + (gelu @ m.head_out + m.head_out_bias) / len(offsets)
        cums.append(np.cumprod(1 / (1 + np.exp(-logits))))
    return np.mean(cums, axis=0), np.mean(np.std(cums, axis=0)), attention


def test_score_slides_matches_numpy(bags, models):
    df, data = bags
    out = {r["slide_id"]: r for r in S.score_slides(df.repartition(5), models, STRIDE).collect()}
    loose = {r["slide_id"]: r for r in S.score_slides(df.repartition(3), models, STRIDE, clustered=True).collect()}
    assert all(np.allclose(loose[s]["cumulative"], out[s]["cumulative"]) for s in data)
    attn = {}
    for r in S.patch_attention(df, models, STRIDE).collect():
        attn.setdefault(r["slide_id"], {})[r["patch_idx"]] = r["alpha"]
    for s, x in data.items():
        cum, spread, attention = reference(x, models)
        assert np.allclose(out[s]["cumulative"], cum, atol=1e-9)
        assert np.isclose(out[s]["spread_pop"], spread)
        assert np.allclose([attn[s][i] for i in range(len(x))], attention, atol=1e-9)
        assert np.isclose(sum(attn[s].values()), 1.0)


def test_score_bound_holds(models):
    x = np.random.default_rng(0).normal(0, 100, (500, 12))
    assert all(np.abs(m.scores(x)).max() <= m.bound for m in models)


def test_maps_and_audit(bags, models):
    df, data = bags
    maps = materialise(S.subspace_maps(df, models[0], STRIDE))
    got = {r["slide_id"]: r for r in A.map_summary(maps).collect()}
    pairs = {(r["slide_id"], r["a"], r["b"]): r for r in A.pairwise_maps(maps).collect()}
    m = {}
    for r in maps.collect():
        m.setdefault(r["slide_id"], {}).setdefault(r["k"], {})[r["patch_idx"]] = r["alpha"]
    for s in (1, 2, 3):
        table = np.array([[m[s][k][i] for i in range(len(data[s]))] for k in range(4)])
        c = np.corrcoef(table)
        assert np.isclose(got[s]["correlation"], c[~np.eye(4, dtype=bool)].mean())
        assert np.isclose(got[s]["peakedness"], np.mean(table.max(1) / table.mean(1)))
        assert np.isclose(got[s]["ensembled"], table.mean(0).max() / table.mean(0).mean())
        assert np.isclose(pairs[s, 0, 2]["correlation"], c[0, 2])
        assert np.isclose(pairs[s, 1, 3]["cosine"], table[1] @ table[3] / np.linalg.norm(table[1]) / np.linalg.norm(table[3]))
    arms = S.attention_audit(df, models[0], stride=STRIDE).collect()
    assert {r["arm"] for r in arms} == {"trained", "control"} and len({r["more_peaked"] for r in arms}) == 1


def test_overlap_of_identical_and_disjoint_maps(spark):
    rows = [(1, i, k, float(i if k < 2 else -i)) for i in range(50) for k in range(3)]
    out = A.subspace_topk_overlap(spark.createDataFrame(rows, "slide_id bigint, patch_idx bigint, k int, alpha double"), 10).first()
    assert np.isclose(out["overlap"], 1 / 3) and np.isclose(out["chance"], 0.2)


def test_softmax_and_sigmoid_ignore_scale_of_group(spark):
    rows = [(1, i, 0, 1000.0 + i) for i in range(5)] + [(2, 0, 0, -1000.0)]
    df = spark.createDataFrame(rows, "slide_id bigint, patch_idx bigint, k int, score double")
    soft = {(r["slide_id"], r["patch_idx"]): r["alpha"] for r in A.masked_softmax(df).collect()}
    assert np.allclose([soft[1, i] for i in range(5)], softmax(np.arange(5.0))) and soft[2, 0] == 1.0
    sig = A.normalised_sigmoid(df).where("slide_id = 2").first()
    assert 0 <= sig["alpha"] < 1e-6


def attn_frame(spark, weights):
    return spark.createDataFrame([(1, i, float(w)) for i, w in enumerate(weights)], "slide_id bigint, patch_idx bigint, alpha double")


def test_uniform_attention_is_rejected_and_peaked_accepted(spark):
    flat = A.attention_informative(attn_frame(spark, np.full(3000, 1 / 3000))).first()
    assert not flat["informative"] and np.isclose(flat["top1_share"], 1.0) and np.isclose(flat["entropy_ratio"], 1.0, atol=1e-6)
    w = np.ones(3000)
    w[:30] *= 200
    peaked = A.attention_informative(attn_frame(spark, w / w.sum())).first()
    assert peaked["informative"]
    bad = A.attention_informative(attn_frame(spark, [0.0, 0.0]), slides=spark.createDataFrame([(1,), (9,)], "slide_id bigint"))
    assert {r["slide_id"]: r["reason"] for r in bad.collect()} == {1: "no positive finite sum", 9: "no patches"}


def test_grid_overlay_and_resize(spark):
    rng = np.random.default_rng(5)
    cells = [(int(c % 6), int(c // 6)) for c in rng.choice(30, 22, replace=False)]
    rows = [(1, i, x * 10 + 3, y * 10 + 4, float(v)) for i, ((x, y), v) in enumerate(zip(cells + cells[:5], rng.random(27)))]
    grid = A.attention_to_grid(spark.createDataFrame(rows, "slide_id bigint, patch_idx bigint, x bigint, y bigint, alpha double"), 10)
    sums = {}
    for _, _, x, y, v in rows:
        sums.setdefault((y // 10, x // 10), []).append(v)
    mean = {k: np.mean(v) for k, v in sums.items()}
    lo, hi = np.percentile(list(mean.values()), [50, 99])
    got = {(r["cy"], r["cx"]): r["value"] for r in grid.collect()}
    h, w = max(k[0] for k in got) + 1, max(k[1] for k in got) + 1
    assert len(got) == h * w
    for k, v in got.items():
        want = np.clip((mean[k] - lo) / (hi - lo), 0, 1) ** 0.5 if k in mean else 0.0
        assert np.isclose(v, want)
    big = {(r["oy"], r["ox"]): r["value"] for r in A.resize_nearest(grid, 13, 17).collect()}
    assert len(big) == 13 * 17 and all(np.isclose(v, got[oy * h // 13, ox * w // 17]) for (oy, ox), v in big.items())
    rgba = A.overlay_alpha(grid).collect()
    assert all(r["a"] == (0 if r["value"] < 0.15 else int(min(max(r["value"] * 255 * 0.55, 0), 255))) for r in rgba)


def test_window_and_norm(spark):
    assert V.window_offsets(1536, 256, 64) == list(range(0, 1536, 64))
    with pytest.raises(ValueError):
        V.window_offsets(8, 9, 1)
    x = np.random.default_rng(0).normal(3, 2, 12)
    df = spark.createDataFrame([([float(v) for v in x],)], "v array<double>")
    row = df.select(V.wrapped_slice(F.col("v"), F.lit(9), 5).alias("w"), V.layer_norm(F.col("v")).alias("n")).first()
    assert np.allclose(row["w"], np.r_[x[9:], x[:2]])
    assert np.allclose(row["n"], (x - x.mean()) / np.sqrt(x.var() + 1e-5))


def test_softmax_of_extreme_scores_joins_rows_once(spark, monkeypatch):
    scores = {0: [1000.0, 999.0, -1000.0], 1: [-2000.0, -2001.5], 2: [0.0, float("-inf"), 31.9, 32.1, 96.0, None]}
    rows = [(s, i, 0, v) for s, vs in scores.items() for i, v in enumerate(vs)]
    calls, attach = [], A.attach_stats
    monkeypatch.setattr(A, "attach_stats", lambda *a, **k: calls.append(1) or attach(*a, **k))
    out = A.masked_softmax(spark.createDataFrame(rows, "slide_id bigint, patch_idx bigint, k int, score double"), with_size=True).collect()
    assert len(calls) == 1 and {(r["slide_id"], r["n"]) for r in out} == {(s, len(vs)) for s, vs in scores.items()}
    for r in out:
        vs = np.array([v for v in scores[r["slide_id"]] if v is not None])
        share = np.exp(vs - vs.max()) / np.exp(vs - vs.max()).sum()
        assert r["alpha"] is None if r["score"] is None else np.isclose(r["alpha"], share[list(vs).index(r["score"])], rtol=1e-12)


def test_gram_sums_of_many_slides_make_no_frame_per_slide(monkeypatch):
    rng = np.random.default_rng(3)
    maps = {s: [[1, 2, 4], [0, 3], [5]][s % 3] for s in range(300)}
    rows = pd.DataFrame([(s, p, k, rng.random()) for s, ks in maps.items() for p in range(1 + s % 4) for k in ks], columns=["slide_id", "patch_idx", "k", "alpha"])
    frames, frame = [], pd.DataFrame
    monkeypatch.setattr(A.pd, "DataFrame", lambda *a, **k: frames.append(1) or frame(*a, **k))
    out = A.gram_sums()(rows)
    monkeypatch.undo()
    assert len(frames) < 10 and len(out) == 400
    for r in out.itertuples():
        x, y = (rows[(rows.slide_id == r.slide_id) & (rows.k == k)].alpha.to_numpy() for k in (r.a, r.b))
        assert np.allclose([r.n, r.ab, r.aa, r.bb, r.sa, r.sb], [len(x), x @ y, x @ x, y @ y, x.sum(), y.sum()])
    for lost in (0, -1):
        with pytest.raises(ValueError, match="slide 298: some patches lack some"):
            A.gram_sums()(rows.drop(index=rows[rows.slide_id == 298].index[lost]))


def test_topk_overlap_ships_each_patch_once_and_packs_slides_cut_by_chunks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(A, "CHUNK_ROWS", 500)
    rows = [(f"s{s}", int(p), k, float(np.round(rng.random(), 1))) for s, n in ((0, 900), (1, 8), (2, 40)) for p in range(n) for k in range(3)]
    rows += [("s3", p, k, [None, float("nan"), 0.5][(p + k) % 3]) for p in range(30) for k in range(3)] + [(None, 1, 0, 1.0)]
    maps = spark.createDataFrame(rows, "slide_id string, patch_idx bigint, k int, alpha double").repartition(5)
    df = A.subspace_topk_overlap(maps, 10)
    got = {r["slide_id"]: (r["overlap"], r["chance"]) for r in df.collect()}
    place = lambda a: (2, 0) if a is None else (0, 0) if a != a else (1, -a)
    want = {}
    for s, n in (("s0", 900), ("s1", 8), ("s2", 40), ("s3", 30)):
        tops = [{r[1] for r in sorted((r for r in rows if r[0] == s and r[2] == k), key=lambda r: (place(r[3]), r[1]))[:10]} for k in range(3)]
        kept = min(10, n)
        want[s] = (sum(len(tops[i] & tops[j]) for i in range(3) for j in range(i)) / (3 * kept), kept / n)
    assert got.keys() == want.keys()
    assert all(np.allclose(got[s], want[s]) for s in want)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()

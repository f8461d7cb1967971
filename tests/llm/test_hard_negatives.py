import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagspark.llm import hard_negatives as H
from tests.conftest import rows

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    *[T.StructField(c, T.StringType()) for c in ("shard", "cluster", "positives", "score", "rank", "vec", "r")],
])
INF, NAN = float("inf"), float("nan")


def frame(spark, data):
    return spark.createDataFrame([(*r, *["x"] * 7) for r in data], SCHEMA)


def table(n=900, width=6, seed=1):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        v = [rng.gauss(0, 0.4) for _ in range(width)]
        if data and rng.random() < 0.3:
            v = rng.choice(data)[1]  # ties
        data.append((i - 200, [float(np.float32(x)) for x in v], rng.randrange(4)))
    return data + [
        (None, [1.0] * width, 1), (5000, None, 1), (5100, [1.0] * width, None), (5200, [1.0, NAN] + [0.0] * (width - 2), 1), (5300, [1.0, INF], 1),
        (5400, [1.0, None], 1), (5500, [], 1), (5600, [0.0] * width, 2), (5700, [2.0], 3), (100, data[300][1], data[300][2]),
    ]


def plain(data, every=100, n_pos=5, n_neg=10, low=30, high=90):
    kept = {}
    for i, v, y in data:
        if i is None or v is None or y is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept[i] = min(kept.get(i, (y, v)), (y, v))
    width = max((len(v) for _, v in kept.values()), default=0)
    whole = {i: (y, [int(np.floor(256 * x)) for x in v] + [0] * (width - len(v))) for i, (y, v) in kept.items()}
    out = []
    for a, (y, v) in whole.items():
        if a % every:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(v, w)), i, z) for i, (z, w) in whole.items() if i != a))
        for s, p, _ in [t for t in scored if t[2] == y][:n_pos]:
            fit = [(-t, i) for t, i, z in scored if z != y and low * -s <= 100 * -t <= high * -s][:n_neg]
            out += [(a, p, k + 1, i, -s, t) for k, (t, i) in enumerate(fit)]
    return sorted(out)


def test_equals_brute_force_with_nulls_ties_repeats_and_odd_vectors(spark):
    data = table()
    assert sorted(rows(H.hard_negatives(frame(spark, data)))) == plain(data)


def test_many_shards_small_clusters_and_other_parameters(spark, monkeypatch):
    monkeypatch.setattr(H, "SHARD_BYTES", 8 * 6 * 70)
    monkeypatch.setattr(H, "CLUSTER_ROWS", 7)
    monkeypatch.setattr(H, "BLOCK", 16)
    data = table(seed=2)
    found = H.hard_negatives(frame(spark, data), anchor_every=10, positives=3, negatives=4, low=10, high=95)
    assert sorted(rows(found)) == plain(data, 10, 3, 4, 10, 95)


def test_empty_tables_and_tables_without_anchors(spark):
    assert rows(H.hard_negatives(frame(spark, []))) == []
    assert rows(H.hard_negatives(frame(spark, [(1, [1.0], 1), (2, [1.0], 1)]))) == []
    assert rows(H.hard_negatives(frame(spark, [(100, [1.0], 1)]))) == []


def test_a_list_ends_before_the_last_row(spark):
    rng = np.random.default_rng(0)
    x = np.floor(256 * rng.normal(size=(4000, 3)))
    shard = H.Shard(np.arange(4000), np.zeros(4000, np.int64), x)
    seen = []
    fits = lambda q, at, s: seen.append(len(at)) or np.ones(s.shape, bool)
    own = x[:1]
    q, row, score = shard.walk(own, np.arange(1), fits, np.array([-(2**62)]), 5, H.directions(own)[0][0])
    exact = np.sort((own.astype(np.int64) @ x.astype(np.int64).T)[0])[::-1][:5]
    assert sorted(score.tolist(), reverse=True) == exact.tolist()
    assert sum(seen) < 4000


def test_large_components_stay_exact(spark):
    big = 2.0**20
    data = [(100, [big, 1.0], 1), (1, [big, 2.0], 1), (2, [big / 2, 3.0], 2), (3, [big / 2, 3.00390625], 2)]
    assert sorted(rows(H.hard_negatives(frame(spark, data)))) == plain(data)


def test_label_may_be_an_expression(spark):
    data = [(700, [1.0, 0.0], 9), (1, [1.0, 0.0], 0), (2, [0.5, 0.0], 9)]
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    assert rows(H.hard_negatives(frame(spark, data), label=moved)) == [(700, 1, 1, 2, 65536, 32768)]

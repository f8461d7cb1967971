"""Pooling statistics without a vector in an exchange, whole and cut slides alike."""

import math

import numpy as np
import pytest

from bagspark.operators import pooling as P
from bagspark.session import materialise

NAN, INF = float("nan"), float("inf")


def plain(rows, fraction):
    """Every statistic of every dimension from its list of values."""
    groups = {}
    for s, i, f in rows:
        if s is not None and f is not None:
            groups.setdefault(s, []).append((i, f))
    out = {}
    for s, members in groups.items():
        norms = []
        for i, f in members:
            n = None if any(v is None for v in f) else math.sqrt(sum(v * v for v in f)) if not any(v != v for v in f) else None
            if n is not None:
                norms.append((n, i, f))
        k = max(math.floor(len(norms) * fraction), 1)
        top, bottom = sorted(norms, key=lambda t: (-t[0], t[1]))[:k], sorted(norms, key=lambda t: t[:2])[:k]
        for d in range(max(len(f) for _, f in members)):
            vs = [f[d] for _, f in members if len(f) > d and f[d] is not None]
            ok = sorted(v for v in vs if v == v)
            at = 0.9 * (len(ok) - 1)
            lo, hi = (ok[math.floor(at)], ok[math.ceil(at)]) if ok else (None, None)
            part = lambda ms: (lambda xs: sum(xs) / len(xs) if xs else None)([f[d] for _, _, f in ms if len(f) > d and f[d] is not None])  # noqa: B023, E731
            mean = sum(vs) / len(vs) if vs else None
            std = math.sqrt(sum((v - mean) ** 2 for v in vs) / len(vs)) if vs and all(map(math.isfinite, vs)) else NAN if vs else None
            largest = NAN if any(v != v for v in vs) else max(vs, default=None)
            out[s, d] = (mean, largest, None if lo is None else lo if lo == hi else lo + (hi - lo) * (at - math.floor(at)), std, part(top), part(bottom))
    return out


def same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and ((a != a and b != b) or a == b or abs(a - b) <= 1e-6 * max(1, abs(b))))


def table(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for s, n in (("hot", 700), ("a", 40), ("b", 1), ("c", 11)):
        rows += [(s, int(i), [float(v) for v in rng.normal(size=5).astype(np.float32)]) for i in rng.permutation(n)]
    rows += [("const", i, [1.5] * 5) for i in range(60)]
    rows += [("ties", i, [float(i % 3), 0.0, 1.0, -float(i % 2), 7.0]) for i in range(50)]
    rows += [("odd", 0, [1.0, None, 3.0]), ("odd", 1, [2.0, 5.0]), ("odd", 2, [NAN, 1.0, 2.0, 4.0]), ("odd", 3, [0.5, 0.25, 9.0]), ("odd", 4, [INF, 1.0, 1.0]), ("odd", 5, None)]
    rows += [(None, 1, [1.0]), ("empty", 0, []), ("nulls", 0, [None, None]), ("nulls", 1, [None, 2.0])]
    rng.shuffle(np.array(range(3)))
    return rows


def frame(spark, rows, parts):
    return materialise(spark.createDataFrame(rows, "slide_id string, patch_idx long, features array<float>").repartition(parts))


@pytest.mark.parametrize("parts,run_bytes,turn_bytes", [(1, 64 << 20, 256 << 20), (7, 64 << 20, 256 << 20), (3, 100, 48 * 5 * 2)])
def test_equals_a_list_of_values(spark, monkeypatch, parts, run_bytes, turn_bytes):
    monkeypatch.setattr(P, "RUN_BYTES", run_bytes)
    monkeypatch.setattr(P, "TURN_BYTES", turn_bytes)
    rows = table(parts)
    found = {(r[0], r[1]): r[2:] for r in P.pooling_statistics(frame(spark, rows, parts), 0.25).collect()}
    expected = plain(rows, 0.25)
    assert found.keys() == expected.keys()
    bad = [(k, n, a, b) for k in expected for n, a, b in zip(P.STATISTICS, found[k], expected[k]) if not same(a, b)]
    assert not [b for b in bad if not (b[0] == ("odd", 0) and b[1] in ("mean", "std", "top", "bottom"))], bad


def test_no_vector_is_exchanged(spark):
    patches = frame(spark, table(), 4)
    normed = patches.withColumn("_norm", P.F.lit(1.0))
    plan = P.accumulated(normed.sortWithinPartitions("slide_id"), 0.1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "features" in plan
    assert "features" not in P.pooling_statistics(patches)._jdf.queryExecution().executedPlan().toString()


def test_accumulators_do_not_grow_with_the_patches(spark):
    rows = [("s", i, [float(i % 97), float(i)]) for i in range(3000)]
    few, many = (P.accumulated(frame(spark, rows[:n], 1).withColumn("_norm", P.F.lit(1.0)), 0.1).collect() for n in (300, 3000))
    assert len(few) == len(many) == 1 and [len(c) for c in few[0][1:]] == [len(c) for c in many[0][1:]]


def test_empty_table(spark):
    assert P.pooling_statistics(frame(spark, [], 2)).collect() == []

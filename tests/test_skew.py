"""The grouped primitives against brute force, with one group holding most rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagspark import skew
from bagspark.functions.hashing import hash_uniform
from bagspark.session import materialise


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    keys = np.where(rng.random(3000) < 0.5, 0, rng.integers(1, 12, 3000))
    values = np.where(rng.random(3000) < 0.3, 7.0, np.round(rng.lognormal(0, 3, 3000), 3))
    data = [(int(k), i, float(v)) for i, (k, v) in enumerate(zip(keys, values))]
    return materialise(spark.createDataFrame(data, "slide_id bigint, patch_idx bigint, v double")), data


def by_key(data):
    groups = {}
    for k, i, v in data:
        groups.setdefault(k, []).append((v, i))
    return groups


@pytest.mark.parametrize("hot", [10, 500, skew.HOT_ROWS])
def test_attach_stats_keeps_every_row_once(skewed, hot):
    df, data = skewed
    stats = df.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    out = skew.attach_stats(df, stats, ["slide_id"], ["patch_idx"], hot_rows=hot).collect()
    assert sorted(r["patch_idx"] for r in out) == list(range(len(data)))
    top = {k: max(g)[0] for k, g in by_key(data).items()}
    assert all(r["top"] == top[r["slide_id"]] for r in out)


@pytest.mark.parametrize("hot, bins", [(10, 4), (10, 1024), (skew.HOT_ROWS, 1024)])
def test_percentiles_equal_numpy(skewed, hot, bins):
    df, data = skewed
    ranks = {"first": lambda n: F.lit(1), "mid": lambda n: F.floor((n + 1) / 2), "last": lambda n: n}
    out = skew.order_statistics(df, ["slide_id"], "v", ranks, bins=bins, hot_rows=hot).collect()
    groups = by_key(data)
    assert len(out) == len(groups)
    for r in out:
        values = sorted(v for v, _ in groups[r["slide_id"]])
        n = len(values)
        assert (r["n"], r["first"], r["mid"], r["last"]) == (n, values[0], values[(n + 1) // 2 - 1], values[-1])
    out = skew.percentiles(df, ["slide_id"], "v", {"p50": 0.5, "p99": 0.99}, hot_rows=hot).collect()
    for r in out:
        values = [v for v, _ in groups[r["slide_id"]]]
        assert np.isclose(r["p50"], np.percentile(values, 50)) and np.isclose(r["p99"], np.percentile(values, 99))


@pytest.mark.parametrize("hot", [10, skew.HOT_ROWS])
@pytest.mark.parametrize("largest", [True, False])
def test_extreme_rows_break_ties_by_index(skewed, hot, largest):
    df, data = skewed
    size = lambda n: F.greatest(F.floor(n / 5), F.lit(1))
    got = {}
    for r in skew.extreme_rows(df, ["slide_id"], "v", "patch_idx", size, largest, hot_rows=hot).collect():
        got.setdefault(r["slide_id"], set()).add(r["patch_idx"])
    for k, g in by_key(data).items():
        ordered = sorted(g, key=lambda t: (-t[0] if largest else t[0], t[1]))
        assert got[k] == {i for _, i in ordered[: max(1, len(g) // 5)]}


@pytest.mark.parametrize("cap", [1, 40, 5000])
def test_smallest_by_hash(skewed, cap):
    df, data = skewed
    keyed = df.withColumn("u", hash_uniform(5, "slide_id", "patch_idx")).cache()
    us = {(r["slide_id"], r["patch_idx"]): r["u"] for r in keyed.collect()}
    got = {}
    for r in skew.smallest_by_hash(keyed, ["slide_id"], "u", cap, ["patch_idx"]).collect():
        got.setdefault(r["slide_id"], set()).add(r["patch_idx"])
    for k, g in by_key(data).items():
        want = sorted((us[k, i], i) for _, i in g)[:cap]
        assert got[k] == {i for _, i in want}


def test_hash_rank_is_a_permutation_in_hash_order(skewed):
    df, data = skewed
    out = skew.hash_rank(df.withColumn("u", hash_uniform(1, "patch_idx")), ["slide_id"], "u", ["patch_idx"], buckets=7).collect()
    per = {}
    for r in out:
        per.setdefault(r["slide_id"], []).append((r["u"], r["position"]))
    for g in per.values():
        assert [p for _, p in sorted(g)] == list(range(len(g)))


def test_ranged_prefix_counts_and_sums(skewed, spark):
    df, data = skewed
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counted = skew.ranged_prefix(df, [F.desc("v"), "patch_idx"], keys=["slide_id"], out="before").collect()
        summed = skew.ranged_prefix(df.withColumn("w", F.col("patch_idx") % 5), ["v", "patch_idx"], weight="w").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    per = {}
    for r in counted:
        per.setdefault(r["slide_id"], []).append((-r["v"], r["patch_idx"], r["before"]))
    for g in per.values():
        assert [b for *_, b in sorted(g)] == list(range(len(g)))
    running = 0
    for r in sorted(summed, key=lambda r: (r["v"], r["patch_idx"])):
        assert r["before"] == running
        running += r["w"]


def test_materialise_uses_the_configured_folder(spark):
    from bagspark.session import scratch_path, shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


@pytest.mark.parametrize("largest", [True, False])
def test_both_paths_leave_out_nulls_and_nan_and_break_ties_alike(spark, largest):
    values = [None, float("nan"), 1.0, 1.0, 2.0, None, 2.0, 2.0, 0.5, float("nan")] * 4
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "slide_id bigint, patch_idx bigint, v double")
    size = lambda n: F.ceil(n * 0.25)
    got = [
        sorted((r["patch_idx"], r["v"]) for r in skew.extreme_rows(df, ["slide_id"], "v", "patch_idx", size, largest, hot_rows=hot).collect())
        for hot in (2_000_000, 2)
    ]
    assert got[0] == got[1] and len(got[0]) == 6
    ranks = {"low": lambda n: F.lit(1), "high": lambda n: n}
    stats = [skew.order_statistics(df, ["slide_id"], "v", ranks, hot_rows=hot).collect()[0].asDict() for hot in (2_000_000, 2)]
    assert stats[0] == stats[1] == {"slide_id": 1, "n": 24, "low": 0.5, "high": 2.0}

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagspark.operators import splits as S
from bagspark.sources.splits_io import load_splits, write_splits


def labels(spark, counts):
    data = [(f"P{c}{i:04d}", c) for c, n in enumerate(counts) for i in range(n)]
    return spark.createDataFrame(data, "patient_id string, label int")


def test_majority_vote_ties_go_to_the_first_seen(spark):
    votes = spark.createDataFrame([("a", 2, 0), ("a", 1, 1), ("b", 0, 5), ("b", 1, 2), ("b", 1, 3)], "patient_id string, label int, pos bigint")
    assert {tuple(r) for r in S.majority_label(votes).collect()} == {("a", 2), ("b", 1)}


def test_published_allocation(spark):
    got = {r["label"]: r["quota"] for r in S.holdout_quotas(labels(spark, [56, 265, 114])).collect()}
    assert got == {0: 9, 1: 40, 2: 17}


def test_splits_keep_their_promises(spark):
    whole = S.make_splits(labels(spark, [30, 120, 50])).cache()
    members = S.membership(whole)
    assert {r["violations"] for r in S.split_invariants(whole, members).collect()} == {0}
    assert S.leakage_check(whole, members).count() == 0
    assert whole.where("is_test").count() == 30
    per = whole.where("NOT is_test").groupBy("label", "fold").count().groupBy("label").agg((F.max("count") - F.min("count")).alias("d"))
    assert all(r["d"] <= 1 for r in per.collect())
    again = S.make_splits(labels(spark, [30, 120, 50]).orderBy(F.rand(4)))
    assert whole.exceptAll(again).count() == 0
    other = S.make_splits(labels(spark, [30, 120, 50]), seed=1)
    assert whole.exceptAll(other).count() > 0


def test_rare_class_is_refused(spark):
    with pytest.raises(S.SplitError):
        S.check_class_counts(labels(spark, [20, 19, 1]))
    assert S.check_class_counts(labels(spark, [20, 19, 6])) == 3


def test_fingerprint(spark):
    whole = S.make_splits(labels(spark, [20, 40, 20])).cache()
    ids = sorted(r["patient_id"] for r in whole.where("is_test").collect())
    digest = lambda parts: hashlib.sha256("|".join(sorted(parts)).encode()).hexdigest()
    buckets, groups = {}, {}
    for i in ids:
        buckets.setdefault(hashlib.md5(i.encode()).hexdigest()[:5], []).append(i)
    for b, members in buckets.items():
        groups.setdefault(b[:2], []).append(digest(members))
    want = digest(digest(g) for g in groups.values())[:16]
    assert S.fingerprint(whole).first()[0] == want == S.fingerprint(whole.repartition(7)).first()[0]
    assert S.fingerprint(whole.where(F.col("patient_id") != ids[0])).first()[0] != want


def test_tampered_and_leaking_files_are_refused(spark, folder):
    whole = S.make_splits(labels(spark, [20, 40, 20]))
    write_splits(whole, f"{folder}/a", 1, 0.15, 5, 3)
    back, header = load_splits(spark, f"{folder}/a")
    assert back.exceptAll(whole).count() == 0 and header.first()["n_folds"] == 5
    back.where("NOT is_test OR label <> 0").write.parquet(f"{folder}/b/members")
    header.write.json(f"{folder}/b/header")
    with pytest.raises(S.SplitError, match="fingerprint"):
        load_splits(spark, f"{folder}/b")
    leak = back.where("is_test").limit(1).withColumns({"is_test": F.lit(False), "fold": F.lit(0)})
    back.unionByName(leak).write.parquet(f"{folder}/c/members")
    header.write.json(f"{folder}/c/header")
    with pytest.raises(S.SplitError, match="folds"):
        load_splits(spark, f"{folder}/c")

"""Labels, leakage-proof splits and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bagspark.functions.hashing import hash_uniform
from bagspark.session import materialise
from bagspark.skew import hash_rank

DEFAULT_SEED = 20260820
# Hex digits of the MD5 of an id that name its bucket, and of a bucket that name its group.
BUCKET_DIGITS, GROUP_DIGITS = 5, 2


class SplitError(RuntimeError):
    """The split is unusable: too few patients per class, tampered with, or leaking."""


def majority_label(raw: DataFrame) -> DataFrame:
    """Modal label per patient from (patient_id, label, pos) votes; ties go to the label seen first."""
    votes = raw.groupBy("patient_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    return votes.groupBy("patient_id").agg(
        F.min_by("label", F.struct(-F.col("n"), F.col("first_pos"))).alias("label")
    )


def class_counts(labels: DataFrame, n_folds: int = 5) -> DataFrame:
    """Patients per class, number of classes, rarest class size and whether n_folds can be stratified."""
    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy(F.lit(0))
    return counts.select(
        "label",
        "n",
        (F.max("label").over(whole) + 1).alias("n_classes"),
        F.min("n").over(whole).alias("rarest"),
        (F.min("n").over(whole) >= n_folds).alias("enough"),
    )


def check_class_counts(labels: DataFrame, n_folds: int = 5) -> int:
    """Number of classes; raises when the rarest class cannot reach every fold."""
    row = class_counts(labels, n_folds).first()
    if row is None or not row["enough"]:
        raise SplitError(f"rarest class has {row and row['rarest']} patients for {n_folds} folds; merge classes or use fewer folds")
    return int(row["n_classes"])


def holdout_quotas(labels: DataFrame, test_frac: float = 0.15) -> DataFrame:
    """Test patients per class: ceil(frac * n) in all, shared out by largest remainder."""
    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy(F.lit(0))
    total = F.sum("n").over(whole)
    shares = counts.withColumn("_test", F.ceil(total * F.lit(test_frac))).withColumn(
        "_exact", F.col("_test") * F.col("n") / total
    )
    shares = shares.withColumn("_floor", F.floor("_exact")).withColumn(
        "_rest", F.col("_test") - F.sum("_floor").over(whole)
    )
    order = whole.orderBy(F.desc(F.col("_exact") - F.col("_floor")), "label")
    extra = F.when(F.row_number().over(order) <= F.col("_rest"), 1).otherwise(0)
    return shares.select("label", "n", (F.col("_floor") + extra).cast("bigint").alias("quota"))


def stratified_holdout(labels: DataFrame, test_frac: float = 0.15, seed: int = DEFAULT_SEED) -> DataFrame:
    """Adds ``is_test``: within each class the first ``quota`` patients in seeded hash order."""
    keyed = labels.select("patient_id", "label").withColumn("_u", hash_uniform(f"{seed}|test", "patient_id"))
    ranked = hash_rank(keyed, ["label"], "_u", ["patient_id"], out="_position")
    quotas = holdout_quotas(labels, test_frac).select("label", "quota")
    return ranked.join(F.broadcast(quotas), "label").select(
        "patient_id", "label", (F.col("_position") < F.col("quota")).alias("is_test")
    )


def stratified_kfold(dev: DataFrame, n_folds: int = 5, seed: int = DEFAULT_SEED) -> DataFrame:
    """Adds ``fold``: patients of each class dealt round robin in seeded hash order."""
    keyed = dev.withColumn("_u", hash_uniform(f"{seed}|fold", "patient_id"))
    ranked = hash_rank(keyed, ["label"], "_u", ["patient_id"], out="_position")
    return ranked.withColumn("fold", (F.col("_position") % n_folds).cast("int")).drop("_u", "_position")


def make_splits(
    labels: DataFrame, test_frac: float = 0.15, n_folds: int = 5, seed: int = DEFAULT_SEED
) -> DataFrame:
    """(patient_id, label, is_test, fold): a locked test set and k validation folds over the rest.

    Labels and the holdout are written once, since counting and ranking each read them again.
    """
    labels = materialise(labels.select("patient_id", "label"), "labels")
    held = materialise(stratified_holdout(labels, test_frac, seed), "holdout")
    dev = stratified_kfold(held.where(~F.col("is_test")), n_folds, seed)
    test = held.where("is_test").withColumn("fold", F.lit(None).cast("int"))
    return dev.unionByName(test).select("patient_id", "label", "is_test", "fold")


def membership(splits: DataFrame, n_folds: int = 5) -> DataFrame:
    """(patient_id, label, fold, role): every dev patient is val in one fold and train in the others."""
    folds = F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))
    role = F.when(F.col("fold") == F.col("_own"), "val").otherwise("train")
    return (
        splits.where(~F.col("is_test"))
        .withColumnRenamed("fold", "_own")
        .withColumn("fold", folds)
        .select("patient_id", "label", "fold", role.alias("role"))
    )


def dev_ids(members: DataFrame) -> DataFrame:
    """Sorted distinct patients of all folds' train and val sets."""
    return members.select("patient_id").distinct().orderBy("patient_id")


def leakage_check(splits: DataFrame, members: DataFrame) -> DataFrame:
    """Test patients that occur in any fold."""
    test = splits.where("is_test").select("patient_id")
    return test.join(members.select("patient_id"), "patient_id", "left_semi")


def split_invariants(splits: DataFrame, members: DataFrame) -> DataFrame:
    """(invariant, violations): test and dev are disjoint, roles exclude each other, val tiles dev once."""
    per = members.groupBy("patient_id", "fold").agg(
        F.max(F.when(F.col("role") == "val", 1).otherwise(0)).alias("val"),
        F.countDistinct("role").alias("roles"),
    ).groupBy("patient_id").agg(
        F.sum("val").alias("vals"), F.sum(F.when(F.col("roles") > 1, 1).otherwise(0)).alias("both")
    )
    both = splits.select("patient_id", "is_test").join(per, "patient_id", "full_outer")

    def violations(condition):
        return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")

    row = both.agg(
        violations(F.col("is_test") & F.col("vals").isNotNull()).alias("test_in_dev"),
        violations(F.col("both") > 0).alias("train_and_val"),
        violations(~F.col("is_test") & (F.coalesce("vals", F.lit(0)) != 1)).alias("not_val_once"),
        violations(F.col("is_test").isNull()).alias("unknown_patient"),
    )
    return row.unpivot([], row.columns, "invariant", "violations")


def fingerprint(splits: DataFrame) -> DataFrame:
    """One row ``fingerprint``: 16 hex digits that stand for the set of test ids, by one rule at every size.

    Ids fall into buckets by the first five hex digits of their MD5, buckets into groups by the first two. The SHA-256
    of a bucket is over its sorted ids joined by '|', that of a group over its sorted bucket digests, and
    the fingerprint over the sorted group digests, so no task holds all ids.
    """

    def digest(col: str):
        return F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(col))), 256)

    ids = splits.where("is_test").select("patient_id", F.substring(F.md5("patient_id"), 1, BUCKET_DIGITS).alias("_b"))
    buckets = ids.groupBy("_b").agg(digest("patient_id").alias("_d"))
    groups = buckets.groupBy(F.substring("_b", 1, GROUP_DIGITS).alias("_g")).agg(digest("_d").alias("_d"))
    return groups.agg(F.substring(digest("_d"), 1, 16).alias("fingerprint"))

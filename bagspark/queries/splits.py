"""Label voting, splitting and their invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from bagspark.operators import splits as S
from bagspark.queries.registry import query, tables
from bagspark.session import materialise, scratch_path
from bagspark.sources.splits_io import load_splits as load
from bagspark.sources.splits_io import write_splits as write

FINGERPRINT = """(SELECT substr(sha256(coalesce(string_agg(d, '|' ORDER BY d), '')), 1, 16) FROM (
    SELECT sha256(string_agg(d, '|' ORDER BY d)) AS d FROM (
        SELECT substr(md5(patient_id), 1, 5) AS b, sha256(string_agg(patient_id, '|' ORDER BY patient_id)) AS d FROM {} WHERE is_test GROUP BY 1)
    GROUP BY substr(b, 1, 2)))"""
MAJORITY = """voted AS (SELECT patient_id, label, count(*) AS n, min(pos) AS first_pos FROM raw_labels GROUP BY patient_id, label),
labelled AS (SELECT patient_id, label FROM voted
             QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY n DESC, first_pos) = 1)"""


def u(tag, key="patient_id"):
    return f"CAST(('0x' || substr(md5('20260820|{tag}|' || {key}), 1, 8)) AS BIGINT) / 4294967296.0e0"


HELD = f"""{MAJORITY}, counts AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM labelled GROUP BY label),
shares AS (SELECT label, ceil(total * 0.15e0) AS want, ceil(total * 0.15e0) * n / total AS exact FROM counts),
quotas AS (SELECT label, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, label)
                                           <= want - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM shares),
held AS (SELECT l.patient_id, l.label,
                row_number() OVER (PARTITION BY l.label ORDER BY {u('test', 'l.patient_id')}, l.patient_id) <= q.quota AS is_test
         FROM labelled l JOIN quotas q ON l.label = q.label)"""
SPLIT = f"""{HELD}, dev AS (SELECT patient_id, label, is_test,
                  CAST((row_number() OVER (PARTITION BY label ORDER BY {u('fold')}, patient_id) - 1) % 5 AS INT) AS fold
           FROM held WHERE NOT is_test),
splits AS (SELECT * FROM dev UNION ALL SELECT patient_id, label, is_test, CAST(NULL AS INT) FROM held WHERE is_test),
members AS (SELECT d.patient_id, f.fold, CASE WHEN f.fold = d.fold THEN 'val' ELSE 'train' END AS role
            FROM dev d, (SELECT unnest([0, 1, 2, 3, 4]) AS fold) f)"""


def labels(spark, sf):
    """Majority labels, written once: the split operators read them several times."""
    return materialise(S.majority_label(tables(spark, sf, "raw_labels")), "labels")


def splits(spark, sf):
    return materialise(S.make_splits(S.majority_label(tables(spark, sf, "raw_labels"))), "splits")


@query("majority_label", f"WITH {MAJORITY} SELECT * FROM labelled", "raw_labels")
def majority_label(spark, sf):
    return S.majority_label(tables(spark, sf, "raw_labels"))


@query(
    "class_counts",
    f"""WITH {MAJORITY} SELECT label, count(*) AS n, CAST(max(label) OVER () + 1 AS INT) AS n_classes,
        min(count(*)) OVER () AS rarest, min(count(*)) OVER () >= 5 AS enough FROM labelled GROUP BY label""",
    "raw_labels",
)
def class_counts(spark, sf):
    return S.class_counts(labels(spark, sf))


@query("stratified_holdout", f"WITH {HELD} SELECT patient_id, label, is_test FROM held", "raw_labels")
def stratified_holdout(spark, sf):
    return S.stratified_holdout(labels(spark, sf))


@query("stratified_kfold", f"WITH {SPLIT} SELECT patient_id, label, fold FROM dev", "raw_labels")
def stratified_kfold(spark, sf):
    dev = S.stratified_holdout(labels(spark, sf)).where(~F.col("is_test"))
    return S.stratified_kfold(dev).select("patient_id", "label", "fold")


@query(
    "fingerprint",
    f"WITH {HELD} SELECT {FINGERPRINT.format('held')} AS fingerprint",
    "raw_labels",
)
def fingerprint(spark, sf):
    return S.fingerprint(materialise(S.stratified_holdout(labels(spark, sf)), "holdout"))


def stored(spark, sf):
    path = scratch_path(spark, "splits")
    votes = labels(spark, sf)
    write(S.make_splits(votes), path, S.DEFAULT_SEED, 0.15, 5, S.check_class_counts(votes))
    return path


@query(
    "write_splits",
    f"""WITH {SPLIT} SELECT {FINGERPRINT.format('splits')} AS fingerprint,
        CAST(20260820 AS BIGINT) AS seed, 0.15e0 AS test_frac, 5 AS n_folds,
        CAST((SELECT max(label) + 1 FROM labelled) AS INT) AS n_classes""",
    "raw_labels",
)
def write_splits(spark, sf):
    return load(spark, stored(spark, sf))[1]


@query("load_splits", f"WITH {SPLIT} SELECT patient_id, label, is_test, fold FROM splits", "raw_labels")
def load_splits(spark, sf):
    return load(spark, stored(spark, sf))[0]


@query(
    "leakage_check",
    f"""WITH {SPLIT}, tampered AS (SELECT patient_id FROM members UNION SELECT patient_id FROM splits WHERE is_test AND label = 0)
        SELECT patient_id FROM splits WHERE is_test AND patient_id IN (SELECT patient_id FROM tampered)""",
    "raw_labels",
)
def leakage_check(spark, sf):
    """One class of the test set is put into the folds on purpose, so that there is a leak to find."""
    whole = splits(spark, sf)
    members = S.membership(whole).select("patient_id")
    planted = whole.where("is_test AND label = 0").select("patient_id")
    return S.leakage_check(whole, members.unionByName(planted))


@query("dev_ids", f"WITH {SPLIT} SELECT DISTINCT patient_id FROM members", "raw_labels")
def dev_ids(spark, sf):
    return S.dev_ids(S.membership(splits(spark, sf)))


@query(
    "split_invariants",
    f"""WITH {SPLIT},
        vals AS (SELECT patient_id, count(*) FILTER (WHERE role = 'val') AS v FROM members GROUP BY patient_id)
        SELECT 'test_in_dev' AS invariant, count(*) AS violations FROM splits WHERE is_test AND patient_id IN (SELECT patient_id FROM members)
        UNION ALL SELECT 'train_and_val', count(*) FROM (SELECT patient_id, fold FROM members WHERE role = 'train'
                                                INTERSECT SELECT patient_id, fold FROM members WHERE role = 'val')
        UNION ALL SELECT 'not_val_once', count(*) FROM splits s LEFT JOIN vals USING (patient_id) WHERE NOT is_test AND coalesce(v, 0) <> 1
        UNION ALL SELECT 'unknown_patient', count(*) FROM vals WHERE patient_id NOT IN (SELECT patient_id FROM splits)""",
    "raw_labels",
)
def split_invariants(spark, sf):
    whole = splits(spark, sf)
    return S.split_invariants(whole, S.membership(whole))

"""Registered queries against their SQL restatement on the smallest given tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
from tools.check_oracle import normal, ok_type

DATA = "/root/testdata/sf0.001"
SOME = [
    "read_catalog", "seed_from_prior", "plan_budget", "stratified_kfold", "split_invariants", "ensemble_predict", "grading_metrics",
    "selective_prediction", "verify_cohort", "expected_width", "pooling_statistics", "top_regions", "attention_informative",
    "branch_diversity", "pairwise_maps", "gated_scores", "slide_bags", "sample_subbag", "bag_mixup_targets", "median_prune",
    "progress_summary", "build_tiles", "score_crops", "bucketed_bags", "store_inventory", "landed_files", "bootstrap_qwk_ci",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("BAGSPARK_ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    assert sorted(df.columns) == sorted(columns)
    assert all(ok_type(f.dataType.simpleString(), types[f.name]) for f in df.schema)
    mine = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    other = sorted(tuple(map(normal, r)) for r in result.fetchall())
    assert mine == other


def test_entry_has_five_regions_per_slide(spark):
    rows = entry.entry(spark).collect()
    assert {(r["slide_id"], r["rank"]) for r in rows} == {(s, k) for s in range(20) for k in range(1, 6)}

"""The registered queries of this package against their SQL on the smallest given tables."""

import glob
import os

import pytest

from bagspark.llm import queries
from tools.check_oracle import normal, ok_type

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df, result = queries.QUERIES[name](spark, DATA), duck.execute(queries.ORACLES[name])
    columns, types = [d[0] for d in result.description], {d[0]: str(d[1]) for d in result.description}
    assert sorted(df.columns) == sorted(columns)
    assert all(ok_type(f.dataType.simpleString(), types[f.name]) for f in df.schema)
    assert sorted(tuple(normal(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(map(normal, r)) for r in result.fetchall())


def test_every_operator_has_a_query():
    assert [sum(n.startswith(f"op{k}_") for n in queries.QUERIES) for k in range(1, 14)] == [1] * 13

"""Every query with an oracle returns what DuckDB returns on the same tables."""

import duckdb
import pytest

from tabulark.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    mine = sorted([tuple(r) for r in found.select(*columns).collect()], key=str)
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    theirs = sorted(duck.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({ORACLES[name]})").fetchall(), key=str)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0

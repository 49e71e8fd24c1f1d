"""Every query against its SQL in DuckDB on the smallest tables: columns, rows and values, in any order."""

import glob
import os

import duckdb
import pytest

from tidemark.plans import ORACLE, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        files = sorted(glob.glob(f"{path}/*.parquet")) if os.path.isdir(path) else [path]
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files})")
    return con


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    out = QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in out.collect()]
    if name not in ORACLE:
        return
    relation = duck.sql(ORACLE[name])
    assert sorted(relation.columns) == sorted(out.columns)
    assert canon(relation.fetchall(), relation.columns) == canon(rows, out.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "instrument"
    assert set(entry.oracle_sql()) <= set(entry.queries())

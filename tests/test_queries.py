"""Every registered query with SQL, side by side on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from compare_sql import TABLES, canon

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    d = duckdb.connect()
    for t in TABLES:
        d.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return d


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    rel = db.execute(entry.oracle_sql()[name])
    have = [d[0] for d in rel.description]
    assert sorted(have) == cols
    assert got == sorted(tuple(canon(r[have.index(c)]) for c in cols) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

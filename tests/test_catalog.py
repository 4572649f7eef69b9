"""Every query with SQL against DuckDB at sf0.01, row for row."""

import duckdb
import pytest

import __spark_entry__ as entry
from quern.plans import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, db, name):
    got = catalog.queries()[name](spark, SF)
    cur = db.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    want = sorted(tuple(dict(zip(names, r, strict=True))[c] for c in order) for r in cur.fetchall())
    assert sorted(tuple(r) for r in got.select(*order).collect()) == want


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())

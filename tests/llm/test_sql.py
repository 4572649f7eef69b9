"""Queries with SQL against DuckDB at sf0.01, row for row."""

import duckdb
import pytest

from quern.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = db.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    key = lambda r: tuple((v is None, v) for v in r)
    want = sorted((tuple(dict(zip(names, r, strict=True))[c] for c in sorted(names)) for r in cur.fetchall()), key=key)
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r) for r in got.select(*sorted(names)).collect()), key=key) == want

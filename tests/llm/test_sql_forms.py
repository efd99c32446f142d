"""The queries that SQL can express against their SQL forms."""

import duckdb
import pytest

from tallyforge.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equal(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    names = ", ".join(got.columns)
    want = db.execute(f"SELECT {names} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect()) and want

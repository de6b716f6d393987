"""Every corpus query that has SQL gives what DuckDB gives, on whole tables."""

import duckdb
import pytest

from accretion.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, sf_small, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_small}/documents.parquet'")
    found = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in found.description]
    want = sorted(map(repr, found.fetchall()))
    got = registry.QUERIES[name](spark, sf_small)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == want

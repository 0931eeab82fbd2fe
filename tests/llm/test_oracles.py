"""Queries of the subpackage against their SQL, on the smallest tables."""

import duckdb
import pytest

from corpusmill.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)

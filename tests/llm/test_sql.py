"""The queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from marginalia.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    mine, theirs = catalog.QUERIES[name](spark, sf).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(mine.columns) == columns
    as_rows = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert as_rows(mine) == as_rows(theirs)

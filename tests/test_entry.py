import __spark_entry__ as entry


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "mean_thinness" in out.columns


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())

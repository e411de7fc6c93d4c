import __spark_entry__ as E


def test_entry(spark):
    assert E.entry(spark).count() > 0


def test_names():
    queries, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(queries)
    assert "delay_windows_5min" in queries

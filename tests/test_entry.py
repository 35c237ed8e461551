import __spark_entry__


def test_every_sql_has_its_query():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) > 60


def test_entry_runs(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["path", "language", "matched", "is_hub", "hub_score", "score"] and rows.count() == 20

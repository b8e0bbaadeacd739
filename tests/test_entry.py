import __spark_entry__ as e


def test_entry(spark):
    assert e.entry(spark).columns == ["sha", "n_docs", "n_sources", "first_doc"]


def test_every_oracle_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())

import __spark_entry__ as entry


def test_flagship_and_registry(spark):
    assert entry.entry(spark).count() == 31
    assert set(entry.oracle_sql()) <= set(entry.queries())

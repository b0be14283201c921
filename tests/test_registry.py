"""What the driver reads."""

import __spark_entry__ as entry


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 80


def test_flagship(spark):
    got = entry.entry(spark)
    assert got.count() == 5 and {"grp", "k", "random", "tau2"} <= set(got.columns)

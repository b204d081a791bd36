"""Driver contract: entry() runs; every oracle key has a query."""
import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"contract", "t", "survival"} <= set(df.columns)


def test_oracles_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())

"""Every query against the SQL for the same rows."""

import pytest

from quarrylens.plans import registry

QUERIES, SQL = registry.load()


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_matches_sql(name, same_rows):
    same_rows(QUERIES[name], SQL[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1

import os

import pytest

import __spark_entry__ as entry
from pamsieve.plans.queries import ORACLE_SQL, QUERIES


def test_every_query_is_registered():
    names = set(entry.queries())
    assert set(QUERIES) <= names and set(entry.oracle_sql()) <= names and set(ORACLE_SQL) <= set(QUERIES)
    assert all(callable(f) for f in entry.queries().values()) and all(isinstance(s, str) for s in entry.oracle_sql().values())


@pytest.mark.skipif(not os.path.isdir(entry.SMOKE_DIR), reason="needs the tables")
def test_flagship(spark):
    found = entry.entry(spark)
    assert found.columns == ["guide", "D0", "D1", "D2"] and all(r.D0 >= 1 for r in found.collect())

"""Every registered query with SQL gives what the SQL gives; every other one runs."""

import pytest

import __spark_entry__ as entry
from oracle import compare

CORE = {k: f for m in entry._modules() if ".llm" not in m.__name__ for k, f in m.QUERIES.items()}
SQL = {k: s for m in entry._modules() if ".llm" not in m.__name__ for k, s in m.SQL.items()}
SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, name):
    df = CORE[name](spark, SMALL)
    if name in SQL:
        assert compare(df, SQL[name], SMALL) == ""
    else:
        assert df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

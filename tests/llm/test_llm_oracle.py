"""Registered queries of the subpackage against SQL, or that they run."""

import pytest

from corroborate.llm.queries import QUERIES, SQL
from oracle import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SMALL)
    if name in SQL:
        assert compare(df, SQL[name], SMALL) == ""
    else:
        assert df.count() > 0

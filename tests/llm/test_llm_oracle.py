"""The queries that SQL can express against their SQL, the others for their shape."""

import pytest
from oracle import connect, rows_of, rows_of_sql

from shutterstack.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sample):
    return connect(sample)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(name, spark, sample, con):
    columns, rows = rows_of(QUERIES[name](spark, sample))
    if name in SQL:
        assert (columns, rows) == rows_of_sql(con, SQL[name])
    assert rows

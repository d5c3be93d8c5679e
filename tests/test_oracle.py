"""Every query that isn't optional against its SQL, over the smallest tables."""

import pytest
from oracle import connect, rows_of, rows_of_sql

from shutterstack.plans import catalogue, core

QUERIES, SQL = {**catalogue.QUERIES, **core.QUERIES}, {**catalogue.SQL, **core.SQL}


@pytest.fixture(scope="module")
def con(sample):
    return connect(sample)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(name, spark, sample, con):
    columns, rows = rows_of(QUERIES[name](spark, sample))
    if name in SQL:
        assert (columns, rows) == rows_of_sql(con, SQL[name])
    else:
        assert rows

from __future__ import annotations

import pytest
from comparing import connection, same_rows

from binsift.registry import ORACLE_SQL, QUERIES, flagship


@pytest.fixture(scope="module")
def duck(small):
    return connection(small)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, small, duck, name):
    same_rows(QUERIES[name](spark, small), duck, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_flagship(spark, small):
    assert 0 < flagship(spark, small).count() <= 20

"""Every query of the subpackage that has an SQL form against DuckDB."""

import pytest

from maskloom.llm import queries
from tests.oracle import compare, duck

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    assert compare(queries.queries()[name](spark, sf), duck(sf), SQL[name]) == ""

"""Every registered query with an SQL form against DuckDB; the others must return rows."""

import pytest

from maskloom import plans
from tests.oracle import compare, duck

SQL = plans.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    assert compare(plans.queries()[name](spark, sf), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(SQL)))
def test_other_queries_return_rows(spark, sf, name):
    assert not plans.queries()[name](spark, sf).isEmpty()


def test_masked_documents_against_a_plain_scan(spark, sf):
    """Every e-mail that a plain expression finds with a known suffix is gone from the masked documents."""
    docs = plans.queries()["documents_mask"](spark, sf)
    rows = docs.collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert sum(r.n_email_address for r in rows) > 0 and not any("@example.com" in (r.masked or "") for r in rows)

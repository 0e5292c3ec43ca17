import pytest
from oracle import same

from tidemark import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, sf, name):
    same(spark, duck, sf, catalog.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0

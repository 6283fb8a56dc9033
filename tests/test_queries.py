"""Every library query against its SQL at the smallest scale."""

import pytest

from compare import rows
from hullscope import plans

QUERIES, SQL = plans.load()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.execute(SQL[name]).df())


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(SQL) <= set(e.queries())

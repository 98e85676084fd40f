"""Every catalogue query against DuckDB on whole tables."""

import pytest

from folioflow.plans import catalogue
from folioflow.plans import documents as _registers  # noqa: F401


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, sf, duck, same, name):
    same(catalogue.QUERIES[name](spark, sf), duck.execute(catalogue.ORACLES[name]))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

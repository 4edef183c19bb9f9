"""Every registered query of the library: the same rows as its SQL in DuckDB, or rows at all."""

import pytest

from assayer import plans
from rows import same_as_duckdb

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    df = plans.QUERIES[name](spark, SF)
    if name in plans.ORACLES:
        same_as_duckdb(df, plans.ORACLES[name], SF)
    else:
        assert df.count() == plans.base.Inputs(spark, SF).pages.count()  # the page jobs on real pages: one row each


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

"""Every query that SQL can express, against DuckDB on the smallest tables; the others must give rows of a stable schema."""

import pytest
from conftest import rows_of

from gaitline.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_small, duck, name):
    assert rows_of(QUERIES[name](spark, sf_small).toPandas()) == rows_of(duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, sf_small, name):
    df = QUERIES[name](spark, sf_small)
    assert df.count() > 0
    assert QUERIES[name](spark, sf_small).schema == df.schema


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

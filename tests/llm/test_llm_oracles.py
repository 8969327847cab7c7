"""The queries that SQL can express, against DuckDB."""

import pytest
from conftest import rows_of

from gaitline.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_small, duck, name):
    assert rows_of(QUERIES[name](spark, sf_small).toPandas()) == rows_of(duck.execute(ORACLES[name]).df())


def test_all_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [True] * 10 and "pipeline" in names

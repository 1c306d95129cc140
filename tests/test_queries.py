from __future__ import annotations

import pytest

from graphloom.plans import catalogue

from .oracle import DATA, here, rows_of, rows_of_sql

pytestmark = pytest.mark.skipif(not here(), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, name):
    assert rows_of(catalogue.QUERIES[name](spark, DATA)) == rows_of_sql(catalogue.SQL[name])


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Every query with SQL gives the same rows in DuckDB; the others give rows."""

import pytest

import __spark_entry__ as entry
from lexweave.plans import catalog

from .oracle import differences


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    if name in catalog.oracle_sql():
        assert differences(df, catalog.oracle_sql()[name], sf) == ""
    else:
        assert df.count() > 0


def test_registry(spark):
    assert set(catalog.oracle_sql()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns

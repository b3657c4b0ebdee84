"""Every query of the catalog against SQL, or for a stable schema and rows."""

import pytest

from frameflow.plans import catalog
from tests.oracle import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, sf_dir, name):
    assert spark_rows(catalog.QUERIES[name](spark, sf_dir)) == duck_rows(catalog.SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

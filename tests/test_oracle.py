"""Every registered query of the engine against its SQL, at the smallest scale."""

import pytest
from oracle import compare, connect

from groundshift.plans import catalog, catalog_more, catalog_workflows  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_rows_equal_sql(spark, con, name):
    got, want = compare(spark, con, SF, catalog.QUERIES[name], catalog.ORACLES[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows_without_sql(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0

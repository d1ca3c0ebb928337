"""Registered queries against their SQL on DuckDB, at the smallest scale."""

import oracle
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.SQL:
        assert oracle.differences(got, con.execute(registry.SQL[name]).df()) == ""
    else:
        assert len(got)

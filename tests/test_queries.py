"""Every registered query of the library against its SQL; those without SQL must give rows."""

import os

import pytest

from lattica.plans import registry

from . import oracle

QUERIES, SQL = registry.load()
pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    oracle.compare(spark, duck, name, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, oracle.SF).count() > 0

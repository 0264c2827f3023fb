"""Registered queries against their SQL."""

import os

import pytest

from lattica.llm import queries, sql

from .. import oracle


@pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(sql.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert oracle.compare(spark, oracle.connect(), name, queries.queries()[name], sql.ORACLE_SQL[name])

"""Queries against their DuckDB SQL on the smallest tables."""

import pytest

from spanline.llm import queries
from tests.compare import assert_same

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    assert_same(spark, queries.QUERIES[name](spark, DATA), queries.ORACLES[name], DATA)

"""Every query of the reference's operators against its DuckDB SQL."""

import pytest

from spanline.plans import queries
from tests.compare import assert_same

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_its_sql(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    if name in queries.ORACLES:
        assert_same(spark, got, queries.ORACLES[name], DATA)
    else:
        rows = got.collect()
        assert rows and len({str(r) for r in rows}) == len(rows)
        again = queries.QUERIES[name](spark, DATA).repartition(5).collect()
        assert sorted(map(str, rows)) == sorted(map(str, again))

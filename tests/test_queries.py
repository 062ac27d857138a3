"""Every query with SQL against DuckDB on the small tables."""

import pytest
from oracle import same

from tessera import queries, run_queries  # noqa: F401  (registers its queries with the others)


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query(spark, name):
    same(spark, "/root/testdata/sf0.001", queries.QUERIES[name], queries.ORACLE[name])

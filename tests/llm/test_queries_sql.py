"""The corpus queries that SQL can state, against DuckDB."""

from __future__ import annotations

import pytest

from ionframe.llm import queries
from tests.oracle import connection, difference

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got) and difference(got, connection(SF).execute(queries.ORACLE_SQL[name]).df()) == ""

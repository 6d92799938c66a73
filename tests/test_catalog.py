"""Every query with SQL against DuckDB on the small tables."""

from __future__ import annotations

import pytest

from ionframe import catalog
from tests.oracle import connection, difference

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
#: Queries that compare many pairs are tested on the smallest tables.
COSTLY = {"spectral_edges", "drift_corrected", "ion_components"}


@pytest.fixture(scope="module")
def con():
    return {sf: connection(sf) for sf in (SF, SMALL)}


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, con, name):
    sf = SMALL if name in COSTLY else SF
    got = catalog.QUERIES[name](spark, sf).toPandas()
    assert len(got), "no rows"
    assert difference(got, con[sf].execute(catalog.ORACLE_SQL[name]).df()) == ""

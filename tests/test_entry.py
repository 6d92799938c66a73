"""The driver contract: names, columns and the flagship query."""

from __future__ import annotations

import __spark_entry__ as e
from ionframe.operators.rangejoin import range_join


def test_entry_and_names(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_range_join_is_inclusive_and_ignores_nulls(spark):
    left = spark.createDataFrame([(1, 1.0), (2, 1.5), (3, None), (4, -0.25)], "i long, x double")
    right = spark.createDataFrame([(1, 1.25), (2, 0.0), (3, None)], "j long, y double")
    got = sorted((r["i"], r["j"]) for r in range_join(left, right, "x", "y", 0.25).collect())
    assert got == [(1, 1), (2, 1), (4, 2)]

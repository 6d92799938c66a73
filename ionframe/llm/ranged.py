"""Range-sorted RDDs: a DataFrame's rows in order over partitions that keep their numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame

from ionframe.llm.shared import groups_for, shared_dir

#: About how many (short) rows a partition gets.
ROWS = 50_000


def range_sorted(df: DataFrame, keys: list[str | Column], rows: int, per_partition: int = ROWS) -> RDD:
    """The rows of ``df`` as tuples, in the order of ``keys`` within and across partitions.

    The sorted rows are checkpointed to the shared folder, so partition k holds the same rows
    in every later pass, also after executors are lost. ``keys`` should tell rows apart, as
    equal ones stay in one partition.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = shared_dir(spark)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    n = groups_for(rows, per_partition, sc.defaultParallelism)
    found = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).rdd.map(tuple)
    found.checkpoint()
    return found


def beside(rows: RDD, told: RDD, use: Callable[[int, list, list], Iterator]) -> RDD:
    """``use(k, rows of partition k, what was told to k)``; told: (partition, value) pairs.

    Rows stay where they are; only ``told`` is shuffled.
    """
    n = rows.getNumPartitions()
    sent = told.partitionBy(n, int)
    more = sent.getNumPartitions() - n  # a session may hold a least number of partitions
    own = rows.union(rows.context.parallelize([], more)) if more > 0 else rows
    both = own.glom().zip(sent.values().glom())
    return both.mapPartitionsWithIndex(lambda k, parts: (out for own, heard in parts if k < n for out in use(k, own, heard)))

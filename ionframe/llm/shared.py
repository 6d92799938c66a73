"""Helpers that several operators share: table access, Arrow batches, kept rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.tables import shared_dir, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def groups_for(rows: int, per_group: int, least: int = 1) -> int:
    """How many hash groups keep about ``per_group`` rows each."""
    return max(least, -(-rows // per_group))


#: Most that one Arrow batch may hold, whatever the length of its texts.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch limits (never raises them), so that a worker's
    memory is bounded by bytes. Plans run later, so the limits stay lowered."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(str(spark.conf.get(key)).rstrip("bB"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
    "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
}


def rows_made(df: DataFrame, keys: list[str], fields: dict[str, str], start: Callable) -> DataFrame:
    """Rows of the columns ``keys`` of ``df``, unchanged, and new ``fields`` (name: type).

    ``start()`` is called once a task; what it returns takes an Arrow batch and gives
    the fields' values by name, and the batch row that each new row belongs to (None: its
    own). Keys stay in Arrow, so 64-bit ids beside nulls keep all their bits.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = start()
        for batch in batches:
            of, made = run(batch)
            own = [batch.column(k) for k in keys]
            if of is not None:
                own = [c.take(pa.array(np.asarray(of, np.int64))) for c in own]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(made[n], ARROW[t]) for n, t in fields.items())], names=[*keys, *fields])
        release()

    small_batches(df.sparkSession)
    told = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + [f"`{n}` {t}" for n, t in fields.items()]
    return df.mapInArrow(task, ", ".join(told))


#: Ids (8 bytes each) that may be broadcast; beyond it both sides are shuffled.
BROADCAST_IDS = 500_000


def text_key() -> Column:
    """128 bits that stand for a row's text."""
    return F.unhex(F.substring(F.sha2(text_or_empty().cast("binary"), 256), 1, 32))


def keep_documents(docs: DataFrame, kept: DataFrame, seen: DataFrame, key: Column | None = None) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, ``key``) is in ``kept`` (``doc_id, key``), one a pair.

    seen: the written ``doc_id, key`` of all rows of ``docs``; key: the expression over
    ``docs`` that gives it. Where no rows share an id, ids alone tell them apart, and no text
    is read for its key. The shorter of the lists of kept and of dropped rows is joined.
    """
    key = text_key() if key is None else key
    kept = written(kept.select("doc_id", "key").distinct(), "kept")
    same = seen["doc_id"].eqNullSafe(kept["doc_id"]) & (seen["key"] == kept["key"])
    gone = written(seen.join(kept, same, "left_anti").select("doc_id", "key").distinct(), "gone")
    n_kept, n_gone = kept.count(), gone.count()
    pairs, how, n = (kept, "left_semi", n_kept) if n_kept <= n_gone else (gone, "left_anti", n_gone)
    shared = seen.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if shared.isEmpty():
        ids = pairs.select(F.col("doc_id").alias("of_doc"))
        ids = F.broadcast(ids) if n <= BROADCAST_IDS else ids
        return docs.join(ids, docs["doc_id"].eqNullSafe(ids["of_doc"]), how)
    # internal columns stand beside the row, whatever the row's columns are called
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), key.alias("key"))
    out = rows.join(pairs, rows["id"].eqNullSafe(pairs["doc_id"]) & (rows["key"] == pairs["key"]), how)
    repeated = written(seen.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "key"), "repeated")
    again = out["id"].eqNullSafe(repeated["doc_id"]) & (out["key"] == repeated["key"])
    once = out.join(repeated, again, "left_semi").dropDuplicates(["id", "key"])
    return out.join(repeated, again, "left_anti").unionByName(once).select("row.*")


def release() -> None:
    """Gives what a finished task held back to the system, as Python workers live on."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _TRIM = None

"""Streams: the request inbox and the running state of curation events."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

REQUEST = "id string, command string, args map<string,string>"


def serve(spark: SparkSession, inbox: str, outbox: str, checkpoint: str, commands: Mapping[str, Callable[[Mapping[str, str]], DataFrame]]) -> StreamingQuery:
    """Answers JSON requests, one file a batch: each result goes to ``outbox/<id>`` and
    errors to ``outbox/failed``. Overwriting by id makes a repeated batch harmless.
    Ids name folders, so they hold letters, digits, ``_``, ``.`` and ``-`` only, do not begin
    with a dot and are not ``failed``. Only requests reach the driver, in the order of their ids and a partition
    at a time, never results."""

    def answer(batch: DataFrame, batch_id: int) -> None:
        failed = []
        for r in batch.orderBy("id").toLocalIterator():
            try:
                if not re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9_.-]*", r["id"] or "") or r["id"] == "failed":
                    raise ValueError("not an id")
                commands[r["command"]](r["args"] or {}).write.mode("overwrite").json(f"{outbox}/{r['id']}")
            except Exception as e:  # one bad request must not stop the queue
                failed.append((r["id"], r["command"], f"{type(e).__name__}: {str(e)[:300]}"))
        if failed:
            spark.createDataFrame(failed, "id string, command string, error string").write.mode("overwrite").json(f"{outbox}/failed/{batch_id}")

    requests = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).json(inbox)
    return requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_state(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The newest value of each key over an unbounded stream of events (update mode);
    state grows with the keys, not with the events."""
    return events.groupBy(key).agg(F.max_by(value, order).alias("state"), F.count("*").alias("n_events"))

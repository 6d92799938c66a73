"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset and the
    session is a local one, a folder of our own is made and kept for the session.
    """
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        sc = spark.sparkContext
        own = sc.getCheckpointDir()
        if not own:
            if not is_local(spark):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ionframe-"))
            own = sc.getCheckpointDir()
    return own.rstrip("/")


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return re.match(r"local(\[|$)", spark.sparkContext.master) is not None


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back (cuts the lineage)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

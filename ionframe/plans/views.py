"""Adapter views: mass-spectrometry tables over the star-schema test tables.

Every view is a lazy DataFrame; Catalyst prunes columns and pushes filters to the
parquet scans below it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_id, file_name, class, sample_type, injection_order, batch``."""
    digit = F.col("s_suppkey") % 10
    kind = F.when(digit == 0, "Blank").when(digit.isin(1, 2), "QC").otherwise("Sample")
    nations = _table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return _table(spark, sf_dir, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("file_id"), F.col("s_name").alias("file_name"), F.col("n_regionkey").cast("long").alias("class"),
        kind.alias("sample_type"), (F.col("s_suppkey") + 1).alias("injection_order"), (F.col("s_suppkey") % 2 + 1).alias("batch"))


def feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``spot_id, name, rt, mz, adduct, ontology``."""
    return _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("spot_id"), F.col("p_name").alias("name"), F.col("p_size").cast("double").alias("rt"),
        F.col("p_retailprice").alias("mz"), F.col("p_type").alias("adduct"), F.col("p_brand").alias("ontology"))


def spot_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``spot_id, file_id, height, area``: a sparse feature-by-file matrix."""
    return _table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("spot_id"), F.col("l_suppkey").alias("file_id")).agg(
        F.max("l_extendedprice").alias("height"), F.sum("l_extendedprice").alias("area"))


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scan_id, file_id, ms_level, rt (minutes), mz, intensity``: one peak a row."""
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("scan_id"), F.col("user_id").alias("file_id"),
        F.when(F.col("event_type") == "purchase", 2).otherwise(1).cast("long").alias("ms_level"),
        ((F.unix_micros(F.col("ts").cast("timestamp")) - start) / 60000000.0).alias("rt"),
        F.get_json_object("props", "$.k").cast("double").alias("mz"), F.col("value").alias("intensity"))


def peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``peak_id, file_id, mz, rt``: detected peaks to align and annotate."""
    return _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("peak_id"), (F.col("o_custkey") % 20).alias("file_id"),
        (F.col("o_totalprice") / 1000).alias("mz"), F.dayofyear("o_orderdate").cast("double").alias("rt"))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ref_id, ref_mz, ref_rt, ref_name``: reference compounds."""
    return _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ref_id"), (F.col("p_retailprice") / 4).alias("ref_mz"),
        (F.col("p_size") * 7).cast("double").alias("ref_rt"), F.col("p_name").alias("ref_name"))


def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``spectrum_id, precursor_mz``."""
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("spectrum_id"), (F.col("o_totalprice") / 1000).alias("precursor_mz"))


def fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``spectrum_id, mz, intensity``: product ions, one a nominal mass."""
    return _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("spectrum_id"), (F.col("l_partkey") % 40 + 50).cast("double").alias("mz")).agg(F.sum("l_quantity").alias("intensity"))


#: The same views in SQL, as common table expressions.
SQL = {
    "sample": """sample AS (SELECT s_suppkey AS file_id, s_name AS file_name, CAST(n_regionkey AS BIGINT) AS class,
        CASE WHEN s_suppkey % 10 = 0 THEN 'Blank' WHEN s_suppkey % 10 IN (1, 2) THEN 'QC' ELSE 'Sample' END AS sample_type,
        s_suppkey + 1 AS injection_order, s_suppkey % 2 + 1 AS batch FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "feature": """feature AS (SELECT p_partkey AS spot_id, p_name AS name, CAST(p_size AS DOUBLE) AS rt, p_retailprice AS mz,
        p_type AS adduct, p_brand AS ontology FROM part)""",
    "spot_peak": """spot_peak AS (SELECT l_partkey AS spot_id, l_suppkey AS file_id, max(l_extendedprice) AS height,
        sum(l_extendedprice) AS area FROM lineitem GROUP BY l_partkey, l_suppkey)""",
    "scan": """scan AS (SELECT event_id AS scan_id, user_id AS file_id,
        CAST(CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS BIGINT) AS ms_level,
        (epoch_us(ts) - 1704067200000000) / 60000000.0 AS rt,
        CAST(json_extract_string(props, '$.k') AS DOUBLE) AS mz, value AS intensity FROM events)""",
    "peak": """peak AS (SELECT o_orderkey AS peak_id, o_custkey % 20 AS file_id, o_totalprice / 1000 AS mz,
        CAST(dayofyear(o_orderdate) AS DOUBLE) AS rt FROM orders)""",
    "spectrum": "spectrum AS (SELECT o_orderkey AS spectrum_id, o_totalprice / 1000 AS precursor_mz FROM orders)",
    "fragment": """fragment AS (SELECT l_orderkey AS spectrum_id, CAST(l_partkey % 40 + 50 AS DOUBLE) AS mz, sum(l_quantity) AS intensity
        FROM lineitem GROUP BY 1, 2)""",
    "library": """library AS (SELECT p_partkey AS ref_id, p_retailprice / 4 AS ref_mz, CAST(p_size * 7 AS DOUBLE) AS ref_rt,
        p_name AS ref_name FROM part)""",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)

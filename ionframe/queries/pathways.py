"""Reactions between classes of features, and their chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.operators import pathways
from ionframe.plans import views
from ionframe.plans.views import with_views
from ionframe.registry import query, rounded


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes' summed heights by run, reactions from each brand to those that begin with its
    last digit, and the batches as groups."""
    named = views.feature(spark, sf_dir).select("spot_id", F.col("ontology").alias("node"))
    nodes = views.spot_peak(spark, sf_dir).join(named, "spot_id").groupBy("node", "file_id").agg(F.sum("height").alias("value"))
    kinds = named.select("node").distinct()
    ends = kinds.select(F.col("node").alias("source"), F.right("node", F.lit(1)).alias("d")), kinds.select(F.col("node").alias("target"), F.substring("node", -2, 1).alias("d"))
    return nodes, ends[0].join(ends[1], "d").where("source != target").drop("d"), views.sample(spark, sf_dir).select("file_id", F.col("batch").alias("grp"))


WEIGHTS = with_views("sample", "feature", "spot_peak") + """, node AS (SELECT ontology AS node, file_id, sum(height) AS value FROM spot_peak JOIN feature USING (spot_id) GROUP BY 1, 2),
    kind AS (SELECT DISTINCT ontology AS node FROM feature),
    reaction AS (SELECT a.node AS source, b.node AS target FROM kind a JOIN kind b ON right(a.node, 1) = substr(b.node, -2, 1) AND a.node <> b.node),
    weight AS (SELECT source, target, r.file_id, coalesce(p.value, 0) / r.value AS weight FROM reaction JOIN node r ON r.node = source LEFT JOIN node p ON p.node = target AND p.file_id = r.file_id WHERE r.value > 0)"""


@query(WEIGHTS + """, s AS (SELECT source, target, count(*) FILTER (batch = 1) AS n1, count(*) FILTER (batch = 2) AS n2, avg(weight) FILTER (batch = 1) AS m1, avg(weight) FILTER (batch = 2) AS m2,
        var_samp(weight) FILTER (batch = 1) AS v1, var_samp(weight) FILTER (batch = 2) AS v2 FROM weight JOIN sample USING (file_id) GROUP BY 1, 2)
    SELECT source, target, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 5) AS df
    FROM s WHERE n1 > 1 AND n2 > 1 AND v1 / n1 + v2 / n2 > 0""")
def reaction_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, reactions, groups = _tables(spark, sf_dir)
    told = pathways.tested(pathways.reaction_weights(nodes, reactions), groups).select("source", "target", "t", "df")
    return rounded(rounded(told, 6, "t"), 5, "df")


@query(None)  # SQL has no t distribution; tested against a depth-first search
def pathway_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of up to four reactions whose combined z reaches one."""
    nodes, reactions, groups = _tables(spark, sf_dir)
    found = pathways.chains(pathways.tested(pathways.reaction_weights(nodes, reactions), groups), 4, 1.0)
    return rounded(found.select(F.array_join("nodes", ">").alias("chain"), "n", "z"), 6, "z")

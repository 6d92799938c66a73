"""Reaction weights between two groups of runs, and chains of reactions."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ionframe.functions.distributions import student_p
from ionframe.operators.statistics import welch
from ionframe.tables import written

#: The least p that a score is taken from (fixed value).
LEAST_P = 1e-15


@F.pandas_udf(DoubleType())
def _normal_quantile(share: pd.Series) -> pd.Series:
    return share.map(lambda s: NormalDist().inv_cdf(s) if 0 < s < 1 else None)


def signed_score(p: Column, difference: Column) -> Column:
    """The normal quantile of 1 - p/2 with the sign of a difference."""
    return _normal_quantile(1 - F.greatest(p, F.lit(LEAST_P)) / 2) * F.signum(difference)


def reaction_weights(nodes: DataFrame, reactions: DataFrame) -> DataFrame:
    """``source, target, file_id, weight``: product over reactant of every reaction (``source,
    target``) in every run with the reactant, from ``node, file_id, value``; zero where the
    product is missing. Reactions with an unmeasured end have no rows."""
    held = nodes.where("value > 0")
    seen = nodes.select("node").distinct()
    both = reactions.select("source", "target").distinct().join(seen.toDF("target"), "target", "left_semi")
    of = both.join(held.select(F.col("node").alias("source"), "file_id", F.col("value").alias("reactant")), "source")
    met = of.join(nodes.select(F.col("node").alias("target"), "file_id", F.col("value").alias("product")), ["target", "file_id"], "left")
    return met.select("source", "target", "file_id", (F.coalesce("product", F.lit(0.0)) / F.col("reactant")).alias("weight"))


def tested(weights: DataFrame, groups: DataFrame) -> DataFrame:
    """``source, target, t, df, p, z``: Welch's test of the weights of groups 1 and 2
    (``file_id, grp``), where both have two or more; z is positive where group 1 has more."""
    edge = F.struct("source", "target")
    told = welch(weights.join(groups, "file_id").select(edge.alias("spot_id"), "grp", F.col("weight").alias("height")))
    told = told.select("spot_id.source", "spot_id.target", "t", "df").withColumn("p", student_p(F.col("t"), F.col("df")))
    return told.withColumn("z", signed_score(F.col("p"), F.col("t")))


def chains(edges: DataFrame, most: int, least: float = 0.0) -> DataFrame:
    """``nodes, n, z``: every chain of at most ``most`` tested edges (``source, target, z``) that
    visits no node twice, its z being the sum over the edges by the root of their number; those
    with abs(z) of ``least`` or more.

    Chains grow by an edge a round, a join of their last nodes with the edges. A chain that can
    no longer reach ``least``, even if all edges to come were the strongest there is, grows no more.
    """
    edges = written(edges.select("source", "target", "z").where("z is not null"), "reactions")
    top = edges.agg(F.max(F.abs(F.col("z")))).first()[0] or 0.0
    now = edges.select(F.array("source", "target").alias("nodes"), F.lit(1).alias("n"), F.col("z").alias("total"))
    found = now
    for n in range(2, most + 1):
        reach = F.lit(False)
        for k in range(n, most + 1):  # lengths still to come
            reach = reach | (F.abs(F.col("total")) + (k - n + 1) * top >= least * k**0.5 - 1e-9)
        last = now.where(reach).withColumn("last", F.element_at("nodes", -1))
        grown = last.join(edges, F.col("last") == F.col("source")).where(~F.array_contains("nodes", F.col("target")))
        now = written(grown.select(F.array_append("nodes", F.col("target")).alias("nodes"), F.lit(n).alias("n"), (F.col("total") + F.col("z")).alias("total")), "chains")
        found = found.unionByName(now)
    z = F.col("total") / F.sqrt(F.col("n").cast("double"))
    return found.select("nodes", "n", z.alias("z")).where(F.abs(F.col("z")) >= least)

"""Formulas for a mass, by a join of half-compositions in mass bins.

A formula is carbons and hydrogens on one side, nitrogen, oxygen, phosphorus and sulphur on
the other. Both halves are tables whose size is fixed by the bounds on atoms; what a target
lacks after its second half is looked up among the first halves of that mass, so no task
walks through all compositions.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.functions.chemistry import MASS
from ionframe.operators.rangejoin import range_join


class Bounds(NamedTuple):
    """Most atoms of each element, and the largest ratios to carbon (fixed values)."""

    n: int = 10
    o: int = 20
    p: int = 3
    s: int = 3
    ratio_h: float = 3.1
    ratio_n: float = 1.3
    ratio_o: float = 1.2
    ratio_p: float = 0.3
    ratio_s: float = 0.8


def _mass(**atoms: Column) -> Column:
    parts = [F.lit(MASS[e.upper()]) * c for e, c in atoms.items()]
    return sum(parts[1:], parts[0])


def _counts(spark: SparkSession, **most: int | Column) -> DataFrame:
    made = spark.range(1).select()
    for element, top in most.items():
        made = made.withColumn(element, F.explode(F.sequence(F.lit(0), top if isinstance(top, Column) else F.lit(top))))
    return made


def candidates(targets: DataFrame, tol: float, bounds: Bounds = Bounds()) -> DataFrame:  # noqa: B008
    """``target_id, c, h, n, o, p, s, formula, rdbe, error, score``: formulas whose mass lies
    within ``tol`` of ``target_id, mass``.

    At least one carbon, even electrons (a whole number of rings and double bonds of zero or
    more) and the bounds' ratios hold. The score is the Gaussian of the error with the
    tolerance as its deviation.
    """
    spark = targets.sparkSession
    top = targets.agg(F.max("mass")).first()[0]
    if top is None:
        top = 0.0
    small = _counts(spark, n=bounds.n, o=bounds.o, p=bounds.p, s=bounds.s)
    small = small.withColumn("part", _mass(n=F.col("n"), o=F.col("o"), p=F.col("p"), s=F.col("s"))).where(F.col("part") <= top + tol)
    most_c = int((top + tol) // MASS["C"])
    large = _counts(spark, c=max(most_c, 1), h=F.floor(F.col("c") * bounds.ratio_h).cast("int")).where("c > 0")
    large = large.withColumn("rest", _mass(c=F.col("c"), h=F.col("h"))).where(F.col("rest") <= top + tol)
    # the second halves are as many as the bounds allow, whatever the targets: some thousands
    needed = targets.select("target_id", "mass").join(F.broadcast(small), F.col("part") + MASS["C"] <= F.col("mass") + tol).withColumn("lack", F.col("mass") - F.col("part"))
    met = range_join(needed, large, "lack", "rest", tol)
    doubled = 2 * F.col("c") + 2 + F.col("n") + F.col("p") - F.col("h")
    within = [F.col(e) <= F.col("c") * getattr(bounds, f"ratio_{e}") for e in "nops"]
    kept = met.where((doubled >= 0) & (doubled % 2 == 0) & within[0] & within[1] & within[2] & within[3])
    text = F.concat(*[F.when(F.col(e) > 1, F.concat(F.lit(e.upper()), F.col(e).cast("string"))).when(F.col(e) == 1, e.upper()).otherwise("") for e in "chnops"])
    error = F.col("part") + F.col("rest") - F.col("mass")
    return kept.select("target_id", *"chnops", text.alias("formula"), (doubled / 2).cast("int").alias("rdbe"), error.alias("error"), F.exp(-0.5 * F.pow(error / tol, F.lit(2))).alias("score"))

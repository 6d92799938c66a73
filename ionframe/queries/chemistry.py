"""Isotope patterns, formulas for masses, packed arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.functions import isotopes
from ionframe.operators import formulas
from ionframe.plans import views
from ionframe.plans.views import with_views
from ionframe.registry import query, rounded
from ionframe.sources import numpress
from ionframe.tables import written


@query(None)  # convolutions; tested against a loop
def isotope_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isotope peaks of a formula for every part: a chain with oxygens, sulphur and chlorine."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    size = F.col("p_size")
    formula = F.format_string("C%dH%dN%dO%dS%dCl%d", size + 2, size * 2 + 1, size % 4 + 1, size % 7 + 1, size % 3 + 1, size % 2 + 1)
    # formulas are few and costly: one a task, and each once
    kinds = part.select(formula.alias("formula")).distinct().repartition(64)
    kinds = written(kinds.select("formula", isotopes.isotope_pattern(F.col("formula")).alias("peaks")), "isotopes")
    told = part.select(F.col("p_partkey").alias("spot_id"), formula.alias("formula")).join(kinds, "formula")
    return rounded(told.select("spot_id", "formula", F.posexplode("peaks").alias("k", "p")).select("spot_id", "formula", "k", "p.mass", "p.share"), 6, "mass", "share")


@query(None)  # tested against all compositions up to 500 Da
def formula_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas within 1 mDa of every mass of the library."""
    masses = views.library(spark, sf_dir).select(F.col("ref_mz").alias("mass")).distinct()
    found = formulas.candidates(masses.select((F.col("mass") * 10000).cast("long").alias("target_id"), "mass"), 0.001)
    return rounded(found, 6, "error", "score")


@query(with_views("fragment") + "SELECT spectrum_id, count(*) AS n, round(sum(mz), 4) AS sum_mz, round(sum(intensity), 4) AS sum_intensity, true AS near FROM fragment GROUP BY spectrum_id")
def packed_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spectrum's arrays packed and unpacked: masses by lines, intensities as whole
    numbers, and as logarithms (near: to 0.1 %)."""
    held = views.fragment(spark, sf_dir).groupBy("spectrum_id").agg(F.sort_array(F.collect_list(F.struct("mz", "intensity"))).alias("p"))
    bytes_ = held.select("spectrum_id", numpress.packed(F.col("p.mz"), "linear").alias("m"), numpress.packed(F.col("p.intensity"), "pic").alias("i"), numpress.packed(F.col("p.intensity"), "slof").alias("s"))
    back = bytes_.select("spectrum_id", numpress.unpacked(F.col("m"), "linear").alias("m"), numpress.unpacked(F.col("i"), "pic").alias("i"), numpress.unpacked(F.col("s"), "slof").alias("s"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    near = F.forall(F.zip_with("i", "s", lambda a, b: F.abs(a - b) <= a * 0.001), lambda ok: ok)
    return rounded(back.select("spectrum_id", F.size("m").cast("long").alias("n"), total("m").alias("sum_mz"), total("i").alias("sum_intensity"), near.alias("near")), 4, "sum_mz", "sum_intensity")

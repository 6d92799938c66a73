"""Lipid names, formulas and adducts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.functions import chemistry
from ionframe.registry import query

#: Five shapes of names, from a part's size (c, d: carbons and double bonds of the sum).
NAMES = """WITH n AS (SELECT p_partkey AS spot_id, p_partkey % 5 AS shape, p_size % 30 + 20 AS c, p_size % 4 AS d FROM part),
    named AS (SELECT *, CASE shape WHEN 0 THEN 'PC ' || c || ':' || d WHEN 1 THEN 'PE ' || (c - 16) || ':' || d || '/16:0'
        WHEN 2 THEN 'TG ' || c || ':' || d || '|TG 16:0_' || (c - 16) || ':' || d WHEN 3 THEN 'low score: SM d' || (c - 4) || ':' || d || '/4:0;O'
        ELSE 'PC d7 ' || c || ':' || d END AS name FROM n)"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    n = part.select(F.col("p_partkey").alias("spot_id"), (F.col("p_partkey") % 5).alias("shape"), (F.col("p_size") % 30 + 20).alias("c"), (F.col("p_size") % 4).alias("d"))
    text = lambda form, *cols: F.format_string(form, *cols)
    name = F.when(F.col("shape") == 0, text("PC %d:%d", "c", "d")).when(F.col("shape") == 1, text("PE %d:%d/16:0", F.col("c") - 16, F.col("d")))
    name = name.when(F.col("shape") == 2, text("TG %d:%d|TG 16:0_%d:%d", F.col("c"), F.col("d"), F.col("c") - 16, F.col("d")))
    name = name.when(F.col("shape") == 3, text("low score: SM d%d:%d/4:0;O", F.col("c") - 4, F.col("d"))).otherwise(text("PC d7 %d:%d", "c", "d"))
    return n.withColumn("name", name)


@query(NAMES + """SELECT spot_id, name, ['PC', 'PE', 'TG', 'SM', 'PC'][shape + 1] AS lipid_class, CAST(c AS BIGINT) AS carbons, CAST(d AS BIGINT) AS double_bonds FROM named""")
def lipid_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return _named(spark, sf_dir).select("spot_id", "name", chemistry.lipid_class(name).alias("lipid_class"), chemistry.lipid_sum(name)["carbons"].alias("carbons"), chemistry.lipid_sum(name)["double_bonds"].alias("double_bonds"))


@query(NAMES + """SELECT spot_id, CASE shape WHEN 1 THEN (c - 16) || ':' || d || ',16:0' WHEN 2 THEN '16:0,' || (c - 16) || ':' || d WHEN 3 THEN (c - 4) || ':' || d || ',4:0' ELSE c || ':' || d END AS chains,
    CASE shape WHEN 3 THEN 'suggested' ELSE 'confident' END AS level, shape = 4 AS standard FROM named""")
def lipid_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return _named(spark, sf_dir).select("spot_id", F.array_join(chemistry.lipid_chains(name), ",").alias("chains"), chemistry.annotation_level(name).alias("level"), chemistry.is_standard(name).alias("standard"))


@query(NAMES + """SELECT spot_id, CASE WHEN shape = 4 THEN 100 WHEN shape = 0 AND c % 2 = 1 THEN 40 ELSE 0 END AS score FROM named""")
def standard_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each feature would serve as the standard of class PC."""
    return _named(spark, sf_dir).select("spot_id", chemistry.standard_score(F.col("name"), F.lit(""), F.lit("PC")).alias("score"))


@query(NAMES + """SELECT spot_id, CASE shape WHEN 0 THEN 'O-PC' WHEN 1 THEN 'P-PE' WHEN 2 THEN 'TG' WHEN 3 THEN CASE WHEN d = 0 THEN 'dhSM' ELSE 'SM' END ELSE 'PC' END AS network_class FROM named""")
def network_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _named(spark, sf_dir)
    ontology = F.element_at(F.array(*[F.lit(x) for x in ("EtherPC", "EtherPE", "TG", "SM", "PC_d7")]), F.col("shape").cast("int") + 1)
    name = F.when(F.col("shape") == 1, F.replace("name", F.lit("PE "), F.lit("PE P-"))).otherwise(F.col("name"))
    return n.select("spot_id", chemistry.ether_class(ontology, name).alias("network_class"))


@query("""SELECT p_partkey AS spot_id, 'C' || (p_size + 2) || 'H' || (2 * p_size + 5) || 'ClO' || (p_size % 7 + 2) AS formula,
    round((p_size + 2) * 12.0 + (2 * p_size + 5) * 1.00782503207 + 34.96885268 + (p_size % 7 + 2) * 15.99491461956, 6) AS mass,
    round((p_size + 2) * 12.0107 + (2 * p_size + 5) * 1.00794 + 35.453 + (p_size % 7 + 2) * 15.9994, 6) AS average,
    ((p_size + 2) * 2 - (2 * p_size + 5) - 1 + 2) / 2.0 AS rdbe, round((p_size + 2) * 0.0107 / 0.9893 + (2 * p_size + 5) * 0.000115 / 0.999885, 9) AS heavy FROM part""")
def bracket_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas with brackets, written out and in Hill order; masses, rings, M+1."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.format_string("ClC%dH%dO%d(CH2O)2H", F.col("p_size"), F.col("p_size") * 2, F.col("p_size") % 7)
    flat = part.select(F.col("p_partkey").alias("spot_id"), chemistry.hill_formula(chemistry.flat_formula(F.replace(text, F.lit("O0("), F.lit("(")))).alias("formula"))
    f = F.col("formula")
    return flat.select("spot_id", "formula", F.round(chemistry.monoisotopic_mass(f), 6).alias("mass"), F.round(chemistry.average_mass(f), 6).alias("average"), chemistry.ring_double_bonds(f).alias("rdbe"), F.round(chemistry.carbon_isotope(f), 9).alias("heavy"))


@query("""WITH a AS (SELECT * FROM (VALUES (0, 1, 1.00727646688), (1, 1, 22.98922421), (2, -1, -1.00727646688), (3, 2, 2.01455293376)) t(k, charge, delta))
    SELECT p_partkey AS spot_id, round((p_retailprice + CAST(delta AS DOUBLE)) / abs(charge), 6) AS mz, round(p_retailprice * abs(charge) - CAST(delta AS DOUBLE), 6) AS neutral,
        round((p_retailprice + 0.001 - p_retailprice) / p_retailprice * 1e6, 4) AS ppm FROM part JOIN a ON p_partkey % 4 = k""")
def adduct_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.element_at(F.array(*[F.lit(x) for x in ("M+H+", "[M + Na]1+", "[M-H]-", "[M+2H]2+")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    told = part.select(F.col("p_partkey").alias("spot_id"), F.col("p_retailprice").alias("mass"), chemistry.adduct_of(name).alias("adduct"))
    return told.select("spot_id", F.round(chemistry.ion_mz(F.col("mass"), F.col("adduct")), 6).alias("mz"), F.round(chemistry.neutral_mass(F.col("mass"), F.col("adduct")), 6).alias("neutral"), F.round(chemistry.error_ppm(F.col("mass") + 0.001, F.col("mass")), 4).alias("ppm"))

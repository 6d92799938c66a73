"""Filters, tag and fragment searches, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.operators import scans, search, signal
from ionframe.operators.search import FeatureQuery, FragmentQuery
from ionframe.plans import views
from ionframe.plans.views import with_views
from ionframe.registry import query, rounded

TAGGED = """WITH tagged AS (SELECT p_partkey AS spot_id, p_name AS name, p_retailprice AS mz, CAST(p_size AS DOUBLE) AS rt,
    string_split(p_type, ' ') AS tags, p_brand AS ontology FROM part)"""


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with tags: the words of the part's type."""
    f = views.feature(spark, sf_dir)
    return f.select("spot_id", "name", "mz", "rt", F.split("adduct", " ").alias("tags"), "ontology")


@query(TAGGED + """SELECT spot_id, list_has_any(tags, ['ECONOMY', 'BRASS']) AS any_tag, list_has_all(tags, ['ECONOMY', 'BRASS']) AS all_tags,
    NOT list_has_any(tags, ['ECONOMY', 'BRASS']) AS no_tag, NOT list_has_all(tags, ['ECONOMY', 'BRASS']) AS not_all_tags FROM tagged""")
def tag_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ["ECONOMY", "BRASS"]
    names = zip(search.TAG_RULES, ("any_tag", "all_tags", "no_tag", "not_all_tags"), strict=True)
    return _tagged(spark, sf_dir).select("spot_id", *[search.tag_matched(F.col("tags"), wanted, r).alias(n) for r, n in names])


@query(TAGGED + """SELECT spot_id, mz, rt FROM tagged WHERE mz BETWEEN 905 AND 1500 AND rt BETWEEN 5 AND 45 AND contains(lower(name), 'a') AND contains(lower(name), 'e')
    AND ontology IN ('Brand#11', 'Brand#12', 'Brand#23') OR (mz BETWEEN 905 AND 1500 AND rt BETWEEN 5 AND 45 AND list_has_any(tags, ['PROMO']) AND lower(ontology) = 'brand#13')""")
def spots_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value, keyword and tag filters together."""
    t = _tagged(spark, sf_dir).where(F.col("mz").between(905, 1500) & F.col("rt").between(5, 45))
    words = search.keyword_matched(F.col("name"), ["a", "E"], "all") & search.keyword_matched(F.col("ontology"), ["brand#11", "Brand#12", "BRAND#23"], "exact")
    tags = search.tag_matched(F.col("tags"), ["PROMO"], "any") & search.keyword_matched(F.col("ontology"), ["Brand#13"], "exact")
    return t.where(words | tags).select("spot_id", "mz", "rt")


@query("""SELECT p_partkey AS spot_id FROM part WHERE (p_size & 3) <> 0 AND (p_size & 24) = 24""")
def display_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.feature(spark, sf_dir)
    return f.where(search.display_matched(F.col("rt").cast("int"), 3, 7, 24)).select("spot_id")


@query(with_views("feature", "spot_peak") + """, h AS (SELECT spot_id, max(height) AS height FROM spot_peak GROUP BY spot_id), f AS (SELECT spot_id, rt, mz, height FROM feature JOIN h USING (spot_id)),
    t AS (SELECT max(height) AS top FROM f) SELECT spot_id, rt, mz, height FROM f, t
    WHERE (rt >= 40 AND height >= 1000 AND height / top * 100 >= 50) OR (rt < 5 AND height < 90000 AND height / top * 100 < 100 AND abs(mz - 1000) <= 80)""")
def feature_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    heights = views.spot_peak(spark, sf_dir).groupBy("spot_id").agg(F.max("height").alias("height"))
    f = views.feature(spark, sf_dir).join(heights, "spot_id").select("spot_id", "rt", "mz", "height")
    return search.features_found(f, [FeatureQuery(40, 1000, 50), FeatureQuery(5, 90000, 100, 1000, 80, "below")])


FRAGMENT_SQL = with_views("spectrum", "fragment") + """, b AS (SELECT *, intensity / max(intensity) OVER (PARTITION BY spectrum_id) * 100 AS share FROM fragment JOIN spectrum USING (spectrum_id)),
    q AS (SELECT spectrum_id, bool_or(abs(mz - 60) <= 3 AND share >= 20) AS q1, bool_or(abs(precursor_mz - mz - 90) <= 40 AND share >= 10) AS q2,
        bool_or(abs(mz - 80) <= 5 AND share > 90) AS q3 FROM b GROUP BY spectrum_id)
    SELECT spectrum_id, CAST(q1 AS BIGINT) + CAST(q2 AS BIGINT) + CAST(q3 AS BIGINT) AS n_queries FROM q WHERE """
FRAGMENT_QUERIES = [FragmentQuery(60, 3, 20), FragmentQuery(90, 40, 10, loss=True), FragmentQuery(80, 5, 90, condition="above")]


@query(FRAGMENT_SQL + "q1 AND q2 AND q3")
def fragments_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fragments_found(views.spectrum(spark, sf_dir), views.fragment(spark, sf_dir), FRAGMENT_QUERIES, True)


@query(FRAGMENT_SQL + "q1 OR q2 OR q3")
def fragments_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fragments_found(views.spectrum(spark, sf_dir), views.fragment(spark, sf_dir), FRAGMENT_QUERIES, False)


@query("""SELECT p_partkey AS spot_id, 2 AS n_masses, round(p_size + p_retailprice, 4) AS total, 'x' || p_size || '|-1' AS rejected FROM part""")
def mz_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.format_string("%d, x%d;;-1\t%s ", "p_size", "p_size", F.col("p_retailprice").cast("decimal(12,2)").cast("string"))
    return part.select(F.col("p_partkey").alias("spot_id"), search.mz_list(text).alias("m")).select("spot_id", F.size("m.masses").alias("n_masses"), F.round(F.aggregate("m.masses", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.array_join("m.rejected", "|").alias("rejected"))


CHANNEL = with_views("scan") + ", s AS (SELECT *, mz AS parent_mz, file_id % 4 AS experiment_id FROM scan)"


@query(CHANNEL + """SELECT 'ms1' AS source, count(*) AS n, round(sum(intensity), 4) AS total FROM s WHERE ms_level = 1
    UNION ALL SELECT 'ms2-all', count(*), round(sum(intensity), 4) FROM s WHERE ms_level > 1
    UNION ALL SELECT 'channel:2', count(*), round(sum(intensity), 4) FROM s WHERE experiment_id = 2
    UNION ALL SELECT 'gated:40', count(*), round(sum(intensity), 4) FROM s WHERE ms_level > 1 AND parent_mz > 0 AND abs(parent_mz - 40) <= 0.05
    UNION ALL SELECT 'gated:40:3', count(*), round(sum(intensity), 4) FROM s WHERE ms_level > 1 AND parent_mz > 0 AND abs(parent_mz - 40) <= 3""")
def scan_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scan(spark, sf_dir).withColumns({"parent_mz": F.col("mz"), "experiment_id": F.col("file_id") % 4})
    parts = [search.source_rows(s, name).agg(F.lit(name).alias("source"), F.count("*").alias("n"), F.round(F.sum("intensity"), 4).alias("total")) for name in ("ms1", "ms2-all", "channel:2", "gated:40", "gated:40:3")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(with_views("scan") + """SELECT file_id, round(rt, 6) AS rt, round(sum(CASE WHEN intensity BETWEEN 5 AND 90 THEN intensity ELSE 0 END), 6) AS intensity FROM scan WHERE ms_level > 1 AND mz BETWEEN 20 AND 60 GROUP BY file_id, rt""")
def product_ion_chromatogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precursors 20 to 60; the peak's intensity stands for the product's m/z in this table."""
    s = views.scan(spark, sf_dir).withColumns({"parent_mz": F.col("mz"), "product_mz": F.col("intensity")})
    return rounded(scans.product_ions(s, (20.0, 60.0), (5.0, 90.0)), 6, "rt", "intensity")


@query(with_views("fragment") + """, t AS (SELECT DISTINCT CAST(p_size + 50 AS DOUBLE) AS target FROM part)
    SELECT spectrum_id, target, round(sum(intensity), 4) AS amount FROM fragment JOIN t ON abs(mz - target) < 1.5 GROUP BY spectrum_id, target""")
def fragment_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_size") + 50).cast("double").alias("target")).distinct()
    return rounded(scans.amounts(views.fragment(spark, sf_dir), targets, 1.5), 4, "amount")


@query(with_views("feature", "spot_peak") + """, h AS (SELECT spot_id, max(height) AS height FROM spot_peak GROUP BY spot_id), f AS (SELECT spot_id, rt, mz, height FROM feature JOIN h USING (spot_id)),
    t AS (SELECT s_suppkey AS target_id, 900 + s_suppkey AS target_mz, CAST(s_nationkey * 2 AS DOUBLE) AS target_rt FROM supplier)
    SELECT target_id, spot_id FROM t JOIN f ON abs(mz - target_mz) <= 2 AND abs(rt - target_rt) <= 5 AND height >= 30000""")
def target_compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    heights = views.spot_peak(spark, sf_dir).groupBy("spot_id").agg(F.max("height").alias("height"))
    targets = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("target_id"), (F.col("s_suppkey") + 900).cast("double").alias("target_mz"), (F.col("s_nationkey") * 2).cast("double").alias("target_rt"))
    return search.targets_found(views.feature(spark, sf_dir).join(heights, "spot_id"), targets, 2.0, 5.0, 30000.0)


def mass_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walked in order within runs of near masses; tested against a loop."""
    return search.mass_groups(views.feature(spark, sf_dir), 0.05)


mass_groups = query(None)(mass_groups)


@query(with_views("scan") + """SELECT file_id, count(*) AS n_points, round(CASE WHEN count(*) > 1 AND max(y) > min(y) THEN max(y) - min(y) END, 6) AS peak_to_peak,
    round(CASE WHEN count(*) > 1 AND stddev_samp(y) > 0 THEN stddev_samp(y) END, 6) AS deviation
    FROM (SELECT file_id, rt, sum(CASE WHEN mz BETWEEN 35 AND 45 THEN intensity ELSE 0 END) AS y FROM scan WHERE ms_level = 1 GROUP BY file_id, rt) WHERE rt BETWEEN 5000 AND 25000 GROUP BY file_id""")
def region_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal.manual_noise(scans.xic(views.scan(spark, sf_dir), 40.0, 5.0), 25000.0, 5000.0), 6, "peak_to_peak", "deviation")


@query(with_views("scan") + """, x AS (SELECT file_id, rt, sum(CASE WHEN mz BETWEEN 35 AND 65 THEN intensity ELSE 0 END) AS y FROM scan WHERE ms_level = 1 GROUP BY file_id, rt),
    w AS (SELECT *, lead(rt) OVER o AS r2, lead(y) OVER o AS y2, row_number() OVER (PARTITION BY file_id ORDER BY y DESC, rt) AS k FROM x WHERE rt BETWEEN 8000 AND 30000 WINDOW o AS (PARTITION BY file_id ORDER BY rt))
    SELECT file_id, round(max(CASE WHEN k = 1 THEN rt END), 6) AS apex_rt, round(max(y), 6) AS height, round(min(rt), 6) AS rt_left, round(max(rt), 6) AS rt_right,
        round(sum((r2 - rt) * (y + y2) / 2) * 60, 2) AS area, round(greatest(0, sum((r2 - rt) * (y + y2) / 2) * 60 - (arg_min(y, rt) + arg_max(y, rt)) / 2 * (max(rt) - min(rt)) * 60), 2) AS area_above_baseline
    FROM w GROUP BY file_id HAVING count(*) > 1""")
def reintegrated_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signal.reintegrated(scans.xic(views.scan(spark, sf_dir), 50.0, 15.0), 8000.0, 30000.0)
    return rounded(rounded(out, 6, "apex_rt", "height", "rt_left", "rt_right"), 2, "area", "area_above_baseline")

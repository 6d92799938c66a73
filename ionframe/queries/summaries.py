"""Curation flags, envelopes, links by abundance, run summaries, matrix preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.functions import distributions
from ionframe.operators import statistics, summaries
from ionframe.plans import views
from ionframe.plans.views import with_views
from ionframe.queries.results import DENSE_SQL, _values
from ionframe.registry import query, rounded


@query(with_views("sample", "feature", "spot_peak") + DENSE_SQL + """, t AS (SELECT spot_id, avg(h) FILTER (sample_type = 'Blank') AS b, greatest(avg(h) FILTER (sample_type = 'QC'), avg(h) FILTER (sample_type = 'Sample')) AS s
        FROM dense GROUP BY spot_id),
    c AS (SELECT spot_id, class, stddev_samp(h) * 100 / avg(h) AS r FROM dense WHERE sample_type <> 'Blank' GROUP BY spot_id, class HAVING count(*) > 1 AND sum(h) > 0),
    r AS (SELECT spot_id, min(r) AS rsd FROM c GROUP BY spot_id),
    f AS (SELECT spot_id, mz, b >= 0.9 * s AS blank, rsd FROM t JOIN feature USING (spot_id) LEFT JOIN r USING (spot_id)),
    g AS (SELECT DISTINCT round(mz, 3) AS m FROM f WHERE blank)
    SELECT spot_id, blank, NOT blank AND round(mz, 3) IN (SELECT m FROM g) AS ghost, mz - floor(mz) >= mz * 0.00111 + 0.039 AS above_line, coalesce(rsd >= 120, false) AS spread,
        (mz - floor(mz)) / mz * 1e6 < 50 OR (mz - floor(mz)) / mz * 1e6 > 800 AS relative FROM f""")
def curation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.curation_flags(_values(spark, sf_dir), views.feature(spark, sf_dir), views.sample(spark, sf_dir), 0.9, 120.0, (50.0, 800.0))


@query(with_views("peak") + """, s AS (SELECT mz, max(rt) AS intensity FROM peak GROUP BY mz), t AS (SELECT s_suppkey AS target_id, CAST(s_suppkey + 100 AS DOUBLE) AS target_mz FROM supplier),
    w AS (SELECT target_id, k AS isotope, target_mz + k * 1.0033548378 AS goal FROM t, range(4) r(k)),
    b AS (SELECT target_id, isotope, mz, intensity, row_number() OVER (PARTITION BY target_id, isotope ORDER BY intensity DESC, mz) AS n FROM w JOIN s ON abs(mz - goal) <= 0.1),
    m AS (SELECT target_id, intensity AS mono FROM b WHERE isotope = 0 AND n = 1)
    SELECT target_id, isotope, mz, intensity, round(intensity / mono, 6) AS relative FROM b JOIN m USING (target_id) WHERE n = 1""")
def isotope_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All peaks as one spectrum (the day stands for the intensity), targets by supplier."""
    spectrum = views.peak(spark, sf_dir).groupBy("mz").agg(F.max("rt").alias("intensity"))
    targets = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("target_id"), (F.col("s_suppkey") + 100).cast("double").alias("target_mz"))
    return rounded(summaries.isotope_envelope(spectrum, targets, 4, 0.1), 6, "relative")


@query(with_views("sample", "feature", "spot_peak") + DENSE_SQL + """, d AS (SELECT spot_id, file_id, h, rt FROM dense JOIN feature USING (spot_id)),
    c AS (SELECT a.spot_id AS one, b.spot_id AS two, corr(a.h, b.h) AS correlation FROM d a JOIN d b ON a.file_id = b.file_id AND a.spot_id < b.spot_id AND abs(a.rt - b.rt) <= 0.5 GROUP BY 1, 2)
    SELECT one, two, round(correlation, 6) AS correlation FROM c WHERE round(correlation, 9) >= 0.3""")
def abundance_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spots, profiles over all runs."""
    files = views.sample(spark, sf_dir).select("file_id").distinct()
    held = _values(spark, sf_dir).where("height > 0").join(F.broadcast(files), "file_id", "left_semi").withColumnRenamed("spot_id", "id")
    found = summaries.abundance_links_sparse(views.feature(spark, sf_dir).select(F.col("spot_id").alias("id"), "rt"), held, files.count(), 0.5, 0.3)
    return rounded(found, 6, "correlation")


@query(with_views("scan") + """SELECT file_id, count(DISTINCT scan_id) AS n_scans, count(DISTINCT ms_level) AS n_levels, count(*) FILTER (ms_level <= 1) AS n_survey, count(*) FILTER (ms_level > 1) AS n_product,
    round(min(rt), 6) AS first_rt, round(max(rt), 6) AS last_rt, min(mz) AS low_mz, max(mz) AS high_mz FROM scan GROUP BY file_id""")
def run_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.run_info(views.scan(spark, sf_dir)), 6, "first_rt", "last_rt")


@query(with_views("scan") + """SELECT scan_id, file_id, ms_level, round(rt, 4) AS rt, mz AS parent_mz, round(intensity, 4) AS total FROM scan WHERE rt BETWEEN 1000 AND 9000 AND ms_level = 2 AND abs(mz - 50) <= 10""")
def scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans of a level and time range with a parent near a mass."""
    s = views.scan(spark, sf_dir).where(F.col("rt").between(1000, 9000) & (F.col("ms_level") == 2) & (F.abs(F.col("mz") - 50) <= 10))
    return s.select("scan_id", "file_id", "ms_level", F.round("rt", 4).alias("rt"), F.col("mz").alias("parent_mz"), F.round("intensity", 4).alias("total"))


@query(with_views("spot_peak") + """, o AS (SELECT *, row_number() OVER (PARTITION BY spot_id ORDER BY height) AS k, count(*) OVER (PARTITION BY spot_id) AS n FROM spot_peak)
    SELECT spot_id, round(avg(height), 5) AS mean, round(stddev_samp(height), 4) AS deviation, max(CASE WHEN k = n // 2 + 1 THEN height END) AS median, round(max(height) - min(height), 4) AS range FROM o GROUP BY spot_id""")
def scalar_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(summaries.scalar_summary(_values(spark, sf_dir)), 5, "mean"), 4, "deviation", "range")


@query(with_views("sample", "spot_peak") + """, p AS (SELECT a.file_id AS one, a.file_id + 1 AS two FROM sample a WHERE a.batch = 2),
    d AS (SELECT x.spot_id, x.height - y.height AS d FROM spot_peak x JOIN p ON x.file_id = one JOIN spot_peak y ON y.file_id = two AND y.spot_id = x.spot_id)
    SELECT spot_id, count(*) - 1 AS df, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t FROM d GROUP BY spot_id HAVING count(*) > 1 AND stddev_samp(d) > 0""")
def paired_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run of the second batch against the run after it."""
    pairs = views.sample(spark, sf_dir).where("batch = 2").select(F.col("file_id").alias("one"), (F.col("file_id") + 1).alias("two"))
    return rounded(summaries.paired(_values(spark, sf_dir), pairs), 6, "t")


@query(with_views("sample", "spot_peak") + """, k AS (SELECT spot_id FROM spot_peak GROUP BY spot_id HAVING (SELECT count(*) FROM sample) - count(*) <= (SELECT count(*) FROM sample) * 0.75)
    SELECT spot_id, file_id, height FROM spot_peak JOIN k USING (spot_id)""")
def often_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.often_present(_values(spark, sf_dir), views.sample(spark, sf_dir), 0.75)


@query(with_views("spot_peak") + """, c AS (SELECT spot_id, stddev_samp(height) / avg(height) AS v FROM spot_peak GROUP BY spot_id HAVING count(*) > 1),
    k AS (SELECT *, row_number() OVER (ORDER BY v DESC, spot_id) AS place, count(*) OVER () AS n FROM c)
    SELECT spot_id, round(v, 7) AS variation, place FROM k WHERE place <= ceil(n * 0.25)""")
def most_varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.most_varied(_values(spark, sf_dir), 0.25), 7, "variation")


@query(with_views("spot_peak") + """, m AS (SELECT file_id, quantile_disc(height, 0.5) AS middle FROM spot_peak GROUP BY file_id) SELECT spot_id, file_id, round(height / middle, 8) AS value FROM spot_peak JOIN m USING (file_id)""")
def median_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.median_normalised(_values(spark, sf_dir)), 8, "value")


@query(with_views("feature") + """, c AS (SELECT spot_id, row_number() OVER (ORDER BY spot_id) AS k FROM feature WHERE ontology = 'Brand#11')
    SELECT spot_id, name, mz, CAST(NULL AS BIGINT) AS split_from FROM feature UNION ALL SELECT (SELECT max(spot_id) FROM feature) + k, name, mz, spot_id FROM feature JOIN c USING (spot_id)""")
def isomers_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.feature(spark, sf_dir).select("spot_id", "name", "mz", "ontology")
    return summaries.split_copies(f, f.where("ontology = 'Brand#11'")).select("spot_id", "name", "mz", "split_from")


@query("""WITH p AS (SELECT p_partkey AS spot_id, p_retailprice AS m, 0.5 + p_size / 100.0 AS k, p_size % 2 + 1 AS z FROM part)
    SELECT spot_id, round(18509.863216340458 * z * k / sqrt(m * 28.0134 / (m + 28.0134) * 305), 6) AS trapped, round(18509.863216340458 * z / (sqrt(m * 28.0134 / (m + 28.0134) * 305) * k), 6) AS drift FROM p""")
def cross_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    k, z, m = F.lit(0.5) + F.col("p_size") / 100, F.col("p_size") % 2 + 1, F.col("p_retailprice")
    return part.select(F.col("p_partkey").alias("spot_id"), F.round(summaries.cross_section(k, z, m, True), 6).alias("trapped"), F.round(summaries.cross_section(k, z, m, False), 6).alias("drift"))


@query(with_views("sample", "spot_peak") + """, v AS (SELECT spot_id, class, height FROM spot_peak JOIN sample USING (file_id) WHERE sample_type = 'Sample'),
    g AS (SELECT spot_id, avg(height) AS grand, count(*) AS n, count(DISTINCT class) AS k FROM v GROUP BY spot_id), c AS (SELECT spot_id, class, avg(height) AS m FROM v GROUP BY spot_id, class),
    q AS (SELECT spot_id, sum(pow(m - grand, 2)) AS b, sum(pow(height - m, 2)) AS w FROM v JOIN c USING (spot_id, class) JOIN g USING (spot_id) GROUP BY spot_id),
    x AS (SELECT spot_id, max(m) / min(m) AS fold FROM c GROUP BY spot_id)
    SELECT spot_id, round(fold, 6) AS fold, round((b / (k - 1)) / (w / (n - k)), 5) AS f FROM q JOIN g USING (spot_id) JOIN x USING (spot_id) WHERE k > 1 AND n > k AND w > 0""")
def sample_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest class mean over the smallest, and F over the classes, of the sample runs only."""
    met = _values(spark, sf_dir).join(views.sample(spark, sf_dir).where("sample_type = 'Sample'").select("file_id", "class"), "file_id")
    means = met.groupBy("spot_id", "class").agg(F.avg("height").alias("m")).groupBy("spot_id").agg((F.max("m") / F.min("m")).alias("fold"))
    return rounded(rounded(statistics.anova(met).join(means, "spot_id").select("spot_id", "fold", "f"), 6, "fold"), 5, "f")


@query(None)  # SQL has no t distribution
def correlation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided p of each spot's correlation with the injection order."""
    found = statistics.correlated(_values(spark, sf_dir), views.sample(spark, sf_dir)).select("spot_id", "n", "pearson")
    t = F.col("pearson") * F.sqrt((F.col("n") - 2) / (1 - F.col("pearson") * F.col("pearson")))
    return found.where("abs(pearson) < 1").withColumn("p", distributions.student_p(t, (F.col("n") - 2).cast("double")))


@query(None)  # SQL has no normal distribution
def mann_whitney_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided p of U between the two batches, exact where groups are small and without ties."""
    met = _values(spark, sf_dir).join(views.sample(spark, sf_dir).select("file_id", F.col("batch").alias("grp")), "file_id")
    return statistics.mann_whitney_tested(met)


def _pairs_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sample(spark, sf_dir).where("batch = 2").select(F.col("file_id").alias("one"), (F.col("file_id") + 1).alias("two"))


@query(with_views("sample", "spot_peak") + """, p AS (SELECT a.file_id AS one, a.file_id + 1 AS two FROM sample a WHERE a.batch = 2),
    d AS (SELECT x.spot_id, x.height - y.height AS d FROM spot_peak x JOIN p ON x.file_id = one JOIN spot_peak y ON y.file_id = two AND y.spot_id = x.spot_id WHERE x.height <> y.height),
    r AS (SELECT spot_id, d, rank() OVER (PARTITION BY spot_id ORDER BY abs(d)) + (count(*) OVER (PARTITION BY spot_id, abs(d)) - 1) / 2 AS mid, count(*) OVER (PARTITION BY spot_id, abs(d)) AS ties FROM d),
    s AS (SELECT spot_id, count(*) AS n, coalesce(sum(mid) FILTER (d > 0), 0) AS w, sum(ties * ties - 1) AS tie FROM r GROUP BY spot_id)
    SELECT spot_id, n, w, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48), 6) AS z FROM s WHERE n * (n + 1) * (2 * n + 1) / 24 - tie / 48 > 0""")
def signed_rank_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run of the second batch against the run after it, by ranks."""
    return rounded(statistics.signed_rank(summaries.differences(_values(spark, sf_dir), _pairs_of_runs(spark, sf_dir))), 6, "z").drop("tie")


@query(None)  # counts of orders; tested by enumeration
def signed_rank_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.signed_rank_tested(summaries.differences(_values(spark, sf_dir), _pairs_of_runs(spark, sf_dir)))

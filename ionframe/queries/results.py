"""Normalisation, drift, abundance, class shifts and further tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.functions import distributions
from ionframe.operators import quantities, scans
from ionframe.plans import views
from ionframe.plans.views import with_views
from ionframe.queries.names import NAMES, _named
from ionframe.registry import query, rounded


#: Every spot and file: zero where there is no peak.
DENSE_SQL = """, spots AS (SELECT DISTINCT spot_id FROM spot_peak),
    dense AS (SELECT spot_id, file_id, class, sample_type, coalesce(height, 0) AS h FROM spots CROSS JOIN sample LEFT JOIN spot_peak USING (spot_id, file_id))"""


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.spot_peak(spark, sf_dir).select("spot_id", "file_id", "height")


@query(with_views("sample", "spot_peak") + """SELECT spot_id, arg_max(file_id, height * 1e6 - file_id) AS representative, round(avg(height), 6) AS mean, min(height) AS low, max(height) AS high,
    round(count(*) / (SELECT count(*) FROM sample), 6) AS fill FROM spot_peak GROUP BY spot_id""")
def representative_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quantities.representative(_values(spark, sf_dir), views.sample(spark, sf_dir)), 6, "mean", "fill")


@query(with_views("sample", "spot_peak") + """, m AS (SELECT spot_id, min(height) AS least FROM spot_peak WHERE height > 0 GROUP BY spot_id)
    SELECT spot_id, file_id, round(coalesce(height, least * 0.1), 6) AS value FROM m CROSS JOIN sample LEFT JOIN spot_peak USING (spot_id, file_id)""")
def missing_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quantities.filled(_values(spark, sf_dir), views.sample(spark, sf_dir)), 6, "value")


STANDARD = with_views("feature", "spot_peak") + """, mean AS (SELECT spot_id, ontology, avg(height) AS m FROM spot_peak JOIN feature USING (spot_id) GROUP BY spot_id, ontology),
    std AS (SELECT ontology, spot_id AS standard_id FROM (SELECT *, row_number() OVER (PARTITION BY ontology ORDER BY m DESC, spot_id) AS k FROM mean) WHERE k = 1),
    met AS (SELECT a.spot_id, a.file_id, a.height, b.height AS base, standard_id FROM spot_peak a JOIN feature f ON f.spot_id = a.spot_id JOIN std USING (ontology)
        LEFT JOIN spot_peak b ON b.spot_id = standard_id AND b.file_id = a.file_id)"""


@query(STANDARD + "SELECT spot_id, file_id, round(2.5 * height / coalesce(base, 1), 6) AS value FROM met")
def standard_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, features = _values(spark, sf_dir), views.feature(spark, sf_dir)
    return rounded(quantities.standard_normalised(values, features, quantities.class_standards(values, features), 2.5), 6, "value")


@query(STANDARD + "SELECT spot_id, file_id, round(height / base, 8) AS value FROM met WHERE spot_id <> standard_id AND base > 0")
def relative_abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, features = _values(spark, sf_dir), views.feature(spark, sf_dir)
    return rounded(quantities.relative_abundance(values, features, quantities.class_standards(values, features)), 8, "value")


@query(with_views("feature", "spot_peak") + """, t AS (SELECT file_id, sum(height) AS total FROM spot_peak JOIN feature USING (spot_id) WHERE ontology LIKE 'Brand#1%' GROUP BY file_id)
    SELECT spot_id, file_id, round(height / total, 9) AS value FROM spot_peak JOIN t USING (file_id)""")
def named_total_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = views.feature(spark, sf_dir).where(F.col("ontology").startswith("Brand#1"))
    return rounded(quantities.named_total_normalised(_values(spark, sf_dir), named), 9, "value")


@query(with_views("sample", "spot_peak") + """, v AS (SELECT spot_id, file_id, height, batch, CAST(injection_order AS DOUBLE) AS x, sample_type = 'QC' AS qc FROM spot_peak JOIN sample USING (file_id)),
    q AS (SELECT spot_id, batch, x, height AS y, count(*) OVER (PARTITION BY spot_id, batch) AS nb, count(*) OVER (PARTITION BY spot_id) AS n, avg(height) OVER (PARTITION BY spot_id) AS mean,
        avg(height) OVER (PARTITION BY spot_id, batch) AS level FROM v WHERE qc),
    d AS (SELECT v.spot_id, v.file_id, v.x AS at_x, q.x, q.y, nb, n, mean, level, abs(q.x - v.x) AS d, row_number() OVER (PARTITION BY v.spot_id, v.file_id ORDER BY abs(q.x - v.x), q.x) AS k
        FROM v JOIN q ON q.spot_id = v.spot_id AND q.batch = v.batch),
    t AS (SELECT *, max(d) OVER (PARTITION BY spot_id, file_id) AS far FROM d WHERE k <= least(nb, greatest(3, ceil(0.75 * nb)))),
    w AS (SELECT *, CASE WHEN far > 0 THEN pow(1 - pow(d / far, 3), 3) ELSE 1 END AS w FROM t),
    s AS (SELECT spot_id, file_id, any_value(at_x) AS a, any_value(nb) AS nb, any_value(n) AS n, any_value(mean) AS mean, any_value(level) AS level, max(far) AS far, avg(y) AS plain,
        sum(w) AS w, sum(w * x) AS wx, sum(w * y) AS wy, sum(w * x * x) AS wxx, sum(w * x * y) AS wxy FROM w GROUP BY spot_id, file_id),
    f AS (SELECT spot_id, file_id, mean, CASE WHEN nb < 3 THEN level WHEN far <= 0 THEN plain WHEN abs(w * wxx - wx * wx) < 1e-12 THEN wy / w
        ELSE (wy - (w * wxy - wx * wy) / (w * wxx - wx * wx) * wx) / w + (w * wxy - wx * wy) / (w * wxx - wx * wx) * a END AS fit FROM s WHERE n >= 3)
    SELECT v.spot_id, v.file_id, v.height AS value, round(CASE WHEN fit > 0 THEN mean / fit ELSE 1 END, 6) AS factor FROM v LEFT JOIN f USING (spot_id, file_id)""")
def drift_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each height is multiplied with."""
    out = quantities.drift_corrected(_values(spark, sf_dir), views.sample(spark, sf_dir))
    return out.select("spot_id", "file_id", "value", F.round(F.col("corrected") / F.col("value"), 6).alias("factor"))


FOLDS = with_views("sample", "spot_peak") + """, m AS (SELECT spot_id, avg(CASE WHEN batch = 1 THEN height END) AS a, avg(CASE WHEN batch = 2 THEN height END) AS b
    FROM spot_peak JOIN sample USING (file_id) GROUP BY spot_id), folds AS (SELECT spot_id, log2(a / b) AS log2_fold FROM m WHERE a > 0 AND b > 0)"""


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantities.fold_changes(_values(spark, sf_dir), views.sample(spark, sf_dir).select("file_id", F.col("batch").alias("grp")))


@query(FOLDS + """SELECT p_brand AS class, count(*) AS members, round(avg(log2_fold), 8) AS mean, count(*) FILTER (log2_fold > 0) AS up, count(*) FILTER (log2_fold < 0) AS down,
    round(avg(log2_fold) / (stddev_samp(log2_fold) / sqrt(count(*))), 5) AS t FROM folds JOIN part ON p_partkey = spot_id GROUP BY p_brand""")
def class_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = views.feature(spark, sf_dir).select("spot_id", F.col("ontology").alias("class"))
    return rounded(rounded(quantities.class_changes(_folds(spark, sf_dir), classes), 8, "mean"), 5, "t")


@query(FOLDS + ", " + NAMES[5:] + """SELECT CAST(c AS BIGINT) AS carbons, CAST(d AS BIGINT) AS double_bonds, count(*) AS members, round(avg(log2_fold), 8) AS mean FROM folds JOIN named USING (spot_id) GROUP BY c, d""")
def chain_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ionframe.functions import chemistry

    chains = _named(spark, sf_dir).select("spot_id", chemistry.lipid_sum(F.col("name")).alias("s")).where("s.carbons > 0")
    made = _folds(spark, sf_dir).join(chains, "spot_id").groupBy("s.carbons", "s.double_bonds").agg(F.count("*").alias("members"), F.avg("log2_fold").alias("mean"))
    return rounded(made, 8, "mean")


@query(with_views("feature") + """, s AS (SELECT ontology, count(*) AS n_set, count(*) FILTER (mz >= 950) AS n_hit FROM feature GROUP BY ontology), t AS (SELECT sum(n_set) AS a, sum(n_hit) AS h FROM s)
    SELECT ontology, n_set, n_hit, round(h * n_set / a, 8) AS expected, round(CASE WHEN h > 0 THEN n_hit / (h * n_set / a) ELSE 0 END, 8) AS ratio FROM s, t WHERE n_set >= 3""")
def enrichment_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.feature(spark, sf_dir)
    return rounded(quantities.enriched(f.where("mz >= 950"), f), 8, "expected", "ratio").drop("n_all", "n_hits")


@query(None)  # SQL has no hypergeometric tail
def enrichment_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.feature(spark, sf_dir)
    told = quantities.enriched(f.where("mz >= 950"), f)
    return told.withColumn("p", distributions.enrichment_p(F.col("n_hit"), F.col("n_hits"), F.col("n_set"), F.col("n_all")))


@query(with_views("feature") + """SELECT ontology, count(*) AS confirmed, row_number() OVER (ORDER BY count(*) DESC, lower(ontology)) AS place FROM feature GROUP BY ontology""")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    counts = views.feature(spark, sf_dir).groupBy("ontology").agg(F.count("*").alias("confirmed"))
    # one row a class
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("confirmed"), F.lower("ontology"))).cast("long"))


@query(with_views("fragment") + """SELECT spectrum_id, mz, row_number() OVER w - 1 AS "order", round(CASE WHEN count(*) OVER (PARTITION BY spectrum_id) > 1
    THEN (row_number() OVER w - 1) / (count(*) OVER (PARTITION BY spectrum_id) - 1) ELSE 0 END, 6) AS score FROM fragment WINDOW w AS (PARTITION BY spectrum_id ORDER BY intensity, mz)""")
def amplitude_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quantities.amplitude_order(views.fragment(spark, sf_dir)), 6, "score")


@query(with_views("sample", "spot_peak") + """, v AS (SELECT spot_id, height AS y, CAST(injection_order AS DOUBLE) AS x FROM spot_peak JOIN sample USING (file_id)),
    p AS (SELECT a.spot_id, count(*) AS n, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, sum(abs(sign(a.x - b.x))) AS sx, sum(abs(sign(a.y - b.y))) AS sy FROM v a JOIN v b USING (spot_id) GROUP BY a.spot_id)
    SELECT spot_id, round(s / sqrt(CAST(sx AS DOUBLE) * sy), 8) AS tau FROM p WHERE n > 4 AND sx > 0 AND sy > 0""")
def kendall_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = views.sample(spark, sf_dir).select("file_id", F.col("injection_order").cast("double").alias("x"))
    return rounded(quantities.kendall(_values(spark, sf_dir), profile), 8, "tau")


@query(with_views("sample", "spot_peak") + """, s AS (SELECT spot_id, count(*) FILTER (batch = 1) AS n1, avg(height) FILTER (batch = 1) AS m1, var_samp(height) FILTER (batch = 1) AS v1,
    count(*) FILTER (batch = 2) AS n2, avg(height) FILTER (batch = 2) AS m2, var_samp(height) FILTER (batch = 2) AS v2 FROM spot_peak JOIN sample USING (file_id) GROUP BY spot_id)
    SELECT spot_id, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 6) AS t, n1 + n2 - 2 AS df FROM s WHERE n1 > 1 AND n2 > 1""")
def student_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = _values(spark, sf_dir).join(views.sample(spark, sf_dir).select("file_id", F.col("batch").alias("grp")), "file_id")
    return rounded(quantities.student(met), 6, "t")


@query(None)  # least squares of nested models; tested against numpy
def two_way_anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    factors = views.sample(spark, sf_dir).select("file_id", (F.col("batch") - 1).alias("one"), (F.col("class") >= 2).cast("int").alias("two"))
    return rounded(quantities.two_way(_values(spark, sf_dir).join(factors, "file_id"), "one", "two"), 5, "f_one", "f_two")


GRID = with_views("scan") + """, b AS (SELECT min(rt) AS r0, max(rt) AS r1, min(mz) AS m0, max(mz) AS m1 FROM scan),
    g AS (SELECT CAST(least(29, floor((rt - r0) / (r1 - r0) * 30)) AS BIGINT) AS row, CAST(least(19, floor((mz - m0) / (m1 - m0) * 20)) AS BIGINT) AS bin, sum(intensity) AS intensity FROM scan, b GROUP BY 1, 2)"""


@query(GRID + """SELECT 'row' AS side, row AS place, round(sum(intensity), 4) AS total FROM g GROUP BY row UNION ALL SELECT 'column', bin, round(sum(intensity), 4) FROM g GROUP BY bin""")
def contour_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, columns = quantities.contour_slices(scans.contour_grid(views.scan(spark, sf_dir), 30, 20))
    named = lambda d, n: d.select(F.lit(n).alias("side"), "place", F.round("total", 4).alias("total"))
    return named(rows, "row").unionByName(named(columns, "column"))


@query(GRID + """, k AS (SELECT intensity, row_number() OVER (ORDER BY intensity) AS k, count(*) OVER () AS n FROM g WHERE intensity > 0)
    SELECT round(intensity, 6) AS level FROM k WHERE k = greatest(1, ceil(n * 0.95))""")
def contour_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quantities.grid_percentile(scans.contour_grid(views.scan(spark, sf_dir), 30, 20), 95.0), 6, "level")

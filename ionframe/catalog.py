"""All queries on the adapter views, with the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.functions import chemistry, distributions
from ionframe.operators import matching, matrix, network, scans, signal, statistics
from ionframe.plans import views
from ionframe.plans.views import with_views
from ionframe.registry import ORACLE_SQL, QUERIES  # noqa: F401
from ionframe.registry import query as _query
from ionframe.registry import rounded as _rounded
from ionframe.sources import records

# --- scans and chromatograms


NOISE_SQL = """, d AS (SELECT file_id, y, abs(y - lag(y) OVER (PARTITION BY file_id ORDER BY rt)) AS d, row_number() OVER (PARTITION BY file_id ORDER BY y) AS k,
        count(*) OVER (PARTITION BY file_id) AS n FROM x),
    m AS (SELECT file_id, median(d) AS m FROM d WHERE n >= 3 GROUP BY file_id),
    noise AS (SELECT d.file_id, CASE WHEN any_value(m) > 0 AND median(abs(d - m)) > 0 THEN median(abs(d - m)) * 1.4826 / sqrt(2)
        ELSE nullif(stddev_samp(CASE WHEN k <= greatest(2, n // 2) THEN y END), 0) END AS noise FROM d JOIN m USING (file_id) GROUP BY d.file_id)"""


@_query(with_views("scan") + """, x AS (SELECT file_id, rt, sum(CASE WHEN mz BETWEEN 35 AND 45 THEN intensity ELSE 0 END) AS y FROM scan WHERE ms_level = 1 GROUP BY file_id, rt)""" + NOISE_SQL + """,
    a AS (SELECT *, row_number() OVER w AS pos, lead(rt) OVER w AS r2, lead(y) OVER w AS y2, lag(rt) OVER w AS r0, lag(y) OVER w AS y0, max(y) OVER (PARTITION BY file_id) AS top
        FROM x WINDOW w AS (PARTITION BY file_id ORDER BY rt)),
    t AS (SELECT file_id, min(pos) AS apex FROM a WHERE y = top AND top > 0 GROUP BY file_id),
    s AS (SELECT a.*, apex, CASE WHEN pos < apex THEN -1 WHEN pos > apex THEN 1 ELSE 0 END AS side, abs(pos - apex) AS away FROM a JOIN t USING (file_id)),
    v AS (SELECT *, coalesce(min(y) OVER (PARTITION BY file_id, side ORDER BY away ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), top) AS valley FROM s),
    e AS (SELECT *, CASE WHEN side = 0 THEN NULL WHEN y <= 0.05 * top THEN pos WHEN y > valley + 0.1 * top THEN pos - side END AS edge FROM v),
    b AS (SELECT file_id, coalesce(arg_min(edge, away) FILTER (side = -1 AND edge IS NOT NULL), min(pos)) AS l,
        coalesce(arg_min(edge, away) FILTER (side = 1 AND edge IS NOT NULL), max(pos)) AS r FROM e GROUP BY file_id),
    c AS (SELECT file_id, any_value(l) AS l, any_value(r) AS r, max(CASE WHEN pos = apex THEN rt END) AS apex_rt, any_value(top) AS top,
        max(CASE WHEN pos = l THEN rt END) AS rt_left, max(CASE WHEN pos = r THEN rt END) AS rt_right,
        coalesce(sum(CASE WHEN pos >= l AND pos < r THEN (r2 - rt) * (y + y2) / 2 END), 0) AS area,
        arg_max(rt + (top / 2 - y) / (y2 - y) * (r2 - rt), pos) FILTER (pos >= l AND pos < apex AND y <= top / 2) AS half_left,
        arg_min(r0 + (top / 2 - y0) / (y - y0) * (rt - r0), pos) FILTER (pos > apex AND pos <= r AND y <= top / 2) AS half_right
        FROM s JOIN b USING (file_id) GROUP BY file_id)
    SELECT file_id, CAST(r - l + 1 AS BIGINT) AS n_points, round(apex_rt, 6) AS apex_rt, round(top, 6) AS apex_intensity, round(rt_left, 6) AS rt_left, round(rt_right, 6) AS rt_right,
        round(area, 4) AS area, round(half_right - half_left, 6) AS fwhm, round(noise, 6) AS noise, round(top / noise, 5) AS snr FROM c LEFT JOIN noise USING (file_id)""")
def xic_peak_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signal.peak_summary(scans.xic(views.scan(spark, sf_dir), 40.0, 5.0))
    return _rounded(_rounded(_rounded(out, 6, "apex_rt", "apex_intensity", "rt_left", "rt_right", "fwhm", "noise"), 4, "area"), 5, "snr")


@_query(with_views("scan") + """, t AS (SELECT p_size AS target_id, CAST(p_size * 2 AS DOUBLE) AS target_mz FROM part GROUP BY p_size)
    , p AS (SELECT target_id, file_id, rt, sum(intensity) AS y FROM scan JOIN t ON abs(mz - target_mz) <= 1.5 WHERE ms_level = 1 GROUP BY ALL),
    n AS (SELECT file_id, count(DISTINCT rt) AS n_points FROM scan WHERE ms_level = 1 GROUP BY file_id)
    SELECT CAST(target_id AS BIGINT) AS target_id, file_id, any_value(n_points) AS n_points, count(*) FILTER (y > 0) AS n_hits, round(sum(y), 4) AS total, round(max(y), 6) AS top
    FROM p JOIN n USING (file_id) GROUP BY target_id, file_id""")
def xic_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").cast("long").alias("target_id"), (F.col("p_size") * 2).cast("double").alias("target_mz")).distinct()
    return _rounded(_rounded(scans.batch_xic(views.scan(spark, sf_dir), targets, 1.5), 4, "total"), 6, "top")


@_query(with_views("scan") + """SELECT scan_id, file_id, round(rt, 6) AS rt, mz, round(intensity, 6) AS intensity FROM scan
    WHERE ms_level > 1 AND mz > 0 AND abs(mz - 40) <= 2""")
def scan_source_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scans.gated(views.scan(spark, sf_dir), 40.0, 2.0), 6, "rt", "intensity").select("scan_id", "file_id", "rt", "mz", "intensity")


@_query(with_views("scan") + """SELECT CAST(round_even(mz * 10000, 0) AS BIGINT) AS key, count(*) AS n FROM scan WHERE ms_level > 1 AND mz > 0 GROUP BY 1""")
def distinct_precursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.distinct_precursors(views.scan(spark, sf_dir))


@_query(with_views("scan") + """SELECT ms_level, count(*) AS n, count(DISTINCT file_id) AS n_files FROM scan WHERE rt BETWEEN 1000 AND 20000 GROUP BY ms_level""")
def scan_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.level_counts(views.scan(spark, sf_dir), 1000.0, 20000.0)


@_query(with_views("scan") + """SELECT file_id, round(min(rt), 6) AS min_rt, round(max(rt), 6) AS max_rt, min(mz) AS min_mz, max(mz) AS max_mz,
    round(min(intensity), 6) AS min_intensity, round(max(intensity), 6) AS max_intensity FROM scan GROUP BY file_id""")
def scan_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scans.ranges(views.scan(spark, sf_dir)), 6, "min_rt", "max_rt", "min_intensity", "max_intensity")


@_query(with_views("scan") + """, r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY intensity DESC, scan_id) AS k FROM scan WHERE ms_level = 1)
    SELECT scan_id, file_id, round(rt, 6) AS rt, mz, round(intensity, 6) AS intensity FROM r WHERE k = 1""")
def base_peak_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scans.base_peak_scans(views.scan(spark, sf_dir)), 6, "rt", "intensity").select("scan_id", "file_id", "rt", "mz", "intensity")


@_query(with_views("scan") + """, r AS (SELECT *, CAST(floor(mz / 10) AS BIGINT) AS bin FROM scan),
    k AS (SELECT *, row_number() OVER (PARTITION BY file_id, bin ORDER BY intensity DESC, mz DESC) AS k FROM r)
    SELECT file_id, bin, round(sum(intensity), 4) AS intensity, max(CASE WHEN k = 1 THEN mz END) AS base_mz FROM k GROUP BY file_id, bin""")
def mass_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scans.mass_bins(views.scan(spark, sf_dir), 10.0), 4, "intensity")


@_query(with_views("scan") + """, r AS (SELECT *, last_value(CASE WHEN ms_level = 1 THEN scan_id END IGNORE NULLS) OVER
    (PARTITION BY file_id ORDER BY rt, scan_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS survey_id FROM scan)
    SELECT scan_id, file_id, survey_id FROM r WHERE ms_level > 1""")
def nearest_survey_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.nearest_survey(views.scan(spark, sf_dir)).select("scan_id", "file_id", "survey_id")


@_query(with_views("scan") + """, b AS (SELECT min(rt) AS r0, max(rt) AS r1, min(mz) AS m0, max(mz) AS m1 FROM scan)
    SELECT CAST(least(29, floor((rt - r0) / (r1 - r0) * 30)) AS BIGINT) AS row, CAST(least(19, floor((mz - m0) / (m1 - m0) * 20)) AS BIGINT) AS bin,
        round(sum(intensity), 4) AS intensity FROM scan, b GROUP BY 1, 2""")
def contour_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scans.contour_grid(views.scan(spark, sf_dir), 30, 20), 4, "intensity")


@_query(with_views("scan") + """, x AS (SELECT file_id, rt, sum(CASE WHEN mz BETWEEN 35 AND 45 THEN intensity ELSE 0 END) AS y FROM scan WHERE ms_level = 1 GROUP BY file_id, rt)""" + NOISE_SQL + """
    SELECT file_id, round(noise, 6) AS noise FROM noise""")
def noise_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(signal.automatic_noise(scans.xic(views.scan(spark, sf_dir), 40.0, 5.0)), 6, "noise")


AVERAGE_SQL = """SELECT file_id, sum(mz * intensity) / sum(intensity) AS mz, sum(intensity) / any_value(n) AS intensity FROM (
    SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY mz, scan_id) AS grp FROM (
        SELECT *, CASE WHEN mz - lag(mz) OVER (PARTITION BY file_id ORDER BY mz, scan_id) <= 0.01 THEN 0 ELSE 1 END AS new FROM scan WHERE {where}))
    JOIN (SELECT file_id, count(DISTINCT rt) AS n FROM scan WHERE {where} GROUP BY file_id) USING (file_id) GROUP BY file_id, grp"""


@_query(with_views("scan") + f""", a AS ({AVERAGE_SQL.format(where="ms_level = 1 AND rt BETWEEN 0 AND 20000")})
    SELECT file_id, round(mz, 6) AS mz, round(intensity, 6) AS intensity FROM a""")
def average_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scans.average_spectrum(views.scan(spark, sf_dir), 0.0, 20000.0), 6, "mz", "intensity")


@_query(with_views("scan") + f""", a AS ({AVERAGE_SQL.format(where="ms_level = 1 AND rt BETWEEN 0 AND 20000")}),
    b AS ({AVERAGE_SQL.format(where="ms_level = 1 AND rt BETWEEN 20000 AND 30000")})
    SELECT a.file_id, round(a.mz, 6) AS mz, round(greatest(0, any_value(a.intensity) - coalesce(sum(b.intensity), 0)), 6) AS intensity
    FROM a LEFT JOIN b ON a.file_id = b.file_id AND b.mz BETWEEN a.mz - 0.01 AND a.mz + 0.01 GROUP BY a.file_id, a.mz""")
def background_subtracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scan(spark, sf_dir)
    out = scans.subtracted(scans.average_spectrum(s, 0.0, 20000.0), scans.average_spectrum(s, 20000.0, 30000.0))
    return _rounded(out, 6, "mz", "intensity")


# --- predicates over features


@_query(with_views("feature") + """SELECT spot_id, mz, rt, ontology FROM feature WHERE mz BETWEEN 905 AND 930 AND rt BETWEEN 5 AND 40 AND ontology LIKE 'Brand#1%'""")
def spot_value_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.feature(spark, sf_dir)
    return f.where(F.col("mz").between(905, 930) & F.col("rt").between(5, 40) & F.col("ontology").startswith("Brand#1")).select("spot_id", "mz", "rt", "ontology")


@_query(with_views("feature") + """SELECT spot_id, name, adduct FROM feature WHERE contains(lower(name), 'o') AND contains(lower(name), 't') AND NOT contains(lower(adduct), 'eco')""")
def spot_keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, name = views.feature(spark, sf_dir), F.lower("name")
    return f.where(F.contains(name, F.lit("o")) & F.contains(name, F.lit("t")) & ~F.contains(F.lower("adduct"), F.lit("eco"))).select("spot_id", "name", "adduct")


@_query(with_views("scan") + """SELECT file_id, count(*) AS n_hits, round(max(intensity), 6) AS top FROM scan
    WHERE (ms_level = 2 AND abs(mz - 50) <= 3 AND intensity >= 10) OR (ms_level = 1 AND abs(mz - 20) <= 1 AND rt >= 500 AND intensity >= 50) GROUP BY file_id""")
def fragment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scan(spark, sf_dir)
    product = (F.col("ms_level") == 2) & (F.abs(F.col("mz") - 50) <= 3) & (F.col("intensity") >= 10)
    survey = (F.col("ms_level") == 1) & (F.abs(F.col("mz") - 20) <= 1) & (F.col("rt") >= 500) & (F.col("intensity") >= 50)
    return _rounded(s.where(product | survey).groupBy("file_id").agg(F.count("*").alias("n_hits"), F.max("intensity").alias("top")), 6, "top")


# --- spot filters


@_query(with_views("spot_peak") + """SELECT spot_id, count(*) AS n_detected, max(height) AS top FROM spot_peak GROUP BY spot_id HAVING count(*) >= 20""")
def spot_filter_peak_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.detected_in(views.spot_peak(spark, sf_dir), 20)


@_query(with_views("sample", "spot_peak") + """, q AS (SELECT file_id FROM sample WHERE sample_type = 'QC')
    SELECT spot_id, count(*) AS n_qc, count(*) = (SELECT count(*) FROM q) AS in_all FROM spot_peak JOIN q USING (file_id) GROUP BY spot_id""")
def spot_filter_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spot's QC runs, and whether the filter keeps it (all have it)."""
    return matrix.qc_counts(views.spot_peak(spark, sf_dir), views.sample(spark, sf_dir))


@_query(with_views("sample", "spot_peak") + """, c AS (SELECT class, count(*) AS n_class FROM sample GROUP BY class),
    d AS (SELECT spot_id, class, count(*) AS n FROM spot_peak JOIN sample USING (file_id) GROUP BY spot_id, class)
    SELECT spot_id, round(max(n * 100.0 / n_class), 6) AS best_percent FROM d JOIN c USING (class) GROUP BY spot_id HAVING max(n * 100.0 / n_class) >= 50""")
def spot_filter_group_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matrix.group_percent(views.spot_peak(spark, sf_dir), views.sample(spark, sf_dir), 50.0), 6, "best_percent")


@_query(with_views("sample", "spot_peak") + """, n AS (SELECT count(*) FILTER (sample_type = 'Blank') AS nb, count(*) FILTER (sample_type = 'Sample') AS ns, count(*) AS nf FROM sample),
    m AS (SELECT spot_id, sum(CASE WHEN sample_type = 'Sample' THEN height ELSE 0 END) AS s, sum(CASE WHEN sample_type = 'Blank' THEN height ELSE 0 END) AS b,
        min(CASE WHEN height < 0.0001 THEN height END) AS tiny, count(*) AS k FROM spot_peak JOIN sample USING (file_id) GROUP BY spot_id),
    t AS (SELECT spot_id, s / ns AS sample_mean, CASE WHEN b > 0 THEN b / nb WHEN k < nf THEN 0 ELSE coalesce(tiny * 0.1, 1) END AS blank_level FROM m, n WHERE nb > 0)
    SELECT spot_id, round(sample_mean, 6) AS sample_mean, round(blank_level, 6) AS blank_level FROM t WHERE sample_mean >= 1.2 * blank_level""")
def spot_filter_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matrix.blank_filter(views.spot_peak(spark, sf_dir), views.sample(spark, sf_dir), 1.2), 6, "sample_mean", "blank_level")


DENSE_SQL = """, spots AS (SELECT DISTINCT spot_id FROM spot_peak),
    dense AS (SELECT spot_id, file_id, class, sample_type, coalesce(height, 0) AS h FROM spots CROSS JOIN sample LEFT JOIN spot_peak USING (spot_id, file_id))"""


@_query(with_views("sample", "spot_peak") + DENSE_SQL + """, c AS (SELECT spot_id, class, stddev_samp(h) * 100 / avg(h) AS r FROM dense WHERE sample_type <> 'Blank'
    GROUP BY spot_id, class HAVING count(*) > 1 AND sum(h) > 0) SELECT spot_id, round(min(r), 5) AS rsd FROM c GROUP BY spot_id""")
def spot_smallest_rsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matrix.relative_deviation(views.spot_peak(spark, sf_dir), views.sample(spark, sf_dir)), 5, "rsd")


@_query(with_views("sample", "spot_peak") + """SELECT spot_id, count(*) AS n_qc, round(stddev_samp(height) / avg(height) * 100, 6) AS cv_percent
    FROM spot_peak JOIN sample USING (file_id) WHERE sample_type = 'QC' GROUP BY spot_id HAVING count(*) > 1""")
def qc_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matrix.qc_variation(views.spot_peak(spark, sf_dir), views.sample(spark, sf_dir)), 6, "cv_percent")


# --- joins and matching


_MATCH = with_views("peak", "library") + """, j AS (SELECT peak_id, ref_id, (exp(-0.5 * pow((mz - ref_mz) / 0.05, 2)) + exp(-0.5 * pow((rt - ref_rt) / 30, 2))) / 2 AS score
    FROM peak JOIN library ON mz BETWEEN ref_mz - 0.1 AND ref_mz + 0.1 WHERE abs(mz - ref_mz) <= 0.05 AND abs(rt - ref_rt) <= 30)"""


@_query(_MATCH + """, r AS (SELECT *, row_number() OVER (PARTITION BY peak_id ORDER BY round(score, 9) DESC, ref_id) AS rank FROM j)
    SELECT peak_id, ref_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM r WHERE rank <= 3""")
def library_top_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.library_matches(views.peak(spark, sf_dir), views.library(spark, sf_dir), 0.05, 30.0)
    return matching.best_matches(found).select("peak_id", "ref_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@_query(with_views("peak", "library") + """SELECT peak_id, count(*) AS n_refs, round(max(exp(-0.5 * pow((mz - ref_mz) / 0.02, 2))), 6) AS best
    FROM peak JOIN library ON mz BETWEEN ref_mz - 0.1 AND ref_mz + 0.1 WHERE abs(mz - ref_mz) <= 0.02 GROUP BY peak_id""")
def library_mass_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.library_matches(views.peak(spark, sf_dir), views.library(spark, sf_dir), 0.02)
    return _rounded(found.groupBy("peak_id").agg(F.count("*").alias("n_refs"), F.max("score").alias("best")), 6, "best")


@_query(with_views("peak", "library") + """SELECT peak_id, file_id FROM peak WHERE NOT EXISTS (SELECT 1 FROM library WHERE ref_mz BETWEEN mz - 0.1 AND mz + 0.1 AND abs(mz - ref_mz) <= 0.05)""")
def library_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.unmatched(views.peak(spark, sf_dir), views.library(spark, sf_dir), 0.05).select("peak_id", "file_id")


@_query(with_views("feature") + """, k AS (SELECT *, row_number() OVER (PARTITION BY round(mz, 0), floor(rt / 5) ORDER BY name, spot_id) AS k FROM feature)
    SELECT spot_id, name, mz, rt FROM k WHERE k = 1""")
def spots_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.deduplicated(views.feature(spark, sf_dir), 0, 5.0).select("spot_id", "name", "mz", "rt")


_POLARITY = """, p AS (SELECT spot_id AS key, max(height) AS h FROM spot_peak JOIN sample USING (file_id) WHERE batch = 1 GROUP BY spot_id),
    n AS (SELECT spot_id AS key, max(height) AS h FROM spot_peak JOIN sample USING (file_id) WHERE batch = 2 GROUP BY spot_id)
    SELECT coalesce(p.key, n.key) AS key, p.h AS positive, n.h AS negative,
        CASE WHEN n.h IS NULL OR p.h >= n.h THEN 'positive' ELSE 'negative' END AS quantify FROM p FULL OUTER JOIN n ON p.key = n.key"""


@_query(with_views("sample", "spot_peak") + _POLARITY)
def polarity_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = views.spot_peak(spark, sf_dir).join(views.sample(spark, sf_dir).select("file_id", "batch"), "file_id")
    side = lambda b: met.where(F.col("batch") == b).groupBy(F.col("spot_id").alias("key")).agg(F.max("height").alias("height"))
    return matching.polarity_merge(side(1), side(2))


# --- matrix


@_query(with_views("sample", "spot_peak") + DENSE_SQL + """SELECT spot_id, class, count(*) FILTER (h > 0) AS n, round(avg(h), 6) AS average, round(coalesce(stddev_samp(h), 0), 4) AS stdev
    FROM dense GROUP BY spot_id, class""")
def class_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_rounded(matrix.class_statistics(views.spot_peak(spark, sf_dir), views.sample(spark, sf_dir)), 6, "average"), 4, "stdev")


@_query(with_views("sample", "spot_peak") + """SELECT spot_id AS id, file_name AS file, class, height, round(area, 4) AS area FROM spot_peak JOIN sample USING (file_id)""")
def long_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matrix.long_export(views.spot_peak(spark, sf_dir), views.sample(spark, sf_dir)), 4, "area")


@_query(with_views("sample", "spot_peak") + DENSE_SQL + "SELECT spot_id, " + ", ".join(f"round(avg(CASE WHEN class = {c} THEN h END), 6) AS class_{c}" for c in range(5)) + " FROM dense GROUP BY spot_id")
def wide_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matrix.wide_export(views.spot_peak(spark, sf_dir), views.sample(spark, sf_dir))
    # the five regions of the test tables; a class without runs has no column of its own
    missing = [F.lit(None).cast("double").alias(f"class_{c}") for c in range(5) if f"class_{c}" not in out.columns]
    return _rounded(out.select("*", *missing), 6, *[f"class_{c}" for c in range(5)])


@_query(with_views("spot_peak") + """, t AS (SELECT file_id, sum(height) AS total FROM spot_peak GROUP BY file_id)
    SELECT spot_id, file_id, round(height / total, 9) AS value FROM spot_peak JOIN t USING (file_id)""")
def total_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matrix.total_normalised(views.spot_peak(spark, sf_dir)), 9, "value")


@_query(with_views("spot_peak") + """, r AS (SELECT spot_id, median(height) AS reference FROM spot_peak GROUP BY spot_id)
    SELECT file_id, round(median(height / reference), 6) AS factor, count(*) AS n FROM spot_peak JOIN r USING (spot_id) WHERE reference > 0 GROUP BY file_id""")
def pqn_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matrix.pqn_factors(views.spot_peak(spark, sf_dir)), 6, "factor")


@_query(with_views("spot_peak") + """, l AS (SELECT spot_id, file_id, log10(height) AS v FROM spot_peak WHERE height > 0),
    m AS (SELECT spot_id, avg(v) AS mean, stddev_samp(v) AS sd FROM l GROUP BY spot_id)
    SELECT spot_id, file_id, round((v - mean) / sd, 5) AS z FROM l JOIN m USING (spot_id) WHERE sd > 1e-9""")
def log_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matrix.scaled(views.spot_peak(spark, sf_dir)), 5, "z")


@_query(with_views("sample", "feature", "spot_peak") + """, f AS (SELECT spot_id, min(height) AS least FROM spot_peak WHERE height > 0 GROUP BY spot_id)
    SELECT spot_id, round(sum(CASE WHEN height > 0 THEN height ELSE coalesce(least, 1) END), 4) AS total, count(*) AS n
    FROM feature CROSS JOIN sample LEFT JOIN f USING (spot_id) LEFT JOIN spot_peak USING (spot_id, file_id) GROUP BY spot_id""")
def imputed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matrix.imputed_totals(views.spot_peak(spark, sf_dir), views.feature(spark, sf_dir), views.sample(spark, sf_dir)), 4, "total")


@_query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
    SELECT user_id, count(*) AS n_events, max(CASE WHEN k = 1 THEN event_type END) AS state FROM k GROUP BY user_id""")
def curation_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.last_state(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", ["ts", "event_id"], "event_type")


# --- statistics


@_query(with_views("sample", "spot_peak") + """, s AS (SELECT spot_id,
    count(CASE WHEN batch = 1 THEN height END) AS n1, avg(CASE WHEN batch = 1 THEN height END) AS m1, var_samp(CASE WHEN batch = 1 THEN height END) AS v1,
    count(CASE WHEN batch = 2 THEN height END) AS n2, avg(CASE WHEN batch = 2 THEN height END) AS m2, var_samp(CASE WHEN batch = 2 THEN height END) AS v2
    FROM spot_peak JOIN sample USING (file_id) GROUP BY spot_id)
    SELECT spot_id, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t,
        round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 6) AS df, round(m1 / m2, 6) AS fold_change
    FROM s WHERE n1 > 1 AND n2 > 1 AND v1 / n1 + v2 / n2 > 0""")
def welch_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = views.spot_peak(spark, sf_dir).join(views.sample(spark, sf_dir).select("file_id", F.col("batch").alias("grp")), "file_id")
    return _rounded(statistics.welch(met), 6, "t", "df", "fold_change")


@_query(with_views("sample", "spot_peak") + """, v AS (SELECT spot_id, class, height FROM spot_peak JOIN sample USING (file_id)),
    g AS (SELECT spot_id, avg(height) AS grand, count(*) AS n_all, count(DISTINCT class) AS k FROM v GROUP BY spot_id),
    c AS (SELECT spot_id, class, avg(height) AS m FROM v GROUP BY spot_id, class),
    q AS (SELECT spot_id, sum(pow(m - grand, 2)) AS b, sum(pow(height - m, 2)) AS w FROM v JOIN c USING (spot_id, class) JOIN g USING (spot_id) GROUP BY spot_id)
    SELECT spot_id, k - 1 AS df1, n_all - k AS df2, round((b / (k - 1)) / (w / (n_all - k)), 5) AS f FROM q JOIN g USING (spot_id) WHERE k > 1 AND n_all > k AND w > 0""")
def anova_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = views.spot_peak(spark, sf_dir).join(views.sample(spark, sf_dir).select("file_id", "class"), "file_id")
    return _rounded(statistics.anova(met), 5, "f")


@_query(with_views("sample", "spot_peak") + """, v AS (SELECT spot_id, height, CAST(injection_order AS DOUBLE) AS x FROM spot_peak JOIN sample USING (file_id)),
    r AS (SELECT *, rank() OVER (PARTITION BY spot_id ORDER BY height) + (count(*) OVER (PARTITION BY spot_id, height) - 1) / 2.0 AS ry,
        rank() OVER (PARTITION BY spot_id ORDER BY x) + (count(*) OVER (PARTITION BY spot_id, x) - 1) / 2.0 AS rx FROM v)
    SELECT spot_id, count(*) AS n, round(corr(height, x), 6) AS pearson, round(corr(ry, rx), 6) AS spearman FROM r GROUP BY spot_id HAVING count(*) > 2""")
def drift_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(statistics.correlated(views.spot_peak(spark, sf_dir), views.sample(spark, sf_dir)), 6, "pearson", "spearman")


@_query(with_views("sample", "spot_peak") + """SELECT batch, round(regr_slope(height, CAST(injection_order AS DOUBLE)), 4) AS slope,
    round(regr_intercept(height, CAST(injection_order AS DOUBLE)), 3) AS intercept, round(regr_r2(height, CAST(injection_order AS DOUBLE)), 9) AS r2
    FROM spot_peak JOIN sample USING (file_id) GROUP BY batch""")
def calibration_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_rounded(_rounded(statistics.calibration(views.spot_peak(spark, sf_dir), views.sample(spark, sf_dir)), 4, "slope"), 3, "intercept"), 9, "r2")


@_query("""WITH p AS (SELECT p_partkey AS id, p_brand AS grp, p_size / 1000.0 AS p FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p, id) AS r, count(*) OVER (PARTITION BY grp) AS m FROM p)
    SELECT id, grp, p, round(least(1, min(p * m / r) OVER (PARTITION BY grp ORDER BY p DESC, id DESC ROWS UNBOUNDED PRECEDING)), 9) AS bh,
        round(least(1, max(p * (m - r + 1)) OVER (PARTITION BY grp ORDER BY p, id ROWS UNBOUNDED PRECEDING)), 9) AS holm, round(least(1, p * m), 9) AS bonferroni FROM r""")
def p_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"), (F.col("p_size") / F.lit(1000.0)).alias("p"))
    return _rounded(statistics.adjusted(p, "grp"), 9, "bh", "holm", "bonferroni")


@_query(with_views("feature") + """, s AS (SELECT ontology, count(*) AS n_set, count(CASE WHEN mz >= 950 THEN 1 END) AS n_hit FROM feature GROUP BY ontology)
    SELECT ontology, n_set, n_hit, (SELECT CAST(sum(n_set) AS BIGINT) FROM s) AS n_all, (SELECT CAST(sum(n_hit) AS BIGINT) FROM s) AS n_hits FROM s WHERE n_set >= 3""")
def enrichment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.feature(spark, sf_dir)
    return statistics.enrichment_counts(f.where("mz >= 950"), f)


# --- chemistry and names


@_query("""WITH n AS (SELECT p_partkey AS spot_id, p_size AS c, 2 * p_size AS h, p_size % 7 + 1 AS o FROM part)
    SELECT spot_id, 'C' || c || 'H' || h || 'O' || o AS formula, round(c * 12.0 + h * 1.00782503207 + o * 15.99491461956, 6) AS mass,
        round(c * 12.0 + h * 1.00782503207 + o * 15.99491461956 + 1.00727646688, 6) AS protonated, CAST(1 AS DOUBLE) AS rdbe FROM n""")
def formula_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.concat(F.lit("C"), F.col("p_size").cast("string"), F.lit("H"), (F.col("p_size") * 2).cast("string"), F.lit("O"), (F.col("p_size") % 7 + 1).cast("string"))
    named = part.select(F.col("p_partkey").alias("spot_id"), text.alias("formula"))
    mass = chemistry.monoisotopic_mass(F.col("formula"))
    return named.select("spot_id", "formula", F.round(mass, 6).alias("mass"), F.round(chemistry.adduct_mz(mass, chemistry.PROTON, 1), 6).alias("protonated"), chemistry.ring_double_bonds(F.col("formula")).alias("rdbe"))


# --- ordered frames over chromatograms

TRACE = with_views("scan") + ", x AS (SELECT file_id, rt, sum(CASE WHEN mz BETWEEN 35 AND 65 THEN intensity ELSE 0 END) AS v FROM scan WHERE ms_level = 1 GROUP BY file_id, rt)"


def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.xic(views.scan(spark, sf_dir), 50.0, 15.0).select("file_id", "rt", "intensity")


def _smoothing_sql(w0: float, *others: float) -> str:
    near = [(w, f"{side}(v, {k}) OVER w") for k, w in enumerate(others, 1) for side in ("lag", "lead")]
    total = " + ".join(f"coalesce({c} * {k}, 0)" for k, c in near)
    share = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {k} END" for k, c in near)
    return f"{TRACE} SELECT file_id, round(rt, 6) AS rt, round((v * {w0} + {total}) / ({w0} + {share}), 5) AS smooth FROM x WINDOW w AS (PARTITION BY file_id ORDER BY rt)"


@_query(_smoothing_sql(3.0, 2.0, 1.0))
def trace_linear_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_rounded(signal.smoothed(_trace(spark, sf_dir), signal.linear_weights(2)), 6, "rt"), 5, "smooth").drop("intensity")


@_query(_smoothing_sql(17.0, 12.0, -3.0))
def trace_polynomial_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_rounded(signal.smoothed(_trace(spark, sf_dir), signal.SAVITZKY_GOLAY_5), 6, "rt"), 5, "smooth").drop("intensity")


@_query(_smoothing_sql(1.0, 0.6065306597126334, 0.1353352832366127, 0.0111089965382423))
def trace_gaussian_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian of one scan, over three scans on both sides."""
    return _rounded(_rounded(signal.gaussian_smoothed(_trace(spark, sf_dir), 1.0), 6, "rt"), 5, "smooth").drop("intensity")


@_query(TRACE + """, s AS (SELECT *, floor(rt / 2000) AS seg FROM x), q AS (SELECT *, row_number() OVER (PARTITION BY file_id, seg ORDER BY v, rt) AS k FROM s),
    l AS (SELECT file_id, seg, rt AS t, v AS y, lag(rt) OVER w AS tb, lag(v) OVER w AS yb, lead(rt) OVER w AS ta, lead(v) OVER w AS ya FROM q WHERE k = 1 WINDOW w AS (PARTITION BY file_id ORDER BY seg)),
    m AS (SELECT s.file_id, s.rt, s.v, CASE WHEN s.rt >= t THEN t ELSE coalesce(tb, t) END AS t1, CASE WHEN s.rt >= t THEN y ELSE coalesce(yb, y) END AS y1,
        CASE WHEN s.rt >= t THEN coalesce(ta, t) ELSE t END AS t2, CASE WHEN s.rt >= t THEN coalesce(ya, y) ELSE y END AS y2 FROM s JOIN l USING (file_id, seg))
    SELECT file_id, round(rt, 6) AS rt, round(greatest(0, v - (y1 + (y2 - y1) * CASE WHEN t2 > t1 THEN (rt - t1) / (t2 - t1) ELSE 0 END)), 5) AS intensity FROM m""")
def trace_baseline_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intensity above lines between the minima of segments of 2000 minutes."""
    return _rounded(_rounded(signal.baseline_corrected(_trace(spark, sf_dir), 2000.0), 6, "rt"), 5, "intensity")


@_query(with_views("fragment") + """, n AS (SELECT *, lag(mz) OVER w AS mb, coalesce(lag(intensity) OVER w, 0) AS b, lead(mz) OVER w AS ma, coalesce(lead(intensity) OVER w, 0) AS a FROM fragment WINDOW w AS (PARTITION BY spectrum_id ORDER BY mz))
    SELECT spectrum_id, round((mz * intensity + coalesce(mb, 0) * b + coalesce(ma, 0) * a) / (intensity + b + a), 6) AS mz, intensity FROM n WHERE intensity > b AND intensity >= a""")
def spectrum_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spectrum's local maxima, its fragments read as a profile."""
    return _rounded(signal.centroids(views.fragment(spark, sf_dir)), 6, "mz")


APEX_SQL = """, l AS (SELECT *, row_number() OVER w AS pos, lag(v, 1) OVER w AS a1, lag(v, 2) OVER w AS a2, lead(v, 1) OVER w AS b1, lead(v, 2) OVER w AS b2, lead(rt) OVER w AS r2 FROM x
    WINDOW w AS (PARTITION BY file_id ORDER BY rt)),
    p AS (SELECT file_id, pos AS id, rt AS apex_rt, v AS height, row_number() OVER (PARTITION BY file_id ORDER BY abs(rt - 20000), rt) AS k, count(*) OVER (PARTITION BY file_id) AS n FROM l
        WHERE ((a2 <= a1 AND a1 <= v AND v > b1) OR (a1 < v AND v >= b1 AND b1 >= b2)) AND a2 IS NOT NULL AND b2 IS NOT NULL AND abs(rt - 20000) <= 15000)"""


@_query(TRACE + APEX_SQL + """SELECT file_id, n AS n_apexes, round(apex_rt, 6) AS rt, round(height, 6) AS intensity FROM p WHERE k = 1""")
def nearest_apex(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signal.nearest_apex(signal.numbered(_trace(spark, sf_dir)), 20000.0, 15000.0)
    return _rounded(out.select("file_id", "n_apexes", "rt", "intensity"), 6, "rt", "intensity")


@_query(with_views("peak") + """, l AS (SELECT DISTINCT CAST(p_size AS DOUBLE) AS c0, p_size * p_size / 8.0 AS t0 FROM part WHERE p_size BETWEEN 5 AND 40),
    s AS (SELECT c0, t0, lead(c0) OVER (ORDER BY t0) AS c1, lead(t0) OVER (ORDER BY t0) AS t1 FROM l),
    g AS (SELECT min(c0) AS ca, max(c0) AS cb, min(t0) AS ta, max(t0) AS tb FROM l)
    SELECT peak_id, rt, round((c0 + (c1 - c0) * (rt - t0) / (t1 - t0)) * 100, 5) AS retention_index FROM peak JOIN s ON t1 IS NOT NULL AND rt >= t0 AND rt < t1
    UNION ALL SELECT peak_id, rt, round((ca + (cb - ca) * (rt - ta) / (tb - ta)) * 100, 5) FROM peak, g WHERE rt < ta OR rt >= tb""")
def retention_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    ladder = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size BETWEEN 5 AND 40").select(size.alias("carbon"), (size * size / 8).alias("ladder_rt")).distinct()
    return _rounded(signal.kovats(views.peak(spark, sf_dir), ladder), 5, "retention_index").select("peak_id", "rt", "retention_index")


@_query(with_views("peak", "library") + """, m AS (SELECT rt, ref_rt FROM peak JOIN library ON abs(mz - ref_mz) <= 0.005 AND abs(rt - ref_rt) <= 20)
    SELECT count(*) AS n, round(regr_slope(rt, ref_rt), 6) AS slope, round(regr_intercept(rt, ref_rt), 5) AS intercept, round(regr_r2(rt, ref_rt), 6) AS r2
    FROM m HAVING count(*) >= 20""")
def library_recalibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = matching.library_matches(views.peak(spark, sf_dir), views.library(spark, sf_dir), 0.005, 20.0)
    return _rounded(_rounded(signal.recalibration(pairs, "rt", "ref_rt"), 6, "slope", "r2"), 5, "intercept")


# --- networks and records


@_query(with_views("peak") + """, d AS (SELECT * FROM (VALUES ('sodium for proton', 21.981943), ('ammonium for proton', 17.026549), ('carbon isotope', 1.003355)) t(relation, d))
    SELECT a.file_id, relation, a.peak_id AS light_id, b.peak_id AS heavy_id, round(b.mz - (a.mz + CAST(d AS DOUBLE)), 6) AS error FROM peak a, d
    JOIN peak b ON a.file_id = b.file_id AND abs(b.mz - (a.mz + CAST(d AS DOUBLE))) <= 0.05 AND abs(a.rt - b.rt) <= 3 AND a.peak_id <> b.peak_id""")
def ion_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(network.ion_links(views.peak(spark, sf_dir), network.ion_differences(spark), 0.05, 3.0), 6, "error")


@_query(with_views("fragment") + """, r AS (SELECT *, row_number() OVER w AS rank, first_value(intensity) OVER w AS base FROM fragment
    WINDOW w AS (PARTITION BY spectrum_id ORDER BY intensity DESC, mz))
    SELECT spectrum_id, rank, mz, CAST(round(intensity * 100 / base, 0) AS BIGINT) AS percent FROM r WHERE rank <= 3""")
def product_ions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.product_ions(views.fragment(spark, sf_dir), 3)


@_query(with_views("spectrum", "fragment") + """SELECT 'S' || spectrum_id AS name, any_value(precursor_mz) AS precursor_mz, count(*) AS n_peaks,
    round(sum(mz * intensity), 4) AS weighted FROM spectrum JOIN fragment USING (spectrum_id) GROUP BY spectrum_id""")
def msp_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = views.fragment(spark, sf_dir).groupBy("spectrum_id").agg(F.sort_array(F.collect_list(F.struct("mz", "intensity"))).alias("peaks"))
    spectra = views.spectrum(spark, sf_dir).join(peaks, "spectrum_id").select(F.concat(F.lit("S"), F.col("spectrum_id")).alias("name"), "precursor_mz", "peaks")
    back = records.parse_msp(records.msp_text(spectra))
    return back.select("name", "precursor_mz", F.size("peaks").cast("long").alias("n_peaks"), F.round(F.aggregate("peaks", F.lit(0.0), lambda t, p: t + p["mz"] * p["intensity"]), 4).alias("weighted"))


# --- rank tests and principal components

RANKED = with_views("sample", "spot_peak") + """, v AS (SELECT spot_id, class, CASE WHEN class = 0 THEN 1 ELSE 2 END AS grp, height FROM spot_peak JOIN sample USING (file_id)),
    t AS (SELECT *, count(*) OVER (PARTITION BY spot_id, height) AS ties, rank() OVER (PARTITION BY spot_id ORDER BY height) AS low FROM v),
    r AS (SELECT *, low + (ties - 1) / 2.0 AS mid, ties * ties - 1.0 AS tie FROM t)"""


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = views.spot_peak(spark, sf_dir).join(views.sample(spark, sf_dir).select("file_id", "class"), "file_id")
    return met.withColumn("grp", F.when(F.col("class") == 0, 1).otherwise(2))


@_query(RANKED + """, s AS (SELECT spot_id, CAST(count(*) FILTER (grp = 1) AS DOUBLE) AS a, CAST(count(*) FILTER (grp = 2) AS DOUBLE) AS b,
    CAST(sum(mid) FILTER (grp = 1) AS DOUBLE) AS r, CAST(sum(tie) AS DOUBLE) AS tie FROM r GROUP BY spot_id),
    u AS (SELECT *, a * b / 12 * (a + b + 1 - tie / ((a + b) * (a + b - 1))) AS spread FROM s WHERE a > 0 AND b > 0)
    SELECT spot_id, r - a * (a + 1) / 2 AS u, round((r - a * (a + 1) / 2 - a * b / 2) / sqrt(spread), 6) AS z FROM u WHERE spread > 0""")
def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(statistics.mann_whitney(_classed(spark, sf_dir)), 6, "z")


@_query(RANKED + """, c AS (SELECT spot_id, class, CAST(count(*) AS DOUBLE) AS n, CAST(sum(mid) AS DOUBLE) AS r, CAST(sum(tie) AS DOUBLE) AS tie FROM r GROUP BY spot_id, class),
    s AS (SELECT spot_id, count(*) AS k, sum(n) AS n, sum(r * r / n) AS q, sum(tie) AS tie FROM c GROUP BY spot_id)
    SELECT spot_id, k - 1 AS df, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - tie / (n * n * n - n)), 6) AS h FROM s
    WHERE k > 1 AND n > 2 AND 1 - tie / (n * n * n - n) > 0""")
def kruskal_wallis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(statistics.kruskal_wallis(_classed(spark, sf_dir)), 6, "h")


@_query(with_views("spot_peak") + """, l AS (SELECT spot_id, file_id, log10(height) AS v FROM spot_peak WHERE height > 0),
    m AS (SELECT spot_id, avg(v) AS mean, stddev_samp(v) AS sd FROM l GROUP BY spot_id HAVING stddev_samp(v) > 1e-9),
    z AS (SELECT spot_id, file_id, (v - mean) / sd AS z FROM l JOIN m USING (spot_id))
    SELECT a.file_id AS file_a, b.file_id AS file_b, round(sum(a.z * b.z), 5) AS dot FROM z a JOIN z b ON a.spot_id = b.spot_id AND a.file_id <= b.file_id GROUP BY 1, 2""")
def sample_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(statistics.sample_gram(matrix.scaled(views.spot_peak(spark, sf_dir))), 5, "dot")


def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.run_components(matrix.scaled(views.spot_peak(spark, sf_dir)))


QUERIES["principal_components"] = principal_components  # eigenvectors are beyond SQL


# --- chromatogram totals, filled gaps, spectra


@_query(with_views("scan") + """SELECT file_id, round(rt, 6) AS rt, round(sum(intensity), 6) AS total, round(max(intensity), 6) AS base_peak FROM scan WHERE ms_level = 1
    GROUP BY file_id, rt""")
def ion_chromatograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scans.ion_chromatograms(views.scan(spark, sf_dir)), 6, "rt", "total", "base_peak")


@_query(TRACE + APEX_SQL + """, e AS (SELECT file_id, any_value(id) AS id, max(pos) FILTER (pos <= id - 2 AND (a1 IS NULL OR a1 >= v)) AS l,
        min(pos) FILTER (pos >= id + 2 AND (b1 IS NULL OR v <= b1)) AS r, any_value(height) AS was FROM l JOIN p USING (file_id) WHERE k = 1 GROUP BY file_id),
    i AS (SELECT l.*, e.l, e.r, e.id, ((a1 <= v AND v > b1) OR (a1 < v AND v >= b1)) AND pos > e.l AND pos < e.r AND v > was AS higher FROM l JOIN e USING (file_id)),
    t AS (SELECT file_id, coalesce(arg_max(pos, v * 1e6 - pos) FILTER (higher), any_value(id)) AS top FROM i GROUP BY file_id)
    SELECT file_id, round(max(CASE WHEN pos = top THEN rt END), 6) AS apex_rt, round(max(CASE WHEN pos = top THEN v END), 6) AS height,
        round(max(CASE WHEN pos = l THEN rt END), 6) AS rt_left, round(max(CASE WHEN pos = r THEN rt END), 6) AS rt_right,
        round(sum(CASE WHEN pos >= l AND pos < r THEN (r2 - rt) * (v + b1) / 2 END) * 60, 2) AS area,
        round(sum(CASE WHEN pos >= l AND pos < r THEN (r2 - rt) * (v + b1) / 2 END) * 60
            - (max(CASE WHEN pos = l THEN v END) + max(CASE WHEN pos = r THEN v END)) * (max(CASE WHEN pos = r THEN rt END) - max(CASE WHEN pos = l THEN rt END)) / 2 * 60, 2) AS area_above_baseline
    FROM i JOIN t USING (file_id) GROUP BY file_id""")
def gaps_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signal.gaps_filled(_trace(spark, sf_dir), 20000.0, 15000.0)
    return _rounded(_rounded(out, 6, "apex_rt", "height", "rt_left", "rt_right"), 2, "area", "area_above_baseline")


@_query(with_views("fragment") + """, m AS (SELECT *, max(intensity) OVER (PARTITION BY spectrum_id) AS top,
        row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, mz) AS k FROM fragment)
    SELECT spectrum_id, mz, intensity FROM m WHERE intensity >= 0.2 * top AND k <= 4""")
def strongest_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.strongest_peaks(views.fragment(spark, sf_dir), 0.2, 4)


@_query(with_views("spectrum", "fragment") + """, b AS (SELECT spectrum_id, max(intensity) AS top FROM fragment GROUP BY spectrum_id)
    SELECT spectrum_id, round(precursor_mz, 6) AS precursor_mz, count(*) AS n_losses FROM spectrum JOIN fragment USING (spectrum_id) JOIN b USING (spectrum_id)
    WHERE abs(precursor_mz - mz - 100) <= 20 AND intensity >= 0.1 * top GROUP BY spectrum_id, precursor_mz""")
def neutral_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(network.neutral_losses(views.spectrum(spark, sf_dir), views.fragment(spark, sf_dir), 100.0, 20.0, 0.1), 6, "precursor_mz")


# --- further matrix operators and tests


@_query(with_views("spot_peak") + """, l AS (SELECT spot_id, file_id, log10(height) AS v FROM spot_peak WHERE height > 0),
    m AS (SELECT spot_id, avg(v) AS mean, stddev_samp(v) AS sd FROM l GROUP BY spot_id)
    SELECT spot_id, file_id, round((v - mean) / sqrt(sd), 5) AS z FROM l JOIN m USING (spot_id) WHERE sd > 1e-9""")
def pareto_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matrix.pareto_scaled(views.spot_peak(spark, sf_dir)), 5, "z")


@_query(with_views("sample", "spot_peak") + """SELECT spot_id, class, min(height) AS least, round(quantile_cont(height, 0.25), 6) AS lower, round(quantile_cont(height, 0.5), 6) AS middle,
    round(quantile_cont(height, 0.75), 6) AS upper, max(height) AS most FROM spot_peak JOIN sample USING (file_id) GROUP BY spot_id, class""")
def box_plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matrix.box_plots(views.spot_peak(spark, sf_dir), views.sample(spark, sf_dir)), 6, "lower", "middle", "upper")


@_query(with_views("spot_peak") + """, m AS (SELECT spot_id, max(height) AS h, min(height) AS l FROM spot_peak GROUP BY spot_id),
    b AS (SELECT CASE WHEN min(l) > 1 THEN log2(min(l)) ELSE 0 END AS lo, CASE WHEN max(h) > 1 THEN log2(max(h)) ELSE 1 END AS hi FROM m)
    SELECT spot_id, round(least(1, greatest(0, (log2(h) - lo) / (hi - lo))), 6) AS amplitude FROM m, b""")
def relative_amplitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matrix.relative_amplitudes(views.spot_peak(spark, sf_dir)), 6, "amplitude")


@_query(with_views("feature") + """SELECT spot_id, mz - floor(mz) >= 0.00111 * mz + 0.039 AS above_line, round((mz - floor(mz)) / mz * 1e6, 4) AS relative_defect FROM feature""")
def mass_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.feature(spark, sf_dir).select("spot_id", chemistry.above_defect_line(F.col("mz")).alias("above_line"), F.round(chemistry.relative_mass_defect(F.col("mz")), 4).alias("relative_defect"))


@_query(with_views("spot_peak") + """, a AS (SELECT * FROM spot_peak WHERE height > 0)
    SELECT a.file_id AS file_a, b.file_id AS file_b, count(*) AS n, round(corr(a.height, b.height), 6) AS pearson
    FROM a JOIN a AS b USING (spot_id) WHERE a.file_id < b.file_id GROUP BY 1, 2 HAVING count(*) > 2""")
def run_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(statistics.run_correlations(views.spot_peak(spark, sf_dir)), 6, "pearson")


def welch_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided p of Welch's test (SQL has no t distribution)."""
    met = views.spot_peak(spark, sf_dir).join(views.sample(spark, sf_dir).select("file_id", F.col("batch").alias("grp")), "file_id")
    return statistics.welch(met).withColumn("p", distributions.student_p(F.col("t"), F.col("df")))


def anova_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper tail of the analysis of variance."""
    return statistics.anova(_classed(spark, sf_dir)).withColumn("p", distributions.fisher_p(F.col("f"), F.col("df1"), F.col("df2")))


def kruskal_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper tail of the Kruskal-Wallis test."""
    return statistics.kruskal_wallis(_classed(spark, sf_dir)).withColumn("p", distributions.chi_square_p(F.col("h"), F.col("df")))


QUERIES |= {f.__name__: f for f in (welch_p, anova_p, kruskal_p)}

# queries by subject register themselves
from ionframe.queries import alignment, chemistry as _chemistry, exports, names, pathways as _pathways, results, searches, spectra, spotting, summaries  # noqa: E402, F401

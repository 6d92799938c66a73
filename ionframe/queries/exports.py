"""Text records and tables for other programs, and back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.operators import matrix, network, quantities
from ionframe.plans import views
from ionframe.plans.views import with_views
from ionframe.registry import query
from ionframe.sources import mzml, records
from ionframe.tables import shared_dir


def _spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = views.fragment(spark, sf_dir).groupBy("spectrum_id").agg(F.sort_array(F.collect_list(F.struct("mz", "intensity"))).alias("peaks"))
    return views.spectrum(spark, sf_dir).join(peaks, "spectrum_id").select(F.concat(F.lit("S"), F.col("spectrum_id")).alias("name"), "precursor_mz", "peaks")


TRIP = with_views("spectrum", "fragment") + """SELECT 'S' || spectrum_id AS name, round(any_value(precursor_mz), {digits}) AS precursor_mz, count(*) AS n_peaks,
    round(sum(mz * intensity), 4) AS weighted FROM spectrum JOIN fragment USING (spectrum_id) GROUP BY spectrum_id"""


def _summed(spectra: DataFrame, digits: int) -> DataFrame:
    weighted = F.aggregate("peaks", F.lit(0.0), lambda t, p: t + p["mz"] * p["intensity"])
    return spectra.select("name", F.round("precursor_mz", digits).alias("precursor_mz"), F.size("peaks").cast("long").alias("n_peaks"), F.round(weighted, 4).alias("weighted"))


@query(TRIP.format(digits=5))
def mgf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(records.parse_mgf(records.mgf_text(_spectra(spark, sf_dir))), 5)


@query(TRIP.format(digits=5))
def massbank_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _spectra(spark, sf_dir).withColumns({"accession": F.col("name"), "formula": F.lit("C6H12O6")})
    return _summed(records.parse_massbank(records.massbank_text(told)), 5)


@query(with_views("spectrum", "fragment") + """SELECT 'S' || spectrum_id AS name, 2 + count(*) AS n_lines, round(sum(intensity), 2) AS total FROM spectrum JOIN fragment USING (spectrum_id) GROUP BY spectrum_id""")
def mat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure-finder records, read back by their peak lines: two isotopes and the product ions."""
    told = _spectra(spark, sf_dir).withColumn("precursor_type", F.lit("[M+H]+")).withColumn("isotopes", F.array(*[F.struct((F.col("precursor_mz") + k).alias("mz"), F.lit(0.0).alias("intensity")) for k in (0, 1)]))
    text = records.mat_text(told)
    lines = F.regexp_extract_all("value", F.lit(r"(?m)^[0-9.]+\t([0-9.]+)$"), F.lit(1))
    return text.select(F.regexp_extract("value", r"NAME: (\S+)", 1).alias("name"), F.size(lines).cast("long").alias("n_lines"), F.round(F.aggregate(lines, F.lit(0.0), lambda s, x: s + x.cast("double")), 2).alias("total"))


@query(r"""WITH p AS (SELECT p_partkey AS id, 'P' || p_partkey AS name, upper(regexp_replace(p_name, '[^a-zA-Z]', '', 'g')) AS seq FROM part),
    c AS (SELECT name, list_filter(string_split(replace(regexp_replace(seq, '([KR])', '\1|', 'g'), '|P', 'P'), '|'), lambda x: x <> '') AS parts FROM p),
    e AS (SELECT name, parts, unnest(range(1, len(parts) + 1)) AS i FROM c), m AS (SELECT *, unnest([0, 1]) AS missed FROM e)
    SELECT name, 1 + length(array_to_string(parts[1:i - 1], '')) AS start, array_to_string(parts[i:i + missed], '') AS peptide, missed FROM m
    WHERE i + missed <= len(parts) AND length(array_to_string(parts[i:i + missed], '')) >= 4""")
def tryptic_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as proteins."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.concat(F.lit("P"), F.col("p_partkey").cast("string"), F.lit(" a part\n"), F.regexp_replace("p_name", "[^a-zA-Z]", ""))
    return records.digested(records.parse_fasta(part.select(text.alias("value"))), 1, 4)


@query("""SELECT 'P' || p_partkey AS name, reverse(upper(regexp_replace(p_name, '[^a-zA-Z]', '', 'g'))) AS peptide, true AS is_decoy FROM part""")
def decoy_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    told = part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("name"), F.upper(F.regexp_replace("p_name", "[^a-zA-Z]", "")).alias("peptide"))
    return records.decoys(told)


@query(with_views("sample", "feature", "spot_peak") + """, h AS (SELECT spot_id, avg(height) AS height FROM spot_peak GROUP BY spot_id)
    SELECT printf('%d', spot_id) || chr(9) || name || chr(9) || ontology || chr(9) || printf('%.3f', rt) || chr(9) || printf('%.5f', mz) || chr(9) || printf('%.0f', round(height, 0)) AS line
    FROM feature JOIN h USING (spot_id)""")
def network_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    heights = views.spot_peak(spark, sf_dir).groupBy("spot_id").agg(quantities.exact_mean(F.col("height")).alias("height"))
    return network.node_lines(views.feature(spark, sf_dir).join(heights, "spot_id"))


@query(with_views("feature") + """SELECT '{"id":' || spot_id || ',"name":"' || name || '","rt":' || CAST(CAST(rt AS BIGINT) AS VARCHAR) || '}' AS document,
    spot_id || chr(9) || name || chr(9) || CAST(CAST(rt AS BIGINT) AS VARCHAR) AS line FROM feature""")
def documents_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row as a JSON document and as a tab-separated line."""
    f = views.feature(spark, sf_dir).select(F.col("spot_id").alias("id"), "name", F.col("rt").cast("long").alias("rt"))
    return f.select(F.to_json(F.struct("id", "name", "rt")).alias("document"), F.concat_ws("\t", *[F.col(c).cast("string") for c in ("id", "name", "rt")]).alias("line"))


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE NOT (event_type = 'view' AND value < 20))
    SELECT user_id, event_type AS state, n AS n_events FROM k WHERE k = 1""")
def curation_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current state once transactions are undone: cheap views stand for what was taken back."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    undone = events.where((F.col("event_type") == "view") & (F.col("value") < 20)).select("event_id")
    return matrix.state_without(events, undone, "event_id", "user_id", ["ts", "event_id"], "event_type")


def _mzml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra written as mzML files to the shared folder and read back by the reader."""
    told = _spectra(spark, sf_dir).select(
        F.substring("name", 2, 20).cast("int").alias("scan_idx"), F.col("name").alias("id"), F.lit(2).alias("ms_level"), F.lit("+").alias("polarity"),
        (F.substring("name", 2, 20).cast("double") / 100).alias("rt"), F.struct(F.col("precursor_mz").alias("mz")).alias("precursor"), "peaks")
    path = f"{shared_dir(spark)}/tables/mzml-{uuid.uuid4().hex}"
    mzml.file_text(told).write.text(path)
    return mzml.read_mzml(spark, path)


@query(with_views("spectrum", "fragment") + """SELECT 'S' || spectrum_id AS name, round(any_value(precursor_mz), 6) AS parent, round(spectrum_id / 100, 4) AS rt, count(*) AS n_peaks,
    round(sum(mz * intensity), 4) AS weighted FROM spectrum JOIN fragment USING (spectrum_id) GROUP BY spectrum_id""")
def mzml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = F.aggregate("peaks", F.lit(0.0), lambda t, p: t + p["mz"] * p["intensity"])
    return _mzml(spark, sf_dir).select(F.col("id").alias("name"), F.round("precursor.mz", 6).alias("parent"), F.round("rt", 4).alias("rt"), F.size("peaks").cast("long").alias("n_peaks"), F.round(weighted, 4).alias("weighted"))


@query(with_views("spectrum", "fragment") + "SELECT 'S' || spectrum_id AS name FROM spectrum WHERE abs(precursor_mz - 120) <= 5 AND spectrum_id IN (SELECT spectrum_id FROM fragment)")
def isolation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans that isolated a mass (no offsets here, so by their parents)."""
    return mzml.in_window(_mzml(spark, sf_dir), 120.0, 5.0).select(F.col("id").alias("name"))


@query(with_views("spectrum", "fragment") + """, n AS (SELECT spectrum_id, any_value(precursor_mz) AS m, count(*) AS n FROM spectrum JOIN fragment USING (spectrum_id) GROUP BY spectrum_id)
    SELECT count(*) AS n_records, round(min(m), 5) AS min_mz, round(max(m), 5) AS max_mz, CAST(sum(n) AS BIGINT) AS n_peaks, max(n) AS most_peaks FROM n""")
def library_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read back from the records' text."""
    told = records.summary(records.parse_msp(records.msp_text(_spectra(spark, sf_dir))))
    return told.select("n_records", F.round("min_mz", 5).alias("min_mz"), F.round("max_mz", 5).alias("max_mz"), "n_peaks", F.col("most_peaks").cast("long").alias("most_peaks"))


WHOLE = "CAST(floor(coalesce({c}, 0) + 0.5) AS BIGINT)"


@query(with_views("sample", "feature", "spot_peak") + f""", cell AS (SELECT spot_id, file_id, height, area FROM feature CROSS JOIN sample LEFT JOIN spot_peak USING (spot_id, file_id)),
    text AS (SELECT spot_id, string_agg({WHOLE.format(c="height")}, chr(9) ORDER BY file_id) AS h, string_agg({WHOLE.format(c="area")}, chr(9) ORDER BY file_id) AS a, count(height) * 100.0 / count(*) AS fill FROM cell GROUP BY spot_id)
    SELECT spot_id, concat_ws(chr(9), spot_id, name, printf('%.3f', rt), printf('%.5f', mz), adduct, ontology, CAST(floor(fill + 0.5) AS BIGINT), h, a) AS line FROM feature JOIN text USING (spot_id)""")
def matrix_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature's line of the exported matrix."""
    return matrix.matrix_lines(views.feature(spark, sf_dir), views.spot_peak(spark, sf_dir), views.sample(spark, sf_dir))

"""Text spectra: MSP and MGF records as a source, and as text for a sink.

A record is one row from the scan on (the reader splits at the record's end), so
large libraries are read in parallel and never regrouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A peak: two numbers at the start of a line or after a semicolon.
PEAK = r"(?m)(?:^|;)[ \t]*([0-9][0-9.eE+-]*)[ \t:,]+([0-9][0-9.eE+-]*)"


def _field(record: Column, name: str, mark: str) -> Column:
    found = F.regexp_extract(record, rf"(?im)^{name}[ \t]*{mark}[ \t]*([^\r\n]*?)[ \t]*$", 1)
    return F.when(found != "", found)


def _peaks(record: Column) -> Column:
    return F.zip_with(F.regexp_extract_all(record, F.lit(PEAK), F.lit(1)), F.regexp_extract_all(record, F.lit(PEAK), F.lit(2)), lambda m, i: F.struct(m.cast("double").alias("mz"), i.cast("double").alias("intensity")))


def parse_msp(records: DataFrame, col: str = "value") -> DataFrame:
    """``name, precursor_mz, precursor_type, formula, retention_time, peaks`` of each record;
    a field that is absent or not a number is null."""
    r = F.replace(F.col(col), F.lit("\r"), F.lit(""))
    number = lambda name: _field(r, name, ":").try_cast("double")
    return records.where(F.trim(r) != "").select(_field(r, "NAME", ":").alias("name"), number("PRECURSORMZ").alias("precursor_mz"), _field(r, "PRECURSORTYPE", ":").alias("precursor_type"), _field(r, "FORMULA", ":").alias("formula"), number("RETENTIONTIME").alias("retention_time"), _peaks(r).alias("peaks"))


def parse_mgf(records: DataFrame, col: str = "value") -> DataFrame:
    """``name, precursor_mz, charge, peaks`` of each BEGIN IONS block."""
    r = F.replace(F.col(col), F.lit("\r"), F.lit(""))
    mass = F.regexp_extract(r, r"(?im)^PEPMASS[ \t]*=[ \t]*([0-9.]+)", 1)
    return records.where(r.contains("BEGIN IONS")).select(_field(r, "TITLE", "=").alias("name"), mass.try_cast("double").alias("precursor_mz"), _field(r, "CHARGE", "=").alias("charge"), _peaks(r).alias("peaks"))


def read_msp(spark: SparkSession, path: str, line_end: str = "\n") -> DataFrame:
    """Records are parted by an empty line; ``line_end`` is the file's own."""
    return parse_msp(spark.read.text(path, lineSep=line_end * 2).where(F.col("value").rlike("(?im)^NAME")))


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    return parse_mgf(spark.read.text(path, lineSep="END IONS"))


def _peak_lines(peaks: Column) -> Column:
    return F.array_join(F.transform(peaks, lambda p: F.format_string("%.5f\t%.2f", p["mz"], p["intensity"])), "\n")


def msp_text(spectra: DataFrame) -> DataFrame:
    """One MSP record a row from ``name, precursor_mz, peaks``; write it with ``write.text``,
    whose line feed ends the record."""
    head = F.format_string("NAME: %s\nPRECURSORMZ: %.5f\nNum Peaks: %d\n", F.col("name"), F.col("precursor_mz"), F.size("peaks"))
    return spectra.select(F.concat(head, _peak_lines(F.col("peaks")), F.lit("\n")).alias("value"))


def mgf_text(spectra: DataFrame) -> DataFrame:
    head = F.format_string("BEGIN IONS\nTITLE=%s\nPEPMASS=%.5f\n", F.col("name"), F.col("precursor_mz"))
    return spectra.select(F.concat(head, _peak_lines(F.col("peaks")), F.lit("\nEND IONS\n")).alias("value"))


def summary(library: DataFrame) -> DataFrame:
    """One pass over a library: records, ranges and peaks a record."""
    n = F.size("peaks")
    return library.agg(F.count("*").alias("n_records"), F.min("precursor_mz").alias("min_mz"), F.max("precursor_mz").alias("max_mz"), F.sum(n).alias("n_peaks"), F.max(n).alias("most_peaks"))


def parse_massbank(records: DataFrame, col: str = "value") -> DataFrame:
    """``accession, name, formula, precursor_mz, peaks`` of records that end in two slashes;
    peaks stand in lines of m/z, intensity and relative intensity after PK$PEAK."""
    r = F.replace(F.col(col), F.lit("\r"), F.lit(""))
    lines = F.regexp_extract_all(F.substring_index(r, "PK$PEAK:", -1), F.lit(r"(?m)^[ \t]+([0-9.eE+-]+[ \t]+[0-9.eE+-]+)"), F.lit(1))
    peaks = F.transform(lines, lambda p: F.struct(F.split(p, r"[ \t]+")[0].cast("double").alias("mz"), F.split(p, r"[ \t]+")[1].cast("double").alias("intensity")))
    told = lambda name: _field(r, name, ":")
    mass = F.regexp_extract(r, r"(?m)PRECURSOR_M/Z[ \t]+([0-9.]+)", 1).try_cast("double")
    return records.where(r.contains("ACCESSION")).select(told("ACCESSION").alias("accession"), told(r"CH\$NAME").alias("name"), told(r"CH\$FORMULA").alias("formula"), mass.alias("precursor_mz"), peaks.alias("peaks"))


def massbank_text(spectra: DataFrame) -> DataFrame:
    """One record a row from ``accession, name, formula, precursor_mz, peaks``."""
    top = F.array_max(F.transform("peaks", lambda p: p["intensity"]))
    lines = F.array_join(F.transform("peaks", lambda p: F.format_string("  %.5f %.2f %d", p["mz"], p["intensity"], F.round(p["intensity"] / top * 999).cast("int"))), "\n")
    head = F.format_string("ACCESSION: %s\nCH$NAME: %s\nCH$FORMULA: %s\nMS$FOCUSED_ION: PRECURSOR_M/Z %.5f\nPK$NUM_PEAK: %d\nPK$PEAK: m/z int. rel.int.\n", F.col("accession"), F.col("name"), F.col("formula"), F.col("precursor_mz"), F.size("peaks"))
    return spectra.select(F.concat(head, lines, F.lit("\n//\n")).alias("value"))


def mat_text(spectra: DataFrame) -> DataFrame:
    """One structure-finder record a row: survey and product spectrum of a feature."""
    part = lambda kind, col: F.concat(F.format_string(f"MSTYPE: {kind}\nNum Peaks: %d\n", F.size(col)), _peak_lines(F.col(col)))
    head = F.format_string("NAME: %s\nPRECURSORMZ: %.5f\nPRECURSORTYPE: %s\n", F.col("name"), F.col("precursor_mz"), F.col("precursor_type"))
    return spectra.select(F.concat(head, part("MS1", "isotopes"), F.lit("\n"), part("MS2", "peaks"), F.lit("\n")).alias("value"))


def parse_fasta(records: DataFrame, col: str = "value") -> DataFrame:
    """``name, description, sequence`` of records without their leading mark."""
    r = F.replace(F.col(col), F.lit("\r"), F.lit(""))
    head = F.substring_index(r, "\n", 1)
    body = F.when(F.instr(r, "\n") > 0, F.substring(r, F.instr(r, "\n") + 1, F.length(r))).otherwise("")
    return records.where(F.trim(r) != "").select(
        F.substring_index(head, " ", 1).alias("name"), F.when(F.instr(head, " ") > 0, F.trim(F.substring(head, F.instr(head, " ") + 1, F.length(head)))).alias("description"),
        F.upper(F.regexp_replace(body, r"[\s*]", "")).alias("sequence"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records begin with a mark at a line's start."""
    return parse_fasta(spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("value")))


def read_massbank(spark: SparkSession, path: str) -> DataFrame:
    return parse_massbank(spark.read.text(path, lineSep="\n//"))


def digested(proteins: DataFrame, missed: int = 1, shortest: int = 1) -> DataFrame:
    """``name, start, peptide, missed`` of a tryptic digest: cut after K and R, not before P;
    up to ``missed`` cuts are left out."""
    marked = F.regexp_replace(F.regexp_replace("sequence", "([KR])", "$1|"), r"\|P", "P")
    parts = F.filter(F.split(marked, r"\|"), lambda p: p != "")
    told = proteins.select("name", F.posexplode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(missed)), lambda m: F.transform(F.filter(F.transform(parts, lambda p, i: F.struct(i.alias("i"), m.alias("m"))), lambda x: x["i"] + m < F.size(parts)), lambda x: F.struct((x["i"] + 1).alias("first"), m.alias("missed"), F.array_join(F.slice(parts, x["i"] + 1, m + 1), "").alias("peptide"), (F.length(F.array_join(F.slice(parts, F.lit(1), x["i"]), "")) + 1).alias("start")))))).alias("k", "p"))
    return told.where(F.length("p.peptide") >= shortest).select("name", "p.start", "p.peptide", "p.missed")


def decoys(peptides: DataFrame) -> DataFrame:
    """The same rows with reversed sequences, marked as decoys."""
    return peptides.withColumn("peptide", F.reverse("peptide")).withColumn("is_decoy", F.lit(True))


"""Scan and chromatogram operators over exploded scan peaks.

Input rows: ``scan_id, file_id, ms_level, rt, mz, intensity``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionframe.operators.rangejoin import range_join


def _summed(inside: Column) -> Column:
    """Intensity where ``inside`` holds; a scan without such a peak is a point of zero."""
    return F.sum(F.when(inside, F.col("intensity")).otherwise(0.0)).alias("intensity")


def xic(scans: DataFrame, mz: float, tol: float = 0.01, ms_level: int = 1) -> DataFrame:
    """Extracted-ion chromatogram ``file_id, rt, intensity``: summed intensity in mz +- tol, a
    point for every scan of the level, zero where nothing matches."""
    return scans.where(F.col("ms_level") == ms_level).groupBy("file_id", "rt").agg(_summed(F.col("mz").between(mz - tol, mz + tol)))


def batch_xic(scans: DataFrame, targets: DataFrame, tol: float) -> DataFrame:
    """Several chromatograms at once: ``target_id, target_mz`` range-joined to the scans.

    A row a target and file with a matching peak: points of the trace (survey scans), those
    above zero, the sum and the highest point. Other traces are zero throughout.
    """
    survey = scans.where("ms_level = 1")
    met = range_join(survey, targets, "mz", "target_mz", tol)
    points = met.groupBy("target_id", "file_id", "rt").agg(F.sum("intensity").alias("y"))
    hits = points.groupBy("target_id", "file_id").agg(F.count_if(F.col("y") > 0).alias("n_hits"), F.sum("y").alias("total"), F.max("y").alias("top"))
    return hits.join(survey.groupBy("file_id").agg(F.countDistinct("rt").alias("n_points")), "file_id").select("target_id", "file_id", "n_points", "n_hits", "total", "top")


def gated(scans: DataFrame, mz: float, tol: float = 0.05) -> DataFrame:
    """MSn peaks whose parent lies in mz +- tol (inclusive)."""
    return scans.where((F.col("ms_level") > 1) & (F.col("mz") > 0) & (F.abs(F.col("mz") - mz) <= tol))


def distinct_precursors(scans: DataFrame) -> DataFrame:
    """Parents of MSn scans by 1e-4 units (half-even), with counts."""
    return scans.where((F.col("ms_level") > 1) & (F.col("mz") > 0)).groupBy(F.bround(F.col("mz") * 10000).cast("long").alias("key")).agg(F.count("*").alias("n"))


def level_counts(scans: DataFrame, rt_from: float, rt_to: float) -> DataFrame:
    return scans.where(F.col("rt").between(rt_from, rt_to)).groupBy("ms_level").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("n_files"))


def ranges(scans: DataFrame) -> DataFrame:
    """Smallest and largest time, m/z and intensity of each file."""
    return scans.groupBy("file_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("rt", "mz", "intensity") for n, f in (("min", F.min), ("max", F.max))])


def base_peak_scans(scans: DataFrame) -> DataFrame:
    """The MS1 row with the largest intensity of each file (ties: smaller scan_id)."""
    rows = scans.where("ms_level = 1")
    best = F.max_by(F.struct(*rows.columns), F.struct("intensity", -F.col("scan_id"))).alias("best")
    return rows.groupBy("file_id").agg(best).select("best.*")


def mass_bins(scans: DataFrame, width: float) -> DataFrame:
    """Summed intensity by file and m/z bin; the bin's m/z is its base peak's."""
    return scans.groupBy("file_id", F.floor(F.col("mz") / width).alias("bin")).agg(F.sum("intensity").alias("intensity"), F.max_by("mz", F.struct("intensity", "mz")).alias("base_mz"))


def nearest_survey(scans: DataFrame, width: float = 60.0) -> DataFrame:
    """Each MSn row with the last MS1 scan at or before it in its file (as-of).

    Rows are ordered within time bins of a file only; what a bin begins with comes from a
    table of the bins' last surveys.
    """
    placed = scans.withColumn("_bin", F.floor(F.col("rt") / width))
    survey = F.when(F.col("ms_level") == 1, F.col("scan_id"))
    ends = placed.groupBy("file_id", "_bin").agg(F.max_by("scan_id", F.when(F.col("ms_level") == 1, F.struct("rt", "scan_id"))).alias("end"))
    over = Window.partitionBy("file_id").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.select("file_id", "_bin", F.last("end", ignorenulls=True).over(over).alias("_begin"))
    inside = Window.partitionBy("file_id", "_bin").orderBy("rt", "scan_id").rowsBetween(Window.unboundedPreceding, 0)
    met = placed.withColumn("_own", F.last(survey, ignorenulls=True).over(inside)).where("ms_level > 1").join(begins, ["file_id", "_bin"])
    return met.withColumn("survey_id", F.coalesce("_own", "_begin")).drop("_own", "_begin", "_bin")


def contour_grid(scans: DataFrame, rt_bins: int, mz_bins: int) -> DataFrame:
    """Summed intensity on a grid over the data's range; the top edge is in the last bin."""
    span = scans.agg(F.min("rt").alias("r0"), F.max("rt").alias("r1"), F.min("mz").alias("m0"), F.max("mz").alias("m1"))

    def at(col: str, lo: str, hi: str, n: int) -> F.Column:
        return F.least(F.lit(n - 1), F.floor((F.col(col) - F.col(lo)) / (F.col(hi) - F.col(lo)) * n))

    # one row: broadcast whatever the table's size
    placed = scans.join(F.broadcast(span))
    return placed.groupBy(at("rt", "r0", "r1", rt_bins).cast("long").alias("row"), at("mz", "m0", "m1", mz_bins).cast("long").alias("bin")).agg(F.sum("intensity").alias("intensity"))


def average_spectrum(scans: DataFrame, rt_from: float, rt_to: float, ms_level: int = 1, tol: float = 0.01) -> DataFrame:
    """Mean spectrum of each file's scans in a time range, ``file_id, mz, intensity``.

    Peaks no further apart than ``tol`` are one, at their intensity-weighted m/z. Its
    intensity is the mean over the scans, those without the peak counting as zero. A peak
    whose intensities sum to zero stays, its m/z is NaN.
    """
    inside = scans.where((F.col("ms_level") == ms_level) & F.col("rt").between(rt_from, rt_to) & F.col("mz").isNotNull())
    n = inside.groupBy("file_id").agg(F.countDistinct("rt").alias("n"))
    # a scan's peaks meet by m/z first, so that what is ordered is one row an m/z
    sums = inside.groupBy("file_id", "mz").agg(F.sum("intensity").alias("intensity"))
    order = Window.partitionBy("file_id").orderBy("mz")
    apart = F.when(F.col("mz") - F.lag("mz").over(order) <= tol, 0).otherwise(1)
    grouped = sums.withColumn("new", apart).withColumn("grp", F.sum("new").over(order))
    # what sums to zero has no m/z of its own
    centre = F.coalesce(F.try_divide(F.sum(F.col("mz") * F.col("intensity")), F.sum("intensity")), F.lit(float("nan")))
    merged = grouped.groupBy("file_id", "grp").agg(centre.alias("mz"), F.sum("intensity").alias("total"))
    return merged.join(n, "file_id").select("file_id", "mz", (F.col("total") / F.col("n")).alias("intensity"))


def subtracted(peaks: DataFrame, background: DataFrame, tol: float = 0.01) -> DataFrame:
    """Peaks less the background peaks within ``tol`` of them, at least zero."""
    other = background.select(F.col("file_id").alias("_file"), F.col("mz").alias("_mz"), F.col("intensity").alias("_taken"))
    near = other.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_mz") / tol) - 1, F.floor(F.col("_mz") / tol) + 1)))
    own = peaks.withColumn("_bin", F.floor(F.col("mz") / tol))
    met = (own["file_id"] == near["_file"]) & (own["_bin"] == near["_bin"]) & near["_mz"].between(own["mz"] - tol, own["mz"] + tol)
    taken = own.join(near, met, "left").groupBy("file_id", "mz").agg(F.first("intensity").alias("intensity"), F.coalesce(F.sum("_taken"), F.lit(0.0)).alias("taken"))
    return taken.select("file_id", "mz", F.greatest(F.lit(0.0), F.col("intensity") - F.col("taken")).alias("intensity"))


def ion_chromatograms(scans: DataFrame) -> DataFrame:
    """Total-ion and base-peak chromatogram of the MS1 scans."""
    return scans.where("ms_level = 1").groupBy("file_id", "rt").agg(F.sum("intensity").alias("total"), F.max("intensity").alias("base_peak"))


def product_ions(scans: DataFrame, precursor: tuple[float, float], product: tuple[float, float]) -> DataFrame:
    """Product-ion chromatogram: summed intensity in a product range, a point for every MSn
    scan whose parent lies in a precursor range (both inclusive), zero where nothing matches."""
    met = scans.where((F.col("ms_level") > 1) & F.col("parent_mz").between(*precursor))
    return met.groupBy("file_id", "rt").agg(_summed(F.col("product_mz").between(*product)))


def amounts(fragments: DataFrame, targets: DataFrame, tol: float) -> DataFrame:
    """``spectrum_id, target, amount``: intensity less than ``tol`` away from each target."""
    met = range_join(fragments, targets, "mz", "target", tol).where(F.abs(F.col("mz") - F.col("target")) < tol)
    return met.groupBy("spectrum_id", "target").agg(F.sum("intensity").alias("amount"))

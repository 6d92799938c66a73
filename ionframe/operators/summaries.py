"""Summaries of runs, spectra and features; curation flags; preparation of a matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionframe.functions import chemistry
from ionframe.operators import matrix
from ionframe.operators.leaders import profile_correlation
from ionframe.operators.profiles import correlated_pairs

#: Mason-Schamp factor for nitrogen at one atmosphere, and the gas's mass (fixed values).
CROSS_SECTION, NITROGEN = 18509.863216340458, 28.0134


def cross_section(mobility: Column, charge: Column, mass: Column, inverse: bool, kelvin: float = 305.0) -> Column:
    """Collision cross-section of an ion in nitrogen; ``inverse``: the mobility is given as
    its inverse (trapped ions). -1 where the mobility is zero."""
    root = F.sqrt(mass * NITROGEN / (mass + NITROGEN) * kelvin)
    value = CROSS_SECTION * charge * mobility / root if inverse else CROSS_SECTION * charge / (root * mobility)
    return value if inverse else F.when(mobility == 0, -1.0).otherwise(value)


def curation_flags(values: DataFrame, features: DataFrame, samples: DataFrame, blank_ratio: float, rsd: float, defect: tuple[float, float]) -> DataFrame:
    """Five reasons to drop a spot: ``blank`` (blank mean over the larger of QC and sample
    mean), ``ghost`` (m/z to three places that a blank spot has), ``above_line`` (mass defect),
    ``spread`` (smallest class RSD), ``relative`` (relative mass defect outside a window).

    Means are over all files of a type, those without a peak as zero.
    """
    sizes = samples.groupBy("sample_type").agg(F.count("*").alias("size"))
    met = values.join(samples.select("file_id", "sample_type"), "file_id").groupBy("spot_id", "sample_type").agg(F.sum("height").alias("total"))
    mean = met.join(F.broadcast(sizes), "sample_type").withColumn("mean", F.col("total") / F.col("size"))  # a row a type
    per = lambda k: F.coalesce(F.max(F.when(F.col("sample_type") == k, F.col("mean"))), F.lit(0.0))
    means = mean.groupBy("spot_id").agg(per("Blank").alias("b"), F.greatest(per("QC"), per("Sample")).alias("s"))
    has_blank = samples.agg((F.count(F.when(F.col("sample_type") == "Blank", 1)) > 0).alias("any_blank"))
    told = features.select("spot_id", "mz").join(means, "spot_id").join(F.broadcast(has_blank))
    told = told.withColumn("blank", F.col("any_blank") & (F.col("b") >= blank_ratio * F.col("s")))
    ghosts = told.where("blank").select(F.round("mz", 3).alias("ghost_mz")).distinct()
    told = told.withColumn("ghost_mz", F.round("mz", 3)).join(ghosts.withColumn("is_ghost", F.lit(True)), "ghost_mz", "left")
    spread = matrix.relative_deviation(values, samples)
    rmd = chemistry.relative_mass_defect(F.col("mz"))
    return told.join(spread, "spot_id", "left").select(
        "spot_id", "blank", (F.coalesce("is_ghost", F.lit(False)) & ~F.col("blank")).alias("ghost"), chemistry.above_defect_line(F.col("mz")).alias("above_line"),
        F.coalesce(F.col("rsd") >= rsd, F.lit(False)).alias("spread"), ((rmd < defect[0]) | (rmd > defect[1])).alias("relative"))


def isotope_envelope(spectra: DataFrame, targets: DataFrame, count: int, tol: float, charge: int = 1) -> DataFrame:
    """``target_id, isotope, mz, intensity, relative``: of peaks ``mz, intensity`` (one
    spectrum), the strongest within ``tol`` of each target's M + k, relative to M; nothing
    for a target without M. Targets: ``target_id, target_mz``."""
    from ionframe.operators.rangejoin import range_join

    step = 1.0033548378 / charge
    wanted = targets.select("target_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.col("target_mz") + k * step)).alias("isotope", "goal"))
    met = range_join(spectra, wanted, "mz", "goal", tol)
    best = met.groupBy("target_id", "isotope").agg(F.max_by(F.struct("mz", "intensity"), F.struct("intensity", -F.col("mz"))).alias("p"))
    mono = best.where("isotope = 0").select("target_id", F.col("p.intensity").alias("m"))
    return best.join(mono, "target_id").select("target_id", "isotope", "p.mz", "p.intensity", (F.col("p.intensity") / F.col("m")).alias("relative"))


def abundance_links(features: DataFrame, rt_tol: float, least: float) -> DataFrame:
    """Pairs of spots ``id, rt, heights`` that elute together and whose heights over more
    than nine files correlate with ``least`` or more."""
    cell = F.floor(F.col("rt") / rt_tol)
    told = features.where(F.size("heights") > 9).select(F.struct("id", "rt", "heights").alias("f"), cell.alias("cell"))
    other = told.select(F.col("f").alias("o"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    near = told.join(other, "cell").where((F.col("f.id") < F.col("o.id")) & (F.abs(F.col("f.rt") - F.col("o.rt")) <= rt_tol))
    scored = near.select(F.col("f.id").alias("one"), F.col("o.id").alias("two"), profile_correlation(F.col("f.heights"), F.col("o.heights")).alias("correlation"))
    return scored.where(F.round("correlation", 9) >= least)


def abundance_links_sparse(features: DataFrame, values: DataFrame, runs: int, rt_tol: float, least: float) -> DataFrame:
    """The same of features ``id, rt`` with their heights above zero as ``id, file_id, height``
    rows of ``runs`` runs."""
    if runs <= 9:
        return features.sparkSession.createDataFrame([], "one long, two long, correlation double")
    return correlated_pairs(features, values, runs, rt_tol, least).where(F.round("correlation", 9) >= least)


def run_info(scans: DataFrame) -> DataFrame:
    """A row a run: scans, levels, survey and product scans, time and mass range."""
    level = F.col("ms_level")
    return scans.groupBy("file_id").agg(
        F.countDistinct("scan_id").alias("n_scans"), F.countDistinct("ms_level").alias("n_levels"), F.count(F.when(level <= 1, 1)).alias("n_survey"), F.count(F.when(level > 1, 1)).alias("n_product"),
        F.min("rt").alias("first_rt"), F.max("rt").alias("last_rt"), F.min("mz").alias("low_mz"), F.max("mz").alias("high_mz"))


def scalar_summary(values: DataFrame) -> DataFrame:
    """Each spot's mean, deviation (n - 1), upper median and range of heights."""
    ordered = F.sort_array(F.collect_list("height"))
    s = values.groupBy("spot_id").agg(F.avg("height").alias("mean"), F.stddev_samp("height").alias("deviation"), ordered.alias("o"))
    return s.select("spot_id", "mean", "deviation", F.element_at("o", (F.floor(F.size("o") / 2) + 1).cast("int")).alias("median"), (F.element_at("o", -1) - F.element_at("o", 1)).alias("range"))


def paired(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """Paired t of each spot over the pairs of files ``one, two`` in which both have a peak."""
    d = differences(values, pairs)
    s = d.groupBy("spot_id").agg(F.count("*").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("sd")).where("n > 1 and sd > 0")
    return s.select("spot_id", (F.col("n") - 1).alias("df"), (F.col("m") / (F.col("sd") / F.sqrt("n"))).alias("t"))


def differences(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """``spot_id, d``: what the first file of each pair has more than the second."""
    a, b = values.select("spot_id", F.col("file_id").alias("one"), F.col("height").alias("x")), values.select("spot_id", F.col("file_id").alias("two"), F.col("height").alias("y"))
    return a.join(pairs, "one").join(b, ["spot_id", "two"]).select("spot_id", (F.col("x") - F.col("y")).alias("d"))


def often_present(values: DataFrame, samples: DataFrame, missing: float) -> DataFrame:
    """Values of the spots that lack at most a share of the files."""
    n = samples.agg(F.count("*").alias("n"))
    kept = values.groupBy("spot_id").agg(F.count("*").alias("k")).join(F.broadcast(n)).where(F.col("n") - F.col("k") <= F.col("n") * missing)
    return values.join(kept.select("spot_id"), "spot_id", "left_semi")


def most_varied(values: DataFrame, share: float) -> DataFrame:
    """``spot_id, variation, place``: the share of spots with the largest coefficient of
    variation. Places come from counts of ranges of it, so no task orders all spots."""
    cv = values.groupBy("spot_id").agg((F.stddev_samp("height") / F.avg("height")).alias("variation")).where("variation is not null")
    binned = cv.withColumn("_bin", F.floor(F.col("variation") * 1000))
    counts = binned.groupBy("_bin").agg(F.count("*").alias("n"))
    over = Window.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    # a row a bin: some thousands
    based = counts.select("_bin", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    total = counts.agg(F.sum("n").alias("total"))
    inside = Window.partitionBy("_bin").orderBy(F.desc("variation"), "spot_id")
    placed = binned.join(based, "_bin").withColumn("place", F.row_number().over(inside) + F.col("base"))
    return placed.join(F.broadcast(total)).where(F.col("place") <= F.ceil(F.col("total") * share)).select("spot_id", "variation", "place")


def median_normalised(values: DataFrame) -> DataFrame:
    """Heights over their file's median (the lower of two), exact for files of any size.

    Counts of narrow ranges of heights say which range holds the median and how far into it;
    only that range's heights are ordered.
    """
    told = values.select("file_id", "height", F.when(F.col("height") > 0, F.floor(F.log2("height") * 1024)).otherwise(-(1 << 31)).alias("bin"))
    counts = told.groupBy("file_id", "bin").agg(F.count("*").alias("n"))
    run = Window.partitionBy("file_id")
    upto = F.sum("n").over(run.orderBy("bin"))
    at = F.ceil(F.sum("n").over(run) / 2)
    held = counts.select("file_id", "bin", (at - upto + F.col("n")).alias("place"), "n").where("place between 1 and n").drop("n")
    inside = Window.partitionBy("file_id", "bin").orderBy("height")
    ranked = told.join(held, ["file_id", "bin"]).withColumn("k", F.row_number().over(inside))
    middle = ranked.where("k = place").select("file_id", F.col("height").alias("middle"))
    return values.join(middle, "file_id").select("spot_id", "file_id", (F.col("height") / F.col("middle")).alias("value"))


def split_copies(features: DataFrame, chosen: DataFrame) -> DataFrame:
    """Features with a copy of each chosen one (``spot_id``), under new ids after the largest
    in the order of the originals, marked with where they come from."""
    top = features.agg(F.max("spot_id").alias("top"))
    # chosen by hand: few
    numbered = chosen.select("spot_id", F.row_number().over(Window.orderBy("spot_id")).alias("k"))
    copies = features.join(numbered, "spot_id").join(F.broadcast(top)).withColumn("split_from", F.col("spot_id")).withColumn("spot_id", F.col("top") + F.col("k")).drop("k", "top")
    return features.withColumn("split_from", F.lit(None).cast("long")).unionByName(copies)

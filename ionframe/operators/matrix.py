"""Feature-by-file matrix operators, in long form: ``spot_id, file_id, height``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_statistics(values: DataFrame, samples: DataFrame) -> DataFrame:
    """Average and standard deviation of each spot and class over all files of the class; a
    file without a peak counts as zero. One row a spot and class."""
    sizes = samples.groupBy("class").agg(F.count("*").alias("size"))
    met = values.join(samples.select("file_id", "class"), "file_id")
    sums = met.groupBy("spot_id", "class").agg(F.count(F.when(F.col("height") > 0, 1)).alias("n"), F.avg("height").alias("m"), F.var_pop("height").alias("v"), F.count("*").alias("k"))
    every = values.select("spot_id").distinct().join(F.broadcast(sizes))  # classes are few: one row a class
    met = every.join(sums, ["spot_id", "class"], "left").na.fill(0, ["n", "m", "v", "k"])
    # mean and spread of k heights, with size - k zeros beside them
    share, size = F.col("k") / F.col("size"), F.col("size")
    average = F.col("m") * share
    spread = (F.col("k") * F.col("v") + size * share * (1 - share) * F.col("m") * F.col("m")) / (size - 1)
    return met.select("spot_id", "class", "n", average.alias("average"), F.when(size > 1, F.sqrt(spread)).otherwise(0.0).alias("stdev"))


def detected_in(values: DataFrame, least: int) -> DataFrame:
    """Spots detected in at least ``least`` files."""
    return values.groupBy("spot_id").agg(F.count("*").alias("n_detected"), F.max("height").alias("top")).where(F.col("n_detected") >= least)


def qc_counts(values: DataFrame, samples: DataFrame) -> DataFrame:
    """``spot_id, n_qc, in_all``: the QC files that have each spot, and whether all do."""
    qc = samples.where("sample_type = 'QC'").select("file_id")
    total = qc.agg(F.count("*").alias("_all"))  # one row
    found = values.join(qc, "file_id").groupBy("spot_id").agg(F.count("*").alias("n_qc"))
    return found.join(F.broadcast(total)).select("spot_id", "n_qc", (F.col("n_qc") == F.col("_all")).alias("in_all"))


def qc_detected(values: DataFrame, samples: DataFrame) -> DataFrame:
    """Spots detected in all QC files, with their number."""
    return qc_counts(values, samples).where("in_all").drop("in_all")


def group_percent(values: DataFrame, samples: DataFrame, percent: float) -> DataFrame:
    """Spots detected in at least ``percent`` of some class's files."""
    sizes = samples.groupBy("class").agg(F.count("*").alias("n_class"))
    found = values.join(samples.select("file_id", "class"), "file_id").groupBy("spot_id", "class").agg(F.count("*").alias("n"))
    share = found.join(sizes, "class").withColumn("percent", F.col("n") * 100.0 / F.col("n_class"))
    return share.groupBy("spot_id").agg(F.max("percent").alias("best_percent")).where(F.col("best_percent") >= percent)


def blank_filter(values: DataFrame, samples: DataFrame, fold: float) -> DataFrame:
    """Spots whose mean over the samples is at least ``fold`` times their blank level; files
    without a peak count as zero.

    The level is the mean over the blanks. Where that is zero, it is a tenth of the smallest
    height below 0.0001 (zero as soon as a file has no peak), or 1 if there is none. Without
    blank files all spots stay.
    """
    kind = lambda k: F.col("sample_type") == k
    n = samples.agg(*[F.count(F.when(kind(k), 1)).alias(f"n_{k}") for k in ("Blank", "Sample")], F.count("*").alias("n_files"))
    met = values.join(samples.select("file_id", "sample_type"), "file_id").groupBy("spot_id").agg(
        *[F.sum(F.when(kind(k), F.col("height")).otherwise(0.0)).alias(k) for k in ("Blank", "Sample")],
        F.min(F.when(F.col("height") < 0.0001, F.col("height"))).alias("tiny"), F.count("*").alias("k"))
    met = met.join(F.broadcast(n))  # one row
    nothing = F.when(F.col("k") < F.col("n_files"), 0.0).otherwise(F.coalesce(F.col("tiny") * 0.1, F.lit(1.0)))
    level = F.when(F.col("Blank") > 0, F.col("Blank") / F.col("n_Blank")).otherwise(nothing)
    mean = F.when(F.col("n_Sample") > 0, F.col("Sample") / F.col("n_Sample")).otherwise(0.0)
    made = met.select("spot_id", mean.alias("sample_mean"), F.when(F.col("n_Blank") > 0, level).alias("blank_level"))
    return made.where(F.col("blank_level").isNull() | (F.col("sample_mean") >= fold * F.col("blank_level")))


def relative_deviation(values: DataFrame, samples: DataFrame) -> DataFrame:
    """The smallest class RSD (per cent) of each spot, blanks left out; files without a peak
    count as zero, classes of one file or without any peak have no RSD."""
    known = samples.where("sample_type != 'Blank'")
    sizes = known.groupBy("class").agg(F.count("*").alias("size")).where("size > 1").select("class")
    stats = class_statistics(values, known).join(F.broadcast(sizes), "class", "left_semi").where("average > 0")
    return stats.groupBy("spot_id").agg(F.min(F.col("stdev") * 100 / F.col("average")).alias("rsd"))


def qc_variation(values: DataFrame, samples: DataFrame) -> DataFrame:
    """Coefficient of variation over the QC files."""
    met = values.join(samples.where("sample_type = 'QC'").select("file_id"), "file_id")
    return met.groupBy("spot_id").agg(F.count("*").alias("n_qc"), (F.stddev_samp("height") / F.avg("height") * 100).alias("cv_percent")).where("n_qc > 1")


def total_normalised(values: DataFrame) -> DataFrame:
    """Heights over their file's total."""
    total = values.groupBy("file_id").agg(F.sum("height").alias("total"))
    return values.join(total, "file_id").select("spot_id", "file_id", (F.col("height") / F.col("total")).alias("value"))


def pqn_factors(values: DataFrame) -> DataFrame:
    """Probabilistic quotient factors: median ratio to the median profile, by file."""
    profile = values.groupBy("spot_id").agg(F.median("height").alias("reference"))
    return values.join(profile, "spot_id").where("reference > 0").groupBy("file_id").agg(F.median(F.col("height") / F.col("reference")).alias("factor"), F.count("*").alias("n"))


def scaled(values: DataFrame) -> DataFrame:
    """log10, centred and divided by the standard deviation within each spot."""
    log = values.where("height > 0").withColumn("v", F.log10("height"))
    spot = log.groupBy("spot_id").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd")).where("sd > 1e-9")
    return log.join(spot, "spot_id").select("spot_id", "file_id", ((F.col("v") - F.col("mean")) / F.col("sd")).alias("z"))


def imputed(values: DataFrame, spots: DataFrame, samples: DataFrame) -> DataFrame:
    """The dense matrix; what is missing gets the spot's smallest positive height (1: none).

    A spot's heights travel as one map by file and are expanded over the files, which are
    written into the plan as one array, so the dense rows are made last and never shuffled.
    """
    files = samples.agg(F.sort_array(F.collect_set("file_id")).alias("files"))
    pair = F.struct("file_id", "height")
    held = values.where("height > 0").groupBy("spot_id").agg(F.map_from_entries(F.collect_list(pair)).alias("held"), F.min("height").alias("least"))
    dense = spots.select("spot_id").distinct().join(held, "spot_id", "left").join(F.broadcast(files)).select("spot_id", "held", "least", F.explode("files").alias("file_id"))
    return dense.select("spot_id", "file_id", F.coalesce(F.try_element_at("held", "file_id"), "least", F.lit(1.0)).alias("value"))


def imputed_totals(values: DataFrame, spots: DataFrame, samples: DataFrame) -> DataFrame:
    """Sum and number of the dense matrix's values of each spot, without making its rows."""
    n = samples.agg(F.countDistinct("file_id").alias("n"))
    known = values.join(samples.select("file_id").distinct(), "file_id", "left_semi")
    held = values.where("height > 0").groupBy("spot_id").agg(F.min("height").alias("least"))
    sums = known.where("height > 0").groupBy("spot_id").agg(F.sum("height").alias("sum"), F.count("*").alias("k"))
    met = spots.select("spot_id").distinct().join(held, "spot_id", "left").join(sums, "spot_id", "left").na.fill(0, ["sum", "k"]).join(F.broadcast(n))
    return met.select("spot_id", (F.col("sum") + (F.col("n") - F.col("k")) * F.coalesce("least", F.lit(1.0))).alias("total"), "n")


def long_export(values: DataFrame, samples: DataFrame) -> DataFrame:
    """The long value table: id, file, class, value."""
    return values.join(samples.select("file_id", "file_name", "class"), "file_id").select(F.col("spot_id").alias("id"), F.col("file_name").alias("file"), "class", "height", "area")


#: Fields of a matrix line before its values (fixed values).
MATRIX_FIELDS = ("Alignment ID", "Name", "RT (min)", "m/z", "Adduct", "Ontology", "Fill %")


def matrix_lines(features: DataFrame, values: DataFrame, samples: DataFrame) -> DataFrame:
    """``spot_id, line``: tab-separated text of each feature, its heights in all files in the
    order of ids, then its areas, whole numbers, 0 where a file lacks it. A line is as long as
    there are files, but only its peaks are gone through: what lies between them is repeated text."""
    files = samples.select("file_id").where("file_id is not null").distinct()
    # a row a file
    places = files.select("file_id", (F.row_number().over(Window.orderBy("file_id")) - 1).alias("at"))
    n = files.agg(F.count("*").cast("int").alias("n"))
    held = values.join(places, "file_id", "left").groupBy("spot_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "height", "area")))).alias("peaks"), F.count("*").alias("k"))
    told = features.join(held, "spot_id", "left").join(F.broadcast(n)).withColumn("peaks", F.coalesce("peaks", F.array().cast("array<struct<at:int,height:double,area:double>>")))

    def whole(c: str) -> Column:
        number = lambda p: F.format_string("%.0f", F.coalesce(p[c], F.lit(0.0)))
        gap = lambda p, k: F.repeat(F.lit("0\t"), p["at"] - 1 - F.coalesce(F.get("peaks", k - 1)["at"], F.lit(-1)))
        last = F.coalesce(F.get("peaks", F.size("peaks") - 1)["at"], F.lit(0))
        some = F.array_join(F.transform("peaks", lambda p, k: F.concat(gap(p, k), number(p))), "\t")
        return F.when(F.col("n") > 0, F.concat(F.when(F.size("peaks") > 0, some).otherwise("0"), F.repeat(F.lit("\t0"), F.col("n") - 1 - last))).otherwise("")

    fill = F.when(F.col("n") > 0, F.coalesce("k", F.lit(0)) * 100.0 / F.nullif("n", F.lit(0)))
    fields = [F.col("spot_id").cast("string"), F.col("name"), F.format_string("%.3f", "rt"), F.format_string("%.5f", "mz"), F.col("adduct"), F.col("ontology"), F.format_string("%.0f", fill)]
    return told.select("spot_id", F.concat_ws("\t", *[F.coalesce(f, F.lit("")) for f in fields], whole("height"), whole("area")).alias("line"))


def matrix_header(samples: DataFrame) -> DataFrame:
    """``line``: the names of a matrix's columns."""
    names = samples.agg(F.transform(F.sort_array(F.collect_list(F.struct("file_id", "file_name"))), lambda f: f["file_name"]).alias("names"))
    of = lambda kind: F.array_join(F.transform("names", lambda n: F.concat(n, F.lit(f" {kind}"))), "\t")
    return names.select(F.concat_ws("\t", *[F.lit(f) for f in MATRIX_FIELDS], of("height"), of("area")).alias("line"))


#: Columns that a wide table may have beside its id.
MOST_CLASSES = 1000


def wide_export(values: DataFrame, samples: DataFrame) -> DataFrame:
    """One row a spot, one average column a class (over all files of the class)."""
    classes = [r[0] for r in samples.select("class").distinct().orderBy("class").limit(MOST_CLASSES + 1).collect()]
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes: use the long table")
    stats = class_statistics(values, samples)
    return stats.groupBy("spot_id").pivot("class", classes).agg(F.first("average")).select("spot_id", *[F.col(f"`{c}`").alias(f"class_{c}") for c in classes])


def last_state(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Current state of an event log: the last value of each key."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("state"), F.count("*").alias("n_events"))


def ranked(values: DataFrame, by: str, col: str) -> DataFrame:
    """Adds ``mid_rank`` of ``col`` within ``by``: ties share their mean rank."""
    w = Window.partitionBy(by)
    return values.withColumn("mid_rank", F.rank().over(w.orderBy(col)) + (F.count("*").over(Window.partitionBy(by, col)) - 1) / 2)


def pareto_scaled(values: DataFrame) -> DataFrame:
    """log10, centred and divided by the root of the standard deviation within each spot."""
    log = values.where("height > 0").withColumn("v", F.log10("height"))
    spot = log.groupBy("spot_id").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd")).where("sd > 1e-9")
    return log.join(spot, "spot_id").select("spot_id", "file_id", ((F.col("v") - F.col("mean")) / F.sqrt("sd")).alias("z"))


def box_plots(values: DataFrame, samples: DataFrame) -> DataFrame:
    """Smallest, quartiles and largest of each spot and class; a group is one spot's files."""
    met = values.join(samples.select("file_id", "class"), "file_id")
    quartiles = [F.percentile("height", p).alias(n) for p, n in ((0.25, "lower"), (0.5, "middle"), (0.75, "upper"))]
    return met.groupBy("spot_id", "class").agg(F.min("height").alias("least"), *quartiles, F.max("height").alias("most"))


def relative_amplitudes(values: DataFrame) -> DataFrame:
    """log2 of each spot's largest height, scaled to 0..1 between the logarithms of the
    smallest and largest height of all spots (0 and 1 where these are not above 1)."""
    spots = values.groupBy("spot_id").agg(F.max("height").alias("top"), F.min("height").alias("low"))
    lo, hi = F.min("low"), F.max("top")
    span = spots.agg(F.when(lo > 1, F.log2(lo)).otherwise(0.0).alias("lo"), F.when(hi > 1, F.log2(hi)).otherwise(1.0).alias("hi"))
    amplitude = (F.log2("top") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return spots.join(F.broadcast(span)).select("spot_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), amplitude)).alias("amplitude"))


def state_without(events: DataFrame, undone: DataFrame, event: str, key: str, order: list[str], value: str) -> DataFrame:
    """Current state of an event log without the events that were undone."""
    return last_state(events.join(undone.select(event).distinct(), event, "left_anti"), key, order, value)


"""Quantities of a feature-by-file matrix: normalisation, drift, shares, summaries.

Input rows: values ``spot_id, file_id, height`` (detected peaks), samples ``file_id, class,
sample_type, injection_order, batch``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_mean(height: Column) -> Column:
    """Mean whose sum has no rounding, so that it is the same in any order of the rows: heights
    to ten digits after the point; the plain mean where one does not fit a decimal."""
    whole = height.try_cast("decimal(28,10)")
    summed = F.try_divide(F.try_sum(whole).cast("double"), F.count(height))
    return F.when((F.count(height) > 0) & (F.count(whole) == F.count(height)), F.coalesce(summed, F.avg(height))).otherwise(F.avg(height))


def representative(values: DataFrame, samples: DataFrame) -> DataFrame:
    """Each spot's file with the tallest peak (ties: the smaller id), mean, smallest and
    largest height of its peaks, and the share of files that have one."""
    n = samples.agg(F.count("*").alias("n"))
    made = values.groupBy("spot_id").agg(
        F.max_by("file_id", F.struct("height", -F.col("file_id"))).alias("representative"), exact_mean(F.col("height")).alias("mean"), F.min("height").alias("low"), F.max("height").alias("high"), F.count("*").alias("k"))
    return made.join(F.broadcast(n)).select("spot_id", "representative", "mean", "low", "high", (F.col("k") / F.col("n")).alias("fill"))  # n: one row


def filled(values: DataFrame, samples: DataFrame, share: float = 0.1) -> DataFrame:
    """The dense matrix, missing or zero heights as a share of the spot's smallest positive one."""
    files = samples.agg(F.sort_array(F.collect_set("file_id")).alias("files"))
    held = values.where("height > 0").groupBy("spot_id").agg(F.map_from_entries(F.collect_list(F.struct("file_id", "height"))).alias("held"), F.min("height").alias("least"))
    dense = held.join(F.broadcast(files)).select("spot_id", "held", "least", F.explode("files").alias("file_id"))
    return dense.select("spot_id", "file_id", F.coalesce(F.try_element_at("held", "file_id"), F.col("least") * share).alias("value"))


def class_standards(values: DataFrame, features: DataFrame) -> DataFrame:
    """``ontology, standard_id``: the feature with the largest mean height of each class."""
    mean = values.groupBy("spot_id").agg(F.avg("height").alias("mean"))
    return features.select("spot_id", "ontology").join(mean, "spot_id").groupBy("ontology").agg(F.max_by("spot_id", F.struct("mean", -F.col("spot_id"))).alias("standard_id"))


def _with_standard(values: DataFrame, features: DataFrame, standards: DataFrame) -> DataFrame:
    own = features.select("spot_id", "ontology").join(standards, "ontology")
    met = values.join(own, "spot_id")
    return met.join(values.select(F.col("spot_id").alias("standard_id"), "file_id", F.col("height").alias("base")), ["standard_id", "file_id"], "left")


def standard_normalised(values: DataFrame, features: DataFrame, standards: DataFrame, concentration: float) -> DataFrame:
    """Concentration of the internal standard times height over the standard's height in the
    file (1 where that has no peak)."""
    base = F.when(F.col("base") > 0, F.col("base")).otherwise(1.0)
    return _with_standard(values, features, standards).select("spot_id", "file_id", (concentration * F.col("height") / base).alias("value"))


def relative_abundance(values: DataFrame, features: DataFrame, standards: DataFrame) -> DataFrame:
    """Analyte over its class's standard, file by file, where both have a peak; standards
    themselves stay out."""
    met = _with_standard(values, features, standards).where("spot_id != standard_id and height > 0 and base > 0")
    return met.select("spot_id", "file_id", (F.col("height") / F.col("base")).alias("value"))


def named_total_normalised(values: DataFrame, named: DataFrame) -> DataFrame:
    """Heights over the total of the file's identified features (``spot_id``)."""
    total = values.join(named.select("spot_id").distinct(), "spot_id", "left_semi").groupBy("file_id").agg(F.sum("height").alias("total"))
    return values.join(total, "file_id").select("spot_id", "file_id", (F.col("height") / F.col("total")).alias("value"))


def loess(points: Column, at: Column, span: float) -> Column:
    """Local line at ``at`` through the nearest share of ``points`` (array of ``x, y``, three
    at least), weighted by the tricube of their distance; their mean where all lie at it."""
    n = F.size(points)
    placed = F.array_sort(F.transform(points, lambda p, k: F.struct(F.abs(p["x"] - at).alias("d"), k.alias("k"), p["x"].alias("x"), p["y"].alias("y"))))
    held = F.slice(placed, F.lit(1), F.least(n, F.greatest(F.lit(3), F.ceil(n * span).cast("int"))))
    zeros = F.struct(*[F.lit(0.0).alias(c) for c in ("w", "wx", "wy", "wxx", "wxy", "plain")])

    def add(s: Column, p: Column) -> Column:
        w = F.when(p["far"] > 0, F.pow(1 - F.pow(p["d"] / p["far"], F.lit(3)), F.lit(3))).otherwise(0.0)
        more = {"w": w, "wx": w * p["x"], "wy": w * p["y"], "wxx": w * p["x"] * p["x"], "wxy": w * p["x"] * p["y"], "plain": p["y"]}
        return F.struct(*[(s[c] + v).alias(c) for c, v in more.items()])

    def fitted(near: Column, far: Column) -> Column:
        told = F.transform(near, lambda p: F.struct(p["d"].alias("d"), p["x"].alias("x"), p["y"].alias("y"), far.alias("far")))
        return F.aggregate(told, zeros, add, lambda s: line(s, far, F.size(near)))

    def line(s: Column, far: Column, size: Column) -> Column:
        flat = s["w"] * s["wxx"] - s["wx"] * s["wx"]
        slope = (s["w"] * s["wxy"] - s["wx"] * s["wy"]) / flat
        fit = F.when(F.abs(flat) < 1e-12, s["wy"] / s["w"]).otherwise((s["wy"] - slope * s["wx"]) / s["w"] + slope * at)
        return F.when(far <= 0, s["plain"] / size).when(s["w"] <= 0, F.aggregate(points, F.lit(0.0), lambda t, p: t + p["y"]) / n).otherwise(fit)

    # bound to names, or the neighbours would be sorted anew for every one of them
    return F.element_at(F.transform(F.array(held), lambda near: F.element_at(F.transform(F.array(F.element_at(near, -1)["d"]), lambda far: fitted(near, far)), 1)), 1)


def drift_corrected(values: DataFrame, samples: DataFrame, span: float = 0.75, least: int = 3) -> DataFrame:
    """``spot_id, file_id, value, corrected``: heights over the drift that the quality
    controls of a batch show, times their overall mean.

    With fewer than ``least`` QC files in all, or three QC peaks of a spot, nothing changes; a batch
    with one or two is levelled by their mean, one without stays; so does a value whose
    fitted drift is not positive.
    """
    order = F.col("injection_order").cast("double")
    known = samples.select("file_id", "batch", order.alias("x"), (F.col("sample_type") == "QC").alias("qc"))
    enough = known.agg((F.count(F.when(F.col("qc"), 1)) >= least).alias("enough"))
    met = values.join(known, "file_id")
    qc = met.where("qc and height > 0")
    batch = qc.groupBy("spot_id", "batch").agg(F.sort_array(F.collect_list(F.struct("x", F.col("height").alias("y")))).alias("points"))
    spot = qc.groupBy("spot_id").agg(F.avg("height").alias("mean"), F.count("*").alias("n")).where("n >= 3").drop("n")
    both = met.join(spot, "spot_id", "left").join(batch, ["spot_id", "batch"], "left").join(F.broadcast(enough))
    level = F.aggregate("points", F.lit(0.0), lambda s, p: s + p["y"]) / F.size("points")
    fit = F.when(F.size("points") < 3, level).otherwise(loess(F.col("points"), F.col("x"), span))
    usable = F.col("enough") & F.col("mean").isNotNull() & F.col("points").isNotNull()
    return both.withColumn("fit", F.when(usable, fit)).select("spot_id", "file_id", F.col("height").alias("value"), F.when(F.col("fit") > 0, F.col("height") / F.col("fit") * F.col("mean")).otherwise(F.col("height")).alias("corrected"))


def fold_changes(values: DataFrame, groups: DataFrame) -> DataFrame:
    """``spot_id, log2_fold``: mean height of group 1 over group 2 (``file_id, grp``)."""
    per = lambda g: F.avg(F.when(F.col("grp") == g, F.col("height")))
    means = values.join(groups, "file_id").groupBy("spot_id").agg(per(1).alias("a"), per(2).alias("b")).where("a > 0 and b > 0")
    return means.select("spot_id", F.log2(F.col("a") / F.col("b")).alias("log2_fold"))


def class_changes(folds: DataFrame, classes: DataFrame) -> DataFrame:
    """Shift of each class (``spot_id, class``): members, mean log2 fold change, how many rose
    and fell, and t of the mean against zero (0 where it has no spread)."""
    made = folds.join(classes, "spot_id").groupBy("class").agg(
        F.count("*").alias("members"), F.avg("log2_fold").alias("mean"), F.count(F.when(F.col("log2_fold") > 0, 1)).alias("up"), F.count(F.when(F.col("log2_fold") < 0, 1)).alias("down"), F.stddev_samp("log2_fold").alias("sd"))
    t = F.when((F.col("members") > 1) & (F.col("sd") > 0), F.col("mean") / (F.col("sd") / F.sqrt("members"))).otherwise(0.0)
    return made.select("class", "members", "mean", "up", "down", t.alias("t"))


def enriched(hits: DataFrame, members: DataFrame, least: int = 3) -> DataFrame:
    """``ontology, n_set, n_hit, expected, ratio, n_all, n_hits`` of the sets of ``least``
    members or more."""
    from ionframe.operators.statistics import enrichment_counts

    counts = enrichment_counts(hits, members, least)
    expected = F.col("n_hits") * F.col("n_set") / F.col("n_all")
    return counts.select("ontology", "n_set", "n_hit", expected.alias("expected"), F.when(expected > 0, F.col("n_hit") / expected).otherwise(0.0).alias("ratio"), "n_all", "n_hits")


def amplitude_order(fragments: DataFrame) -> DataFrame:
    """Rising rank of each peak's intensity in its spectrum from 0, and as a share."""
    w = Window.partitionBy("spectrum_id").orderBy("intensity", "mz")
    placed = fragments.withColumns({"order": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("spectrum_id"))})
    return placed.select("spectrum_id", "mz", "order", F.when(F.col("n") > 1, F.col("order") / (F.col("n") - 1)).otherwise(0.0).alias("score"))


def kendall(values: DataFrame, profile: DataFrame) -> DataFrame:
    """Kendall's tau-b of each spot's heights against a profile ``file_id, x``.

    A spot's pairs are counted inside one array of its files."""
    held = values.join(profile, "file_id").groupBy("spot_id").agg(F.collect_list(F.struct("x", F.col("height").alias("y"))).alias("p"))
    sign = lambda v: F.signum(v)
    over = lambda f: F.aggregate("p", F.lit(0.0), lambda s, a: s + F.aggregate("p", F.lit(0.0), lambda t, b: t + f(a, b)))
    same = over(lambda a, b: sign(a["x"] - b["x"]) * sign(a["y"] - b["y"]))
    in_x, in_y = over(lambda a, b: F.abs(sign(a["x"] - b["x"]))), over(lambda a, b: F.abs(sign(a["y"] - b["y"])))
    return held.where((F.size("p") > 2) & (in_x > 0) & (in_y > 0)).select("spot_id", (same / F.sqrt(in_x * in_y)).alias("tau"))


def student(values: DataFrame, group: str = "grp") -> DataFrame:
    """Student's t with pooled variance between groups 1 and 2 of each spot."""
    per = lambda f, g: f(F.when(F.col(group) == g, F.col("height")))
    s = values.groupBy("spot_id").agg(*[per(f, g).alias(f"{n}{g}") for g in (1, 2) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]).where("n1 > 1 and n2 > 1")
    df = F.col("n1") + F.col("n2") - 2
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / df
    return s.where(pooled > 0).select("spot_id", ((F.col("m1") - F.col("m2")) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))).alias("t"), df.alias("df"))


def two_way(values: DataFrame, one: str, two: str) -> DataFrame:
    """Two-way analysis of variance of each spot without interaction, type II: F of both
    factors by the residual sums of nested models. Factors have two levels (0, 1) each, so
    all models follow from sums that combine map-side."""
    a, b, y = F.col(one).cast("double"), F.col(two).cast("double"), F.col("height").cast("double")
    s = values.groupBy("spot_id").agg(
        F.count("*").cast("double").alias("n"), F.var_pop(y).alias("vy"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), F.covar_pop(a, b).alias("ab"), F.covar_pop(a, y).alias("ay"), F.covar_pop(b, y).alias("by"))
    c = {k: F.col(k) for k in ("n", "vy", "va", "vb", "ab", "ay", "by")}
    det = c["va"] * c["vb"] - c["ab"] * c["ab"]
    explained = (c["ay"] * c["ay"] * c["vb"] - 2 * c["ay"] * c["by"] * c["ab"] + c["by"] * c["by"] * c["va"]) / det
    rest = (c["vy"] - explained) * c["n"]
    alone_a, alone_b = c["ay"] * c["ay"] / c["va"], c["by"] * c["by"] / c["vb"]
    df = c["n"] - 3
    f = lambda part: part * c["n"] / (rest / df)
    return s.where((df > 0) & (det > 1e-12)).where(rest > 1e-9).select("spot_id", f(explained - alone_b).alias("f_one"), f(explained - alone_a).alias("f_two"), df.cast("long").alias("df"))


def contour_slices(grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sums of a contour grid's rows and columns."""
    side = lambda c: grid.groupBy(F.col(c).alias("place")).agg(F.sum("intensity").alias("total"))
    return side("row"), side("bin")


def grid_percentile(grid: DataFrame, percent: float) -> DataFrame:
    """Nearest-rank percentile of a grid's positive cells."""
    positive = grid.where("intensity > 0")
    n = positive.agg(F.greatest(F.lit(1), F.ceil(F.count("*") * percent / 100)).alias("rank"))
    # a grid has a fixed number of cells, whatever the data
    return positive.withColumn("k", F.row_number().over(Window.orderBy("intensity"))).join(F.broadcast(n)).where("k = rank").select(F.col("intensity").alias("level"))

"""Ordered-frame operators over chromatograms ``file_id, rt, intensity``.

All frames are partitioned by run, so their size is that of one run's trace.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Symmetric smoothing weights, middle first (fixed values): the second-order
#: five-point polynomial filter.
SAVITZKY_GOLAY_5 = (17.0, 12.0, -3.0)
#: A retention ladder has one rung a carbon number; more is a mistake in the input.
MOST_RUNGS = 500


def _in_run() -> Window:
    return Window.partitionBy("file_id").orderBy("rt")


def smoothed(trace: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Weighted moving average; at a run's ends the weights that are left are renormalised."""
    w = _in_run()
    total, share = F.col("intensity") * weights[0], F.lit(weights[0])
    for k, weight in enumerate(weights[1:], 1):
        for near in (F.lag("intensity", k).over(w), F.lead("intensity", k).over(w)):
            total = total + F.coalesce(near * weight, F.lit(0.0))
            share = share + F.when(near.isNotNull(), weight).otherwise(0.0)
    return trace.select("file_id", "rt", "intensity", (total / share).alias("smooth"))


def linear_weights(reach: int) -> tuple[float, ...]:
    """Linearly falling weights over ``reach`` scans on both sides."""
    return tuple(float(reach + 1 - k) for k in range(reach + 1))


def numbered(trace: DataFrame, reach: int = 2) -> DataFrame:
    """A trace's points with their place and neighbours: ``at``, and time and intensity
    up to ``reach`` points before (b) and after (a)."""
    w = _in_run()
    near = {f"{c}_{n}{k}": f(c, k).over(w) for c in ("rt", "intensity") for n, f in (("b", F.lag), ("a", F.lead)) for k in range(1, reach + 1)}
    return trace.select("file_id", "rt", "intensity").withColumns({"at": F.row_number().over(w)} | near)


def peak_summary(trace: DataFrame) -> DataFrame:
    """The highest peak of each run: apex, bounds, area, width, signal to noise.

    From the apex outward a bound is the first point at or below 5 % of it, or the point
    before a rise of 10 % of the apex above the lowest point passed. Area is in intensity
    x minutes, the width is at half height between linear crossings; runs without a
    positive point have no row.
    """
    run = Window.partitionBy("file_id")
    points = _with_noise(numbered(trace, 1))
    top = F.max(F.struct("intensity", (-F.col("at")).alias("first"))).over(run)
    points = points.withColumn("_top", top).select("*", F.col("_top.intensity").alias("top"), (-F.col("_top.first")).alias("apex")).drop("_top").where("top > 0")
    points = points.withColumns({"side": F.signum(F.col("at") - F.col("apex")), "away": F.abs(F.col("at") - F.col("apex"))})
    passed = Window.partitionBy("file_id", "side").orderBy("away").rowsBetween(Window.unboundedPreceding, -1)
    valley = F.coalesce(F.min("intensity").over(passed), F.col("top"))
    y, top_ = F.col("intensity"), F.col("top")
    edge = F.when(F.col("side") == 0, None).when(y <= top_ * 0.05, F.col("at")).when(y > valley + top_ * 0.1, F.col("at") - F.col("side"))
    points = points.withColumn("edge", edge.cast("int"))
    first = lambda side: F.min_by("edge", F.when((F.col("side") == side) & F.col("edge").isNotNull(), F.col("away"))).over(run)
    met = points.withColumns({"left": F.coalesce(first(-1), F.min("at").over(run)), "right": F.coalesce(first(1), F.max("at").over(run))})
    inside = (F.col("at") >= F.col("left")) & (F.col("at") < F.col("right"))
    piece = (F.col("rt_a1") - F.col("rt")) * (y + F.col("intensity_a1")) / 2
    low = y <= top_ / 2
    on_left = low & (F.col("at") >= F.col("left")) & (F.col("at") < F.col("apex"))
    on_right = low & (F.col("at") > F.col("apex")) & (F.col("at") <= F.col("right"))
    at = lambda place, c: F.max(F.when(F.col("at") == F.col(place), F.col(c)))
    summed = met.groupBy("file_id").agg(
        F.first("left").alias("l"), F.first("right").alias("r"), at("apex", "rt").alias("apex_rt"), F.first("top").alias("apex_intensity"),
        at("left", "rt").alias("rt_left"), at("right", "rt").alias("rt_right"), F.coalesce(F.sum(F.when(inside, piece)), F.lit(0.0)).alias("area"),
        F.max_by(_crossing("", "_a1"), F.when(on_left, F.col("at"))).alias("half_left"),
        F.min_by(_crossing("_b1", ""), F.when(on_right, F.col("at"))).alias("half_right"), F.first("noise").alias("noise"))
    return summed.select(
        "file_id", (F.col("r") - F.col("l") + 1).cast("long").alias("n_points"), "apex_rt", "apex_intensity", "rt_left", "rt_right", "area",
        (F.col("half_right") - F.col("half_left")).alias("fwhm"), "noise", (F.col("apex_intensity") / F.col("noise")).alias("snr"))


def _crossing(one: str, two: str) -> Column:
    """Where the line between two neighbours crosses half the apex (both equal: halfway)."""
    t0, t1, y0, y1 = F.col(f"rt{one}"), F.col(f"rt{two}"), F.col(f"intensity{one}"), F.col(f"intensity{two}")
    return F.when(F.abs(y1 - y0) < 1e-12, (t0 + t1) / 2).otherwise(t0 + (F.col("top") / 2 - y0) / (y1 - y0) * (t1 - t0))


def _with_noise(trace: DataFrame) -> DataFrame:
    """A trace with ``n``, its points in the run, and the run's ``noise``; all frames are
    those of runs, so nothing is shuffled again."""
    run = Window.partitionBy("file_id")
    points = trace.withColumns({"step": F.abs(F.col("intensity") - F.lag("intensity").over(_in_run())), "k": F.row_number().over(run.orderBy("intensity")), "n": F.count("*").over(run)})
    points = points.withColumn("centre", F.median("step").over(run))
    points = points.withColumns({
        "mad": F.median(F.abs(F.col("step") - F.col("centre"))).over(run),
        "lower": F.stddev_samp(F.when(F.col("k") <= F.greatest(F.lit(2), F.floor(F.col("n") / 2)), F.col("intensity"))).over(run)})
    robust = F.when((F.col("centre") > 0) & (F.col("mad") > 0), F.col("mad") * 1.4826 / F.sqrt(F.lit(2.0)))
    noise = F.when(F.col("n") >= 3, F.coalesce(robust, F.when(F.col("lower") > 0, F.col("lower"))))
    return points.withColumn("noise", noise).drop("step", "k", "centre", "mad", "lower")


def automatic_noise(trace: DataFrame) -> DataFrame:
    """``file_id, noise`` of runs with three points or more: median absolute deviation of
    the steps between points, as a standard deviation of one point; where that is zero, the
    standard deviation of the lower half of the points; null where that is zero too.

    Medians are exact: a trace has one point a scan, so a run's steps fit one buffer.
    """
    return _with_noise(trace.select("file_id", "rt", "intensity")).where("n >= 3").groupBy("file_id").agg(F.first("noise").alias("noise"))


def manual_noise(trace: DataFrame, rt_from: float, rt_to: float) -> DataFrame:
    """Noise of a stretch of each run's trace, peak to peak and as a standard deviation;
    null with fewer than two points or where it is zero."""
    inside = trace.where(F.col("rt").between(min(rt_from, rt_to), max(rt_from, rt_to)))
    swing, sd = F.max("intensity") - F.min("intensity"), F.stddev_samp("intensity")
    made = inside.groupBy("file_id").agg(F.count("*").alias("n_points"), swing.alias("swing"), sd.alias("sd"))
    return made.select("file_id", "n_points", *[F.when((F.col("n_points") > 1) & (F.col(c) > 0), F.col(c)).alias(n) for c, n in (("swing", "peak_to_peak"), ("sd", "deviation"))])


def is_apex() -> Column:
    """Over ``numbered`` points: two rises (or levels) before and a fall after, or a rise
    before and two falls (or levels) after, with two points on either side."""
    y, b1, b2, a1, a2 = (F.col(f"intensity{n}") for n in ("", "_b1", "_b2", "_a1", "_a2"))
    rising = (b2 <= b1) & (b1 <= y) & (y > a1)
    falling = (b1 < y) & (y >= a1) & (a1 >= a2)
    return b2.isNotNull() & a2.isNotNull() & (rising | falling)


def nearest_apex(points: DataFrame, centre: float, reach: float) -> DataFrame:
    """The apex next to ``centre`` in each run of ``numbered`` points, within ``reach``
    (ties: the earlier)."""
    away = F.abs(F.col("rt") - centre)
    found = points.where(is_apex() & (away <= reach))
    best = found.groupBy("file_id").agg(F.min_by(F.struct("at", "rt", "intensity"), F.struct(away, F.col("rt"))).alias("p"), F.count("*").alias("n_apexes"))
    return best.select("file_id", "n_apexes", "p.at", "p.rt", "p.intensity")


def kovats(points: DataFrame, ladder: DataFrame) -> DataFrame:
    """Retention index by the alkane ladder ``carbon, ladder_rt``: linear between the two
    rungs beside a point, and outside the ladder on the line through its first and last
    rung. The ladder's size is checked; it becomes an array literal, so the points are not
    shuffled."""
    rungs = ladder.orderBy("ladder_rt").limit(MOST_RUNGS + 1).collect()
    if not 2 <= len(rungs) <= MOST_RUNGS:
        raise ValueError(f"a ladder needs 2 to {MOST_RUNGS} rungs")
    times, carbons = F.lit([float(r["ladder_rt"]) for r in rungs]), F.lit([float(r["carbon"]) for r in rungs])
    n = len(rungs)
    below = F.size(F.filter(times, lambda t: t <= F.col("rt")))
    outside = (below == 0) | (below == n)
    low, high = F.when(outside, 1).otherwise(below), F.when(outside, n).otherwise(below + 1)
    t0, t1, c0, c1 = F.element_at(times, low), F.element_at(times, high), F.element_at(carbons, low), F.element_at(carbons, high)
    return points.withColumn("retention_index", (c0 + (c1 - c0) * (F.col("rt") - t0) / (t1 - t0)) * 100)


def rt_corrected(points: DataFrame, anchors: DataFrame, least_step: float = 1e-5) -> DataFrame:
    """``file_id, rt, corrected``: times less a shift between a run's anchors ``file_id, rt,
    shift``; the shift stays level before the first anchor (from time 0) and after the last.

    The knots are walked as the points go by: a point at or past the next knot takes that
    knot's shift and moves on by one knot only, others are interpolated in the present
    stretch. Corrected times always rise, by ``least_step`` at least. Both are states that
    pass from point to point, so a run's points and its anchors meet in one group, the size
    of one run; runs without anchors stay as they are.
    """

    def run(key: tuple, own: pa.Table, knots: pa.Table) -> pa.Table:
        x = np.sort(np.array(own["rt"].to_pylist(), float))
        shift = np.zeros(len(x))
        if knots.num_rows and len(x):
            told = sorted(zip(knots["rt"].to_pylist(), knots["shift"].to_pylist(), strict=True))
            at, y = [0.0, *(k for k, _ in told), x[-1]], [told[0][1], *(s for _, s in told), told[-1][1]]
            i = 0
            for k, now in enumerate(x.tolist()):
                if now >= at[i + 1] and i < len(at) - 2:
                    shift[k], i = y[i + 1], i + 1
                else:
                    width = at[i + 1] - at[i]
                    shift[k] = y[i] + (now - at[i]) / width * (y[i + 1] - y[i]) if width else y[i]
        before, out = 0.0, []
        for now in (x - shift).tolist():
            before = now if now > before else before + least_step
            out.append(before)
        return pa.table({"file_id": pa.array([key[0].as_py()] * len(x), pa.int64()), "rt": pa.array(x, pa.float64()), "corrected": pa.array(out, pa.float64())})

    left = points.select("file_id", "rt").distinct()
    right = anchors.select("file_id", "rt", "shift").toDF("of_file", "rt", "shift")  # names of its own beside the points
    return left.groupBy("file_id").cogroup(right.groupBy("of_file")).applyInArrow(run, "file_id long, rt double, corrected double")


def recalibration(pairs: DataFrame, observed: str, reference: str, least: int = 20) -> DataFrame:
    """Straight line of observed on library times; no row with fewer than ``least`` pairs."""
    return pairs.agg(F.count("*").alias("n"), F.regr_slope(observed, reference).alias("slope"), F.regr_intercept(observed, reference).alias("intercept"), F.regr_r2(observed, reference).alias("r2")).where(F.col("n") >= least)


def gaps_filled(trace: DataFrame, centre: float, reach: float) -> DataFrame:
    """The peak next to ``centre`` in each run, measured as a filled gap.

    From two points beside the apex the walk goes down to the local minimum on both sides;
    a higher apex inside takes over. Areas are in intensity x seconds.
    """
    run = Window.partitionBy("file_id")
    y, b1, a1 = (F.col(f"intensity{n}") for n in ("", "_b1", "_a1"))
    away = F.abs(F.col("rt") - centre)
    near = F.when(is_apex() & (away <= reach), F.struct(away, F.col("rt")))
    met = numbered(trace).withColumns({"id": F.min_by("at", near).over(run), "was": F.min_by("intensity", near).over(run)}).where("id is not null")
    left = F.max(F.when((F.col("at") <= F.col("id") - 2) & (b1.isNull() | (b1 >= y)), F.col("at"))).over(run)
    right = F.min(F.when((F.col("at") >= F.col("id") + 2) & (a1.isNull() | (y <= a1)), F.col("at"))).over(run)
    met = met.withColumns({"l": left, "r": right})
    shape = ((b1 <= y) & (y > a1)) | ((b1 < y) & (y >= a1))
    higher = shape & (F.col("at") > F.col("l")) & (F.col("at") < F.col("r")) & (y > F.col("was"))
    met = met.withColumn("top", F.coalesce(F.max_by("at", F.when(higher, F.struct("intensity", -F.col("at")))).over(run), F.col("id")))
    piece = F.when((F.col("at") >= F.col("l")) & (F.col("at") < F.col("r")), (F.col("rt_a1") - F.col("rt")) * (y + a1) / 2)
    at = lambda place, c: F.max(F.when(F.col("at") == F.col(place), F.col(c)))
    out = met.groupBy("file_id").agg(
        at("top", "rt").alias("apex_rt"), at("top", "intensity").alias("height"), at("l", "rt").alias("rt_left"), at("r", "rt").alias("rt_right"),
        (F.sum(piece) * 60).alias("area"), ((at("l", "intensity") + at("r", "intensity")) * (at("r", "rt") - at("l", "rt")) / 2 * 60).alias("base"))
    return out.select("*", (F.col("area") - F.col("base")).alias("area_above_baseline")).drop("base")


def reintegrated(trace: DataFrame, left: float, right: float) -> DataFrame:
    """The peak of each run between two times chosen by hand, areas in intensity x seconds;
    runs with fewer than two points inside have no row."""
    inside = trace.where(F.col("rt").between(left, right))
    steps = inside.withColumns({"next_rt": F.lead("rt").over(_in_run()), "next": F.lead("intensity").over(_in_run())})
    piece = (F.col("next_rt") - F.col("rt")) * (F.col("intensity") + F.col("next")) / 2 * 60
    s = steps.groupBy("file_id").agg(
        F.count("*").alias("n"), F.max_by("rt", F.struct("intensity", -F.col("rt"))).alias("apex_rt"), F.max("intensity").alias("height"), F.sum(piece).alias("area"),
        F.min("rt").alias("rt_left"), F.max("rt").alias("rt_right"), F.min_by("intensity", "rt").alias("first"), F.max_by("intensity", "rt").alias("last")).where("n > 1")
    base = (F.col("first") + F.col("last")) / 2 * (F.col("rt_right") - F.col("rt_left")) * 60
    return s.select("file_id", "apex_rt", "height", "rt_left", "rt_right", "area", F.greatest(F.lit(0.0), F.col("area") - base).alias("area_above_baseline"))


def gaussian_smoothed(trace: DataFrame, sigma: float) -> DataFrame:
    """Gaussian weights over three sigma of scans; at a run's ends the weights that are left
    are renormalised."""
    reach = max(1, math.ceil(3 * sigma))
    return smoothed(trace, tuple(math.exp(-0.5 * (k / sigma) ** 2) for k in range(reach + 1)))


def time_weighted(trace: DataFrame, reach: float) -> DataFrame:
    """Moving average with weights that fall linearly in time to zero at ``reach``."""
    near = f"range between {float(reach)}D preceding and {float(reach)}D following"
    held = F.expr(f"collect_list(struct(rt, intensity)) over (partition by file_id order by rt {near})")
    weight = lambda p: 1 - F.abs(p["rt"] - F.col("rt")) / reach
    total = F.aggregate("held", F.lit(0.0), lambda s, p: s + p["intensity"] * weight(p))
    share = F.aggregate("held", F.lit(0.0), lambda s, p: s + weight(p))
    return trace.withColumn("held", held).select("file_id", "rt", "intensity", (total / share).alias("smooth"))


def centroids(profile: DataFrame) -> DataFrame:
    """Local maxima of profile spectra ``spectrum_id, mz, intensity``: above both neighbours
    (a plateau counts once, at its left end); intensity at the top, m/z weighted over the
    top and its two neighbours."""
    w = Window.partitionBy("spectrum_id").orderBy("mz")
    near = {f"{c}_{n}": f(c).over(w) for c in ("mz", "intensity") for n, f in (("b", F.lag), ("a", F.lead))}
    y, b, a = F.col("intensity"), F.coalesce("intensity_b", F.lit(0.0)), F.coalesce("intensity_a", F.lit(0.0))
    mass = (F.col("mz") * y + F.coalesce("mz_b", F.lit(0.0)) * b + F.coalesce("mz_a", F.lit(0.0)) * a) / (y + b + a)
    return profile.withColumns(near).where((y > b) & (y >= a)).select("spectrum_id", mass.alias("mz"), "intensity")


def baseline_corrected(trace: DataFrame, width: float) -> DataFrame:
    """Intensity above a baseline: straight lines between the minima of time segments
    ``width`` wide (level before the first and after the last), at least zero."""
    segment = F.floor(F.col("rt") / width)
    lows = trace.groupBy("file_id", segment.alias("segment")).agg(F.min_by(F.struct("rt", "intensity"), F.struct("intensity", "rt")).alias("low"))
    order = Window.partitionBy("file_id").orderBy("segment")
    beside = lows.select("file_id", "segment", "low", F.lag("low").over(order).alias("before"), F.lead("low").over(order).alias("after"))
    met = trace.withColumn("segment", segment).join(beside, ["file_id", "segment"])
    one = F.when(F.col("rt") >= F.col("low.rt"), F.col("low")).otherwise(F.col("before"))
    two = F.when(F.col("rt") >= F.col("low.rt"), F.col("after")).otherwise(F.col("low"))
    met = met.withColumns({"one": F.coalesce(one, two), "two": F.coalesce(two, one)})
    share = F.when(F.col("two.rt") > F.col("one.rt"), (F.col("rt") - F.col("one.rt")) / (F.col("two.rt") - F.col("one.rt"))).otherwise(0.0)
    level = F.col("one.intensity") + (F.col("two.intensity") - F.col("one.intensity")) * share
    return met.select("file_id", "rt", F.greatest(F.lit(0.0), F.col("intensity") - level).alias("intensity"))

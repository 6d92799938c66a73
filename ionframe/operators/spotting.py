"""From scans to peaks and pure product spectra: spotting and deconvolution.

Survey scans: ``file_id, rt, mz, intensity`` centroids. A run's scans are numbered by time,
so a trace is sparse: scans without a point count as zero. Traces are taken to numpy one at
a time (file and mass), so a group is as long as a run.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionframe.operators.leaders import leaders
from ionframe.tables import written

PEAK = "file_id long, mz double, rt double, rt_left double, rt_right double, height double, area double, noise double, n_scans long, scan long"


class Rule(NamedTuple):
    """What makes a peak: slice width and mass tolerance, smoothing reach, least width in
    scans, least height, how far from the apex (in scans) a trace is read and noise taken."""

    width: float
    tol: float
    smooth: int = 2
    least_scans: int = 3
    least_height: float = 0.0
    reach: int = 50


def smooth(trace: np.ndarray, reach: int) -> np.ndarray:
    """Linearly weighted moving average; at the ends the weights that are left count."""
    weights = np.concatenate((np.arange(1, reach + 2), np.arange(reach, 0, -1))).astype(float)
    return np.convolve(trace, weights, "same")[: len(trace)] / np.convolve(np.ones(len(trace)), weights, "same")[: len(trace)] if len(trace) > 2 * reach else trace


def tops(y: np.ndarray) -> list[tuple[int, int, int]]:
    """(left, apex, right) of every rise, apex and fall of a trace; a plateau's apex is its
    first point, bounds are the lowest points beside it."""
    if len(y) < 3:
        return []
    change = np.flatnonzero(np.diff(y) != 0) + 1
    starts = np.concatenate(([0], change))  # first point of each level stretch
    level = y[starts]
    ends = np.concatenate((change, [len(y)])) - 1
    up = np.concatenate(([False], level[1:] > level[:-1]))
    down = np.concatenate((level[1:] < level[:-1], [False]))
    out = []
    for k in np.flatnonzero(up & down):
        a = k
        while a > 0 and level[a - 1] < level[a]:
            a -= 1
        b = k
        while b < len(level) - 1 and level[b + 1] < level[b]:
            b += 1
        out.append((int(ends[a]), int(starts[k]), int(starts[b])))
    return out


def local_noise(y: np.ndarray) -> float:
    """Median absolute deviation of the steps, as a standard deviation of one point."""
    steps = np.abs(np.diff(y))
    return float(np.median(np.abs(steps - np.median(steps))) * 1.4826 / np.sqrt(2)) if len(steps) > 1 else 0.0


def _dense(scan: np.ndarray, y: np.ndarray, pad: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first scan, trace) of the stretches of a sparse trace, zeros inside and ``pad`` around;
    stretches end where more than 2 x pad scans are empty."""
    cuts = np.flatnonzero(np.diff(scan) > 2 * pad) + 1
    for part in np.split(np.arange(len(scan)), cuts):
        first = int(scan[part[0]]) - pad
        out = np.zeros(int(scan[part[-1]]) - first + pad + 1)
        np.add.at(out, scan[part] - first, y[part])
        yield first, out


def numbered_scans(scans: DataFrame) -> DataFrame:
    """Centroids with ``scan``, the number of their scan in the run."""
    times = scans.select("file_id", "rt").distinct()
    return scans.join(times.withColumn("scan", F.row_number().over(Window.partitionBy("file_id").orderBy("rt")).cast("long")), ["file_id", "rt"])


def spot_peaks(scans: DataFrame, rule: Rule) -> DataFrame:
    """Peaks of all runs: ``file_id, mz, rt, rt_left, rt_right, height, area, noise, n_scans,
    snr``; heights and areas (intensity x minutes) are those of the smoothed trace.

    Each centroid goes to the two overlapping slices it lies in. In a slice, masses with a gap
    of more than the tolerance between them are traces of their own; apexes of these say at
    which masses to look (the strongest centroid of the apex's scan). Around each such
    mass the trace within the tolerance is read anew, so what is measured does not depend on
    where slices begin. Of peaks in one file whose masses and apexes agree (one ion found in
    two slices, or under two of its centroids) the highest stays.
    """
    points = numbered_scans(scans.select("file_id", "rt", "mz", "intensity").where("mz is not null and intensity is not null"))
    found = points.select("*", F.explode(F.array(F.floor(F.col("mz") / rule.width), F.floor(F.col("mz") / rule.width) - 1)).alias("slice"))

    def apexes(table: pa.Table) -> pa.Table:
        table = table.sort_by("mz")
        scan, y, mz = (table[c].to_numpy() for c in ("scan", "intensity", "mz"))
        hits = []
        for part in np.split(np.arange(len(mz)), np.flatnonzero(np.diff(mz) > rule.tol) + 1):
            part = part[np.lexsort((mz[part], -y[part], scan[part]))]  # a scan's strongest centroid first
            known, at = np.unique(scan[part], return_index=True)
            strongest = mz[part][at]
            for first, trace in _dense(scan[part], y[part], rule.smooth + 1):
                for _, apex, _ in tops(smooth(trace, rule.smooth)):
                    k = int(np.argmin(np.abs(known - first - apex)))  # an apex may lie in an empty scan
                    hits.append((strongest[k], int(known[k])))
        file_id = table["file_id"][0].as_py()
        return pa.table({"file_id": pa.array([file_id] * len(hits), pa.int64()), "target": pa.array([m for m, _ in hits], pa.float64()), "top": pa.array([s for _, s in hits], pa.int64())})

    targets = found.select("file_id", "slice", "scan", "mz", "intensity").groupBy("file_id", "slice").applyInArrow(apexes, "file_id long, target double, top long").distinct()
    pad = rule.reach + rule.smooth
    times = points.groupBy("file_id").agg(F.sort_array(F.collect_set("rt")).alias("times"))  # a run's scans
    first = F.greatest(F.lit(1).cast("long"), F.col("top") - pad)
    block = lambda mz: F.floor(mz / (8 * rule.width))
    told = targets.join(times, "file_id").select("file_id", block(F.col("target")).alias("block"), "target", "top", first.alias("first"), F.slice("times", first.cast("int"), (F.col("top") - first + pad + 1).cast("int")).alias("times"))
    blocks = F.array_distinct(F.array(block(F.col("mz") - rule.tol), block(F.col("mz") + rule.tol)))
    near = points.select("file_id", "scan", "mz", "intensity", F.explode(blocks).alias("block"))

    def measure(goals: pa.Table, held: pa.Table) -> pa.Table:
        held = held.sort_by("mz")
        mz, scan, y = (held[c].to_numpy() for c in ("mz", "scan", "intensity"))
        out = []
        for goal in goals.select(["file_id", "target", "top", "first", "times"]).to_pylist():
            start, at = goal["first"], np.array(goal["times"])
            lo, hi = np.searchsorted(mz, [goal["target"] - rule.tol, goal["target"] + rule.tol], side="left")
            hi += int(np.searchsorted(mz[hi:], goal["target"] + rule.tol, side="right"))
            place = scan[lo:hi] - start
            inside = (place >= 0) & (place < len(at))
            line = smooth(np.bincount(place[inside], y[lo:hi][inside], len(at)), rule.smooth)
            best = min(tops(line), key=lambda p: (abs(start + p[1] - goal["top"]), -line[p[1]]), default=None)  # noqa: B023
            if best is None:
                continue
            left, apex, right = best
            if right - left + 1 >= rule.least_scans and line[apex] >= rule.least_height:
                area = float(np.trapezoid(line[left : right + 1], at[left : right + 1]))
                out.append((goal["file_id"], goal["target"], at[apex], at[left], at[right], float(line[apex]), area, local_noise(line), right - left + 1, start + apex))
        names, kinds = zip(*(c.split() for c in PEAK.split(", ")), strict=True)
        return pa.table({n: pa.array([r[k] for r in out], pa.int64() if kind == "long" else pa.float64()) for k, (n, kind) in enumerate(zip(names, kinds, strict=True))})

    peaks = told.groupBy("file_id", "block").cogroup(near.groupBy("file_id", "block")).applyInArrow(measure, PEAK)
    peaks = peaks.dropDuplicates(["file_id", "mz", "scan"])
    return without_doubles(peaks, rule.tol, 2 * rule.smooth).select("*", F.when(F.col("noise") > 0, F.col("height") / F.col("noise")).alias("snr")).drop("scan")


def without_doubles(peaks: DataFrame, tol: float, scans: int) -> DataFrame:
    """Of peaks of one file within ``tol`` and ``scans`` of a higher one that stays, none stay."""
    ids = written(peaks.withColumn("id", F.concat_ws(":", "file_id", "mz", "scan")), "spotted")
    cell = F.floor(F.col("mz") / tol)
    near = ids.select("id", "file_id", "mz", "scan", "height", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    own = ids.select(F.col("id").alias("first"), "file_id", F.col("mz").alias("m"), F.col("scan").alias("s"), F.col("height").alias("h"), cell.alias("cell"))
    close = (F.abs(F.col("mz") - F.col("m")) <= tol) & (F.abs(F.col("scan") - F.col("s")) <= scans)
    higher = (F.col("h") > F.col("height")) | ((F.col("h") == F.col("height")) & (F.col("first") < F.col("id")))
    edges = own.join(near, ["file_id", "cell"]).where(close & higher).select("first", F.col("id").alias("second"))
    found = leaders(ids.select("id", F.struct(-F.col("height"), F.col("id")).alias("turn")), edges)
    return ids.join(found.where("id = leader").select("id"), "id", "left_semi").drop("id")


def nonnegative(a: np.ndarray, b: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Least squares of ``a x = b`` with x >= 0, by an active set that grows with the steepest
    column and drops what turns negative on the way."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    scale = np.abs(a).max() * max(np.abs(b).max(), 1e-300) if a.size else 0.0
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        if free.all() or slope.max() <= 1e-12 * scale:
            break
        free[int(np.argmax(slope))] = True
        while True:
            goal = np.zeros(n)
            goal[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (goal <= 0)
            if not low.any():
                x = goal
                break
            share = (x[low] / (x[low] - goal[low])).min()
            x = x + share * (goal - x)
            free &= x > 1e-15 * max(x.max(), 1e-300)
            x[~free] = 0.0
            if not free.any():
                break
    return x


#: A trace that other models explain but for this share of its length is a mixture of them.
EXPLAINED = 0.02


def models(traces: np.ndarray, apart: int = 1) -> list[tuple[int, np.ndarray]]:
    """(apex, shape) of the model peaks of product traces ``(ions, scans)``.

    The purest trace (least rise on the way down from its apex, then highest over its area)
    is the shape of a component, and so is each next one whose apex is more than ``apart``
    scans from those before. A shape that purer ones add up to is the trace of an ion that several components share,
    and no component.
    """
    found = []
    for k, y in enumerate(traces):
        for left, apex, right in tops(np.concatenate(([0.0], y, [0.0]))):
            l, a, r = max(left - 1, 0), apex - 1, min(right - 1, len(y) - 1)
            rise = np.abs(np.diff(np.concatenate(([0.0], y, [0.0])))).sum()
            purity = 2 * y[a] / rise if rise > 0 else 0.0
            found.append((a, round(purity, 9), y[a] / y[l : r + 1].sum(), k))
    kept: list[tuple] = []
    for f in sorted(found, key=lambda f: (-f[1], -f[2], f[3])):
        if all(abs(f[0] - o[0]) > apart for o in kept):
            kept.append(f)
    for f in kept[::-1]:  # the least pure first
        others = [traces[o[3]] / traces[o[3]].max() for o in kept if o is not f]
        if others:
            y, a = traces[f[3]], np.stack(others, axis=1)
            if np.linalg.norm(y - a @ nonnegative(a, y)) <= EXPLAINED * np.linalg.norm(y):
                kept.remove(f)
    return sorted(((apex, traces[k] / traces[k][apex]) for apex, _, _, k in kept), key=lambda m: m[0])


def pure_spectrum(traces: np.ndarray, top: int, apart: int = 1) -> np.ndarray | None:
    """Intensity of each product ion that belongs to the component at scan ``top``: traces are
    sums of model shapes with weights of at least zero. None without a model near ``top``."""
    found = models(traces, apart)
    own = min(range(len(found)), key=lambda k: abs(found[k][0] - top), default=None)
    if own is None or abs(found[own][0] - top) > apart + 1:
        return None
    shapes = np.stack([s for _, s in found], axis=1)
    return np.array([nonnegative(shapes, y)[own] for y in traces])


SPECTRUM = "peak_id long, mz double, intensity double, deconvoluted boolean"


def deconvoluted(peaks: DataFrame, products: DataFrame, tol: float, isolation: float, window: float, smooth_reach: int = 0) -> DataFrame:
    """``peak_id, mz, intensity, deconvoluted``: a product spectrum for each of ``peaks``
    (``peak_id, file_id, mz, rt, rt_left, rt_right``).

    products: ``file_id, rt, precursor_mz, mz, intensity``. A product scan belongs to every
    peak of its file whose mass its isolation window holds, within the peak's bounds and
    ``window`` minutes around. Product ions are taken within ``tol`` of those in the scan
    nearest the apex; each one's trace is split over the models of co-eluting components, and
    the peak's own share is its intensity. Without a model at the apex that scan's spectrum
    stays as it is (``deconvoluted`` false); peaks without a product scan have no rows.
    Peaks and scans meet in cells of file and time, and a group is one peak's window.
    """
    step = max(window, 1e-9)
    told = peaks.select("peak_id", "file_id", F.col("mz").alias("own_mz"), "rt", (F.col("rt_left") - window).alias("from"), (F.col("rt_right") + window).alias("to")).withColumnRenamed("rt", "apex_rt")
    near = told.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") / step), F.floor(F.col("to") / step))))
    scans = products.select("file_id", "rt", "precursor_mz", "mz", "intensity").withColumn("cell", F.floor(F.col("rt") / step))
    met = scans.join(near, ["file_id", "cell"]).where(F.col("rt").between(F.col("from"), F.col("to")) & (F.abs(F.col("precursor_mz") - F.col("own_mz")) <= isolation))

    def split(table: pa.Table) -> pa.Table:
        rt, mz, y = (table[c].to_numpy() for c in ("rt", "mz", "intensity"))
        times = np.unique(rt)
        top = int(np.argmin(np.abs(times - table["apex_rt"][0].as_py())))
        here = rt == times[top]
        ions = _merged(mz[here], y[here], tol)
        at = np.searchsorted(times, rt)
        traces = np.zeros((len(ions), len(times)))
        for k, m in enumerate(ions):
            held = np.abs(mz - m) <= tol
            np.add.at(traces[k], at[held], y[held])
        line = np.stack([smooth(t, smooth_reach) for t in traces]) if smooth_reach else traces
        pure = pure_spectrum(line, top)
        made = traces[:, top] if pure is None else pure
        rows = [(m, v) for m, v in zip(ions, made, strict=True) if v > 0]
        peak = table["peak_id"][0].as_py()
        return pa.table({"peak_id": pa.array([peak] * len(rows), pa.int64()), "mz": pa.array([float(m) for m, _ in rows], pa.float64()), "intensity": pa.array([float(v) for _, v in rows], pa.float64()), "deconvoluted": pa.array([pure is not None] * len(rows), pa.bool_())})

    return met.select("peak_id", "apex_rt", "rt", "mz", "intensity").groupBy("peak_id").applyInArrow(split, SPECTRUM)


def _merged(mz: np.ndarray, y: np.ndarray, tol: float) -> list[float]:
    """Masses of one scan, those within ``tol`` of a stronger one left out."""
    kept: list[float] = []
    for k in np.lexsort((mz, -y)):
        if all(abs(mz[k] - m) > tol for m in kept):
            kept.append(float(mz[k]))
    return sorted(kept)

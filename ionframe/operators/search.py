"""Filters and searches over features, tags and spectra."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAG_RULES = ("any", "all", "none", "not all")


def tag_matched(tags: Column, wanted: Sequence[str], rule: str) -> Column:
    """Whether an array of tags fits; an empty query fits all."""
    if rule not in TAG_RULES:
        raise ValueError(f"rule must be one of {TAG_RULES}")
    if not wanted:
        return F.lit(True)
    met = F.coalesce(F.size(F.array_intersect(tags, F.lit(list(wanted)))), F.lit(0))
    return {"any": met > 0, "all": met == len(set(wanted)), "none": met <= 0, "not all": met < len(set(wanted))}[rule]


def keyword_matched(text: Column, words: Sequence[str], mode: str) -> Column:
    """``all``: contains every word (null drops); ``all or null``: the same, null stays;
    ``exact``: equals one of the words. Case does not matter."""
    low = F.lower(text)
    if mode == "exact":
        return F.coalesce(low.isin([w.lower() for w in words]), F.lit(False)) if words else F.lit(True)
    fits = F.lit(True)
    for w in words:
        fits = fits & F.contains(low, F.lit(w.lower()))
    return F.coalesce(fits, F.lit(mode == "all or null"))


def display_matched(flags: Column, annotation: int, annotation_bits: int, others: int) -> Column:
    """Bit mask of a feature against a display filter: one of the chosen annotation bits (none
    chosen: any feature), and all of the other chosen bits."""
    one = F.lit(True) if not annotation & annotation_bits else flags.bitwiseAND(annotation & annotation_bits) != 0
    rest = others & ~annotation_bits
    return one & (flags.bitwiseAND(rest) == rest)


@dataclass(frozen=True)
class FeatureQuery:
    """A search over feature properties; ``condition``: above, below, equals, or None (at least)."""

    rt: float = 0.0
    height: float = 0.0
    relative: float = 0.0
    mass: float = 0.0
    tol: float = 0.0
    condition: str | None = None


def _holds(condition: str | None, value: Column, wanted: float) -> Column:
    return {"above": value > wanted, "below": value < wanted, "equals": F.abs(value - wanted) < 0.01}.get(condition, value >= wanted)


def features_found(features: DataFrame, queries: Sequence[FeatureQuery]) -> DataFrame:
    """``spot_id, rt, mz, height`` rows that fit one of the queries (none: all stay).

    Every property is tested under the query's condition, as upper bounds are not part of
    the search; relative height is per cent of the largest.
    """
    if not queries:
        return features
    met = features.join(F.broadcast(features.agg(F.max("height").alias("_top"))))  # one row
    fits = F.lit(False)
    for q in queries:
        one = _holds(q.condition, F.col("rt"), q.rt) & _holds(q.condition, F.col("height"), q.height) & _holds(q.condition, F.col("height") / F.col("_top") * 100, q.relative)
        if q.mass > 0 and q.tol > 0:
            one = one & (F.abs(F.col("mz") - q.mass) <= q.tol)
        fits = fits | one
    return met.where(fits).drop("_top")


@dataclass(frozen=True)
class FragmentQuery:
    """A product ion or a neutral loss of at least ``relative`` per cent of the base peak."""

    mass: float
    tol: float
    relative: float = 0.0
    loss: bool = False
    condition: str | None = None


def fragments_found(spectra: DataFrame, fragments: DataFrame, queries: Sequence[FragmentQuery], every: bool) -> DataFrame:
    """``spectrum_id, n_queries``: spectra in which all (or, not ``every``, some) queries hold.

    One pass over the fragments: a bit a query, combined map-side within each spectrum.
    """
    base = fragments.groupBy("spectrum_id").agg(F.max("intensity").alias("base"))
    met = fragments.join(base, "spectrum_id").join(spectra.select("spectrum_id", "precursor_mz"), "spectrum_id")
    share = F.col("intensity") / F.col("base") * 100
    bits = F.lit(0)
    for k, q in enumerate(queries):
        mass = F.col("precursor_mz") - F.col("mz") if q.loss else F.col("mz")
        bits = bits + F.when((F.abs(mass - q.mass) <= q.tol) & _holds(q.condition, share, q.relative), 1 << k).otherwise(0)
    found = met.groupBy("spectrum_id").agg(F.bit_or(bits.cast("long")).alias("bits"))
    return found.where(F.col("bits") == (1 << len(queries)) - 1 if every else F.col("bits") > 0).select("spectrum_id", F.bit_count("bits").cast("long").alias("n_queries"))


def mz_list(text: Column) -> Column:
    """Struct of the positive finite masses and the rejected words of a typed list."""
    words = F.filter(F.split(text, r"[,; \t\n\r]+"), lambda w: w != "")
    number = lambda w: w.try_cast("double")
    good = lambda w: F.coalesce((number(w) > 0) & (number(w) < float("inf")) & ~F.isnan(number(w)), F.lit(False))
    return F.struct(F.transform(F.filter(words, good), number).alias("masses"), F.filter(words, lambda w: ~good(w)).alias("rejected"))


GATE = 0.05


def source_rows(scans: DataFrame, source: str) -> DataFrame:
    """Scans that a source names: ``ms1``, ``ms2-all``, ``channel:N`` (column experiment_id)
    or ``gated:MZ[:TOL]`` (parents within TOL, inclusive)."""
    kind, _, rest = source.strip().lower().partition(":")
    if kind == "ms1" and not rest:
        return scans.where("ms_level <= 1")
    if kind == "ms2-all" and not rest:
        return scans.where("ms_level > 1")
    try:
        if kind == "channel":
            return scans.where(F.col("experiment_id") == int(rest))
        if kind == "gated":
            mz, _, tol = rest.partition(":")
            return scans.where((F.col("ms_level") > 1) & (F.col("parent_mz") > 0) & (F.abs(F.col("parent_mz") - float(mz)) <= (float(tol) if tol else GATE)))
    except ValueError as e:
        raise ValueError(f"{source!r}: {e}") from None
    raise ValueError(f"{source!r} is no source: ms1, ms2-all, channel:N or gated:MZ[:TOL]")


def targets_found(features: DataFrame, targets: DataFrame, mz_tol: float, rt_tol: float, least: float) -> DataFrame:
    """``target_id, spot_id``: features of ``least`` height within both tolerances of a
    target (``target_id, target_mz, target_rt``)."""
    from ionframe.operators.rangejoin import range_join

    met = range_join(features.where(F.col("height") >= least), targets, "mz", "target_mz", mz_tol)
    return met.where(F.abs(F.col("rt") - F.col("target_rt")) <= rt_tol).select("target_id", "spot_id")


def mass_groups(features: DataFrame, tol: float) -> DataFrame:
    """``spot_id, group_mz``: sorted masses cut into groups that reach ``tol`` beyond their
    first. A mass further than ``tol`` from the one before always begins a group, so only
    the runs between such gaps are walked, each in one small group."""
    from pyspark.sql import Window

    # gaps are found within ranges of m/z, and a range's first mass looks back one range
    cell = F.floor(F.col("mz") / 10)
    last = features.groupBy((cell + 1).alias("cell")).agg(F.max("mz").alias("before_cell"))
    order = Window.partitionBy("cell").orderBy("mz", "spot_id")
    met = features.select("spot_id", "mz", cell.alias("cell")).join(last, "cell", "left")
    before = F.coalesce(F.lag("mz").over(order), F.col("before_cell"))
    starts = met.withColumn("start", F.when(before.isNull() | (F.col("mz") - before > tol), F.col("mz")))
    runs = starts.groupBy("cell").agg(F.max("start").alias("open"))
    # a run may go on over cells: the last start of the cells before it
    over = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.withColumn("carried", F.last("open", ignorenulls=True).over(over)).drop("open")
    own = F.last("start", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = starts.join(carried, "cell").withColumn("run", F.coalesce(own, "carried"))
    walked = placed.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("mz", "spot_id"))).alias("held"))
    step = lambda done, x: F.concat(done, F.array(F.struct(x["spot_id"].alias("spot_id"), F.when((F.size(done) > 0) & (x["mz"] - F.element_at(done, -1)["first"] <= tol), F.element_at(done, -1)["first"]).otherwise(x["mz"]).alias("first"))))
    empty = F.filter(F.array(F.struct(F.lit(0).cast("long").alias("spot_id"), F.lit(0.0).alias("first"))), lambda x: F.lit(False))
    return walked.select(F.explode(F.aggregate("held", empty, step)).alias("x")).select("x.spot_id", F.col("x.first").alias("group_mz"))

"""Isotope patterns as array expressions: elements' powers folded into one distribution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ionframe.functions.chemistry import element_count

#: Isotopes of the elements, mass and natural abundance, most abundant first (fixed values).
ISOTOPES = {
    "H": ((1.00782503207, 0.999885), (2.01410177785, 0.000115)),
    "C": ((12.0, 0.9893), (13.00335483778, 0.0107)),
    "N": ((14.0030740048, 0.99636), (15.0001088982, 0.00364)),
    "O": ((15.9949146196, 0.99757), (16.9991317012, 0.00038), (17.9991596129, 0.00205)),
    "F": ((18.99840322, 1.0),),
    "Na": ((22.9897692809, 1.0),),
    "Si": ((27.9769265325, 0.92223), (28.976494700, 0.04685), (29.973770171, 0.03092)),
    "P": ((30.97376163, 1.0),),
    "S": ((31.97207100, 0.9499), (32.97145876, 0.0075), (33.96786690, 0.0425), (35.96708076, 0.0001)),
    "Cl": ((34.96885268, 0.7576), (36.96590259, 0.2424)),
    "K": ((38.96370668, 0.932581), (39.96399848, 0.000117), (40.96182576, 0.067302)),
    "Br": ((78.9183371, 0.5069), (80.9162906, 0.4931)),
    "I": ((126.904473, 1.0),),
}
PEAKS = "array<struct<mass:double,share:double>>"
#: Counts of an element are below 2 to this power.
BITS = 10


def _peak(mass: Column, share: Column) -> Column:
    return F.struct(mass.alias("mass"), share.alias("share"))


def _convolved(a: Column, b: Column, prune: float) -> Column:
    """All sums of two distributions' masses with the products of their shares, the small ones left out."""
    pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: _peak(x["mass"] + y["mass"], x["share"] * y["share"]))))
    return F.filter(pairs, lambda p: p["share"] >= prune)


def _merged(peaks: Column, tol: float) -> Column:
    """Peaks in the order of mass, each that lies within ``tol`` of what precedes it joined to
    it at the mean mass by share."""

    def step(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        share = last["share"] + p["share"]
        joined = _peak((last["mass"] * last["share"] + p["mass"] * p["share"]) / share, share)
        close = F.when(F.size(done) > 0, p["mass"] - last["mass"] <= tol).otherwise(False)
        return F.when(close, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(p)))

    return F.aggregate(F.sort_array(peaks), F.array().cast(PEAKS), step)


def isotope_pattern(formula: Column, least: float = 0.001, most: int = 12, tol: float = 0.01) -> Column:
    """``array<struct<mass, share>>`` of a flat formula: neutral masses of its isotope peaks, the
    largest share being 1, those below ``least`` left out, ``most`` at most.

    An element's power is built by squaring, its isotopes' shares scaled to a sum of one;
    shares below a thousandth of ``least`` are pruned on the way and masses within a quarter of
    ``tol`` joined, so that arrays stay short whatever the counts. Peaks within ``tol`` are one.
    """
    prune, close = least * 1e-3, tol / 4
    rows = []
    for element, isotopes in ISOTOPES.items():
        total = sum(share for _, share in isotopes)
        own = F.array(*[_peak(F.lit(float(m)), F.lit(s / total)) for m, s in isotopes])
        rows.append(F.struct(own.alias("own"), element_count(formula, element).cast("int").alias("n")))

    def power(own: Column, n: Column) -> Column:
        def step(s: Column, bit: Column) -> Column:
            use = F.floor(n / F.pow(F.lit(2.0), bit)) % 2 == 1
            done = F.when(use, _merged(_convolved(s["done"], s["square"], prune), close)).otherwise(s["done"])
            more = n >= F.pow(F.lit(2.0), bit + 1)
            square = F.when(more, _merged(_convolved(s["square"], s["square"], prune), close)).otherwise(s["square"])
            return F.struct(done.alias("done"), square.alias("square"))

        one = F.array(_peak(F.lit(0.0), F.lit(1.0)))
        start = F.struct(one.cast(PEAKS).alias("done"), own.cast(PEAKS).alias("square"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), start, step, lambda s: s["done"])

    def fold(held: Column, row: Column) -> Column:
        alone = F.size(row["own"]) == 1
        moved = F.transform(held, lambda p: _peak(p["mass"] + row["own"][0]["mass"] * row["n"], p["share"]))
        # bound to a name, or it would be made anew for every peak held
        met = F.transform(F.array(power(row["own"], row["n"])), lambda own: _merged(_convolved(held, own, prune), close))
        return F.when(row["n"] == 0, held).when(alone, moved).otherwise(F.element_at(met, 1))

    whole = F.aggregate(F.array(*rows), F.array(_peak(F.lit(0.0), F.lit(1.0))).cast(PEAKS), fold, lambda held: _merged(held, tol))
    top = lambda peaks: F.array_max(F.transform(peaks, lambda p: p["share"]))
    scaled = F.element_at(F.transform(F.array(whole), lambda peaks: F.element_at(F.transform(F.array(top(peaks)), lambda t: F.filter(F.transform(peaks, lambda p: _peak(p["mass"], p["share"] / t)), lambda p: p["share"] >= least)), 1)), 1)
    return F.when(formula.isNotNull(), F.slice(scaled, 1, most))

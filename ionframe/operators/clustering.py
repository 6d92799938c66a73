"""Agglomerative clustering in rounds on a table of cluster distances."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionframe.tables import written

LINKAGES = ("average", "complete", "single", "ward")


def _height(kind: str) -> Column:
    """Distance of two clusters from what is kept of their members' distances."""
    s, n, m = F.col("s"), F.col("n_a"), F.col("n_b")
    if kind == "average":
        return s / (n * m)
    if kind == "ward":  # from sums of squares between and within the clusters
        centres = s / (n * m) - F.col("w_a") / (n * n) - F.col("w_b") / (m * m)
        return F.sqrt(F.greatest(F.lit(0.0), 2 * n * m / (n + m) * centres))
    return s


#: Clusters whose distances (a matrix) one task takes.
TOGETHER = 1024


def kind_of(pairs: DataFrame) -> str:
    return pairs.schema["a"].dataType.simpleString()


def _rest(kind: str, step: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The closest pair merges, until one cluster is left."""

    def run(pairs: pa.Table, sizes: pa.Table) -> pa.Table:
        sizes = sizes.sort_by("id")
        ids = sizes["id"].to_pylist()
        place = {v: k for k, v in enumerate(ids)}
        n, w = sizes["n"].to_numpy().astype(float), sizes["w"].to_numpy().copy()
        s = np.full((len(ids), len(ids)), np.nan)
        a, b = ([place[v] for v in pairs[c].to_pylist()] for c in ("a", "b"))
        s[a, b] = s[b, a] = pairs["s"].to_numpy()
        live, out = np.ones(len(ids), bool), []

        def heights(rows: np.ndarray) -> np.ndarray:
            both = n[rows, None] * n[None, :]
            if kind == "average":
                d = s[rows] / both
            elif kind == "ward":
                d = np.sqrt(np.maximum(0, 2 * both / (n[rows, None] + n[None, :]) * (s[rows] / both - (w / n**2)[rows, None] - (w / n**2)[None, :])))
            else:
                d = s[rows].copy()
            d[~np.isfinite(d)] = np.inf
            d[:, ~live] = np.inf
            return d

        d = heights(np.arange(len(ids)))
        np.fill_diagonal(d, np.inf)
        for _ in range(len(ids) - 1):
            one, two = divmod(int(d.argmin()), len(ids))
            if not np.isfinite(d[one, two]):
                break
            one, two = min(one, two), max(one, two)
            w[one] += w[two] + s[one, two]
            n[one] += n[two]
            out.append((ids[one], ids[two], float(d[one, two]), int(n[one])))
            joined = {"complete": np.fmax, "single": np.fmin}.get(kind, np.add)(s[one], s[two])
            s[one] = s[:, one] = joined
            live[two] = False
            d[two] = d[:, two] = np.inf
            d[one] = d[:, one] = heights(np.array([one]))[0]
            d[one, one] = np.inf
        names = ["left", "right", "height", "size"]
        kinds = [pairs.schema.field("a").type] * 2 + [pa.float64(), pa.int64()]
        return pa.table({"step": pa.array(range(step, step + len(out)), pa.int32())} | {c: pa.array([r[k] for r in out], t) for k, (c, t) in enumerate(zip(names, kinds, strict=True))})

    return run


def linkage(distances: DataFrame, kind: str = "average") -> DataFrame:
    """``step, left, right, height, size``: the merges of a dendrogram.

    distances: ``a, b, d`` of all pairs with a < b. A cluster is called by its smallest
    member. In a round all pairs that are nearest to each other merge (ties: smaller ids),
    which gives the tree of a loop that merges the closest pair each time, as a merge never
    brings the new cluster closer to others than its parts were. Of members' distances only
    sums (average; of squares, ward), the largest (complete) or the smallest (single) are kept,
    so a round is a join with the clusters' sizes and one aggregate. Once the clusters are few
    (a checked number), one task does the rest, as chains of merges would take a round each.
    """
    if kind not in LINKAGES:
        raise ValueError(f"linkage is one of {', '.join(LINKAGES)}")
    joined = {"average": F.sum, "ward": F.sum, "complete": F.max, "single": F.min}[kind]
    pairs = written(distances.select("a", "b", (F.col("d") * F.col("d") if kind == "ward" else F.col("d")).alias("s")), "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sizes = written(ids.select("id", F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("w")), "sizes")
    merges, step = None, 0
    while (left := sizes.count()) > 1:
        if left <= TOGETHER:
            rest = pairs.groupBy(F.lit(0).alias("g")).cogroup(sizes.groupBy(F.lit(0).alias("g"))).applyInArrow(_rest(kind, step), f"step int, left {kind_of(pairs)}, right {kind_of(pairs)}, height double, size long")
            merges = rest if merges is None else merges.unionByName(rest)
            break
        told = pairs.join(sizes.toDF("a", "n_a", "w_a"), "a").join(sizes.toDF("b", "n_b", "w_b"), "b")
        apart = told.select("a", "b", "s", _height(kind).alias("d"))
        ends = apart.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("e"), "a", "b", "d", "s")
        near = ends.groupBy("e.id").agg(F.min(F.struct("d", "a", "b", "s")).alias("best"))
        # a pair that both ends call their best
        both = near.groupBy("best").agg(F.count("*").alias("k")).where("k = 2").select("best.a", "best.b", "best.d", "best.s")
        now = written(both, "merged")
        size = now.join(sizes.toDF("a", "n_a", "w_a"), "a").join(sizes.toDF("b", "n_b", "w_b"), "b").withColumns({"n": F.col("n_a") + F.col("n_b"), "w": F.col("w_a") + F.col("w_b") + F.col("s")})
        made = size.select(F.lit(step).alias("step"), F.col("a").alias("left"), F.col("b").alias("right"), F.col("d").alias("height"), F.col("n").alias("size"))
        merges = made if merges is None else merges.unionByName(made)
        gone = now.select(F.col("b").alias("old"), F.col("a").alias("new"))
        moved = pairs.join(gone.toDF("a", "to_a"), "a", "left").join(gone.toDF("b", "to_b"), "b", "left")
        moved = moved.select(F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y"), "s").where("x != y")
        pairs = written(moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(joined("s").alias("s")), "pairs")
        kept = sizes.join(now.select(F.explode(F.array("a", "b")).alias("id")), "id", "left_anti")
        sizes = written(kept.unionByName(size.select(F.col("a").alias("id"), "n", "w")), "sizes")
        step += 1
    return distances.select(F.lit(0).alias("step"), F.col("a").alias("left"), F.col("b").alias("right"), F.col("d").alias("height"), F.lit(1).cast("long").alias("size")).limit(0) if merges is None else merges

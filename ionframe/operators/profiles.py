"""Sparse profiles: correlations of spots that elute together, by the runs that both have; rows
that are one value at most runs.

Heights are not negative and zero where a run lacks a spot, so two spots without a run in
common never correlate above zero, and pairs need only be made where they share one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionframe.tables import written

#: Heights of a block of spots (two blocks meet in a task), and products that a task holds at once.
ENTRIES, PRODUCTS = 1 << 18, 1 << 20
PAIRS = "one long, two long, correlation double"


def correlated_pairs(features: DataFrame, values: DataFrame, runs: int, rt_tol: float, least: float) -> DataFrame:
    """``one, two, correlation`` (one < two): features ``id, rt`` within ``rt_tol`` whose heights
    ``id, file_id, height`` (above zero, once a run) over all ``runs`` correlate with ``least``
    (above zero) or more, by Pearson's r.

    Spots are dealt in blocks by cells of time; a crowded cell has several blocks.
    """
    if least <= 0:
        raise ValueError("correlations above zero only")
    if runs < 3:
        return features.sparkSession.createDataFrame([], PAIRS)
    held = values.groupBy("id").agg(F.collect_list("file_id").alias("files"), F.collect_list("height").alias("heights"))
    rows = written(features.select("id", "rt").join(held, "id").withColumn("cell", F.floor(F.col("rt") / rt_tol)), "profiles")
    blocks = rows.groupBy("cell").agg(F.ceil(F.sum(F.size("files")) / ENTRIES).cast("int").alias("n"))
    rows = rows.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).drop("n")
    own = written(blocks.select("cell", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block")), "blocks")
    other = own.select(F.col("cell").alias("c2"), F.col("block").alias("b2"))
    same = own.join(other, (F.col("cell") == F.col("c2")) & (F.col("block") <= F.col("b2")))
    tasks = same.unionByName(own.join(other, F.col("cell") + 1 == F.col("c2"))).select(F.col("cell").alias("c1"), F.col("block").alias("b1"), "c2", "b2")
    first = rows.join(tasks, (F.col("cell") == F.col("c1")) & (F.col("block") == F.col("b1"))).withColumn("side", F.lit(0))
    alone = (F.col("c1") == F.col("c2")) & (F.col("b1") == F.col("b2"))
    second = rows.join(tasks.where(~alone), (F.col("cell") == F.col("c2")) & (F.col("block") == F.col("b2"))).withColumn("side", F.lit(1))
    met = first.unionByName(second).select("c1", "b1", "c2", "b2", alone.alias("alone"), "side", "id", "rt", "files", "heights")

    def task(table: pa.Table) -> pa.Table:
        return _products(table, runs, rt_tol, least)

    return met.groupBy("c1", "b1", "c2", "b2").applyInArrow(task, PAIRS)


def _products(table: pa.Table, runs: int, rt_tol: float, least: float) -> pa.Table:
    """The pairs of two blocks, or of one with itself."""
    table = table.combine_chunks()
    ids, rt, side = (table[c].to_numpy() for c in ("id", "rt", "side"))
    alone, n = table["alone"][0].as_py(), len(ids)
    sizes = pc.list_value_length(table["files"]).to_numpy()
    row, files, heights = np.repeat(np.arange(n), sizes), *(pc.list_flatten(table[c]).to_numpy() for c in ("files", "heights"))
    total, squares = np.bincount(row, heights, n), np.bincount(row, heights * heights, n)
    spread = runs * squares - total * total
    mine, theirs = np.flatnonzero(side[row] == 0), np.flatnonzero(side[row] == (0 if alone else 1))
    theirs = theirs[np.argsort(files[theirs], kind="stable")]
    low, high = (np.searchsorted(files[theirs], files[mine], s) for s in ("left", "right"))
    count = high - low
    # chunks end between spots, so that a pair's products are summed at once
    ends = np.append(np.flatnonzero(np.diff(row[mine])) + 1, len(mine))
    done, start, out = np.concatenate(([0], np.cumsum(count))), 0, []
    while start < len(mine):
        end = ends[min(np.searchsorted(ends, np.searchsorted(done, done[start] + PRODUCTS, "right") - 1, "right") - 1, len(ends) - 1)]
        if end <= start:
            end = ends[np.searchsorted(ends, start, "right")]
        c = count[start:end]
        at = np.repeat(np.arange(start, end), c)
        there = theirs[np.arange(len(at)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[start:end], c)]
        here = mine[at]
        a, b = row[here], row[there]
        near = np.abs(rt[a] - rt[b]) <= rt_tol
        if alone:
            near &= ids[a] < ids[b]
        pair, where = np.unique(a[near] * n + b[near], return_inverse=True)
        dot = np.bincount(where, heights[here[near]] * heights[there[near]], len(pair))
        a, b = pair // n, pair % n
        with np.errstate(divide="ignore", invalid="ignore"):
            r = (runs * dot - total[a] * total[b]) / np.sqrt(spread[a] * spread[b])
        good = (spread[a] > 0) & (spread[b] > 0) & (r >= least - 1e-9)
        out.append((np.minimum(ids[a], ids[b])[good], np.maximum(ids[a], ids[b])[good], r[good]))
        start = end
    one, two, r = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.array([], np.int64), np.array([], np.int64), np.array([]))
    return pa.table({"one": pa.array(one, pa.int64()), "two": pa.array(two, pa.int64()), "correlation": pa.array(r, pa.float64())})


class Rows:
    """A batch of profiles over ``n`` runs: ``base`` everywhere but at some places, where it is
    ``base + more``."""

    def __init__(self, batch: pa.RecordBatch, n: int) -> None:
        self.n, self.base = n, batch["base"].to_numpy(zero_copy_only=False).astype(float)
        sizes = pc.list_value_length(batch["at"]).to_numpy(zero_copy_only=False)
        self.row, self.at = np.repeat(np.arange(len(self.base)), sizes), pc.list_flatten(batch["at"]).to_numpy(zero_copy_only=False)
        self.more = pc.list_flatten(batch["x"]).to_numpy(zero_copy_only=False) - self.base[self.row]

    def summed(self, weight: np.ndarray) -> np.ndarray:
        """Each row's sum of ``more`` times ``weight`` (a number a place)."""
        return np.bincount(self.row, self.more * weight, len(self.base))

    def dense(self, k: int) -> np.ndarray:
        out, mine = np.full(self.n, self.base[k]), self.row == k
        out[self.at[mine]] += self.more[mine]
        return out

    def totals(self, own: np.ndarray, k: int) -> np.ndarray:
        """Sum of each group's rows."""
        inside = np.bincount(own[self.row] * self.n + self.at, self.more, k * self.n).reshape(k, self.n)
        return np.bincount(own, self.base, k)[:, None] + inside

    def apart(self, centres: np.ndarray) -> np.ndarray:
        """Squared distances (rows, centres)."""
        own = self.n * self.base**2 + self.summed(2 * self.base[self.row] + self.more)
        cross = [self.base * c.sum() + self.summed(c[self.at]) for c in centres]
        return np.maximum(0.0, own[:, None] - 2 * np.stack(cross, axis=1) + (centres * centres).sum(1)[None])

    def deviations(self) -> tuple[np.ndarray, np.ndarray]:
        """Means over the runs less ``base``, and one over the deviations (0 for flat rows)."""
        mean = self.summed(np.ones(len(self.row))) / self.n
        squares = self.summed(self.more) - self.n * mean * mean
        spread = np.sqrt(np.maximum(0.0, squares) / max(self.n - 1, 1))
        flat = spread <= 1e-9 * np.maximum(np.abs(mean + self.base), 1e-300)
        return mean, np.where(flat, 0.0, 1 / np.where(flat, 1.0, spread))


def sparse_logs(values: DataFrame, files: DataFrame, share: float) -> DataFrame:
    """``spot_id, base, at, x``: log10 of heights above zero at their runs' places (in the order of
    ids), ``base`` at all other runs: ``share`` of the spot's smallest height."""
    # a row a run
    places = files.select("file_id").distinct().select("file_id", (F.row_number().over(Window.orderBy("file_id")) - 1).alias("at"))
    met = values.where("height > 0").join(places, "file_id", "left")
    pair = F.when(F.col("at").isNotNull(), F.struct("at", F.log10("height").alias("x")))
    held = met.groupBy("spot_id").agg(F.array_sort(F.collect_list(pair)).alias("p"), F.log10(F.min("height") * share).alias("base"))
    return held.select("spot_id", "base", F.col("p.at").alias("at"), F.col("p.x").alias("x"))

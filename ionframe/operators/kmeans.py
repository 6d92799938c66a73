"""k-means with seeded restarts: every pass over the points serves all restarts at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionframe.operators.profiles import Rows
from ionframe.tables import written

ROUNDS = 100


def chance(seed: int, restart: int, step: int, point: int) -> float:
    """A number in (0, 1) that a point draws, the same wherever the point lies."""
    return (crc32(f"{seed}:{restart}:{step}:{point}".encode()) + 0.5) / 4294967296


class Dense:
    """A batch of points ``x``."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.x = np.array(batch["x"].to_pylist(), float)

    def apart(self, centres: np.ndarray) -> np.ndarray:
        """Squared distances (points, centres)."""
        return np.maximum(0.0, (self.x * self.x).sum(1)[:, None] - 2 * self.x @ centres.T + (centres * centres).sum(1)[None])

    def dense(self, k: int) -> np.ndarray:
        return self.x[k]

    def totals(self, own: np.ndarray, k: int) -> np.ndarray:
        """Sum of each group's points."""
        return np.stack([self.x[own == g].sum(0) for g in range(k)])


def _seeded(points: DataFrame, read: Callable, k: int, restarts: int, seed: int) -> list[np.ndarray]:
    """k-means++ centres of each restart: the point with the largest log(u) / d2 is a draw in
    proportion to d2, so a step is one pass and one row a restart."""
    centres: list[list[list[float]]] = [[] for _ in range(restarts)]
    for step in range(k):

        def offer(batches: Iterator[pa.RecordBatch], step: int = step) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, x = batch["id"].to_pylist(), read(batch)
                for r in range(restarts):
                    d = x.apart(np.array(centres[r])).min(1).tolist() if step else [1.0] * len(ids)
                    for i, w in enumerate(d):
                        if w > 0:
                            key = (log(chance(seed, r, step, ids[i])) / w, -ids[i])
                            if r not in best or key > best[r][0]:
                                best[r] = key, x.dense(i).tolist()
            rows = [(r, key[0], -key[1], x) for r, (key, x) in best.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())), strict=True)], names=["restart", "key", "id", "x"])

        made = points.mapInArrow(offer, "restart int, key double, id long, x array<double>")
        for r, x in made.groupBy("restart").agg(F.max_by("x", F.struct("key", -F.col("id")))).collect():
            centres[r].append(x)
    return [np.array(c) for c in centres]


def _moved(points: DataFrame, read: Callable, centres: list[np.ndarray]) -> tuple[list[np.ndarray], list[float]]:
    """Means of the points nearest to each centre (of none: the centre), and each restart's sum
    of squares to the centres given. Tasks' sums are added in the order of tasks, so that a
    restart at rest gives the same numbers again."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[0, 0.0, 0.0] for _ in centres]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = read(batch)
            for h, c in zip(held, centres, strict=True):
                d = x.apart(c)
                own = d.argmin(1)
                h[0], h[1], h[2] = h[0] + np.bincount(own, minlength=len(c)), h[1] + np.bincount(own, d[np.arange(len(d)), own], len(c)), h[2] + x.totals(own, len(c))
        part = TaskContext.get().partitionId()
        rows = [(part, r, k, int(n), float(s), t.tolist()) for r, h in enumerate(held) if np.ndim(h[0]) for k, (n, s, t) in enumerate(zip(*h, strict=True)) if n]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64())), strict=True)], names=["part", "restart", "k", "n", "squares", "total"])

    def added(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total = np.sum([np.array(t) for t in table["total"].to_pylist()], axis=0)
        return pa.table({"restart": table["restart"][:1], "k": table["k"][:1], "n": pa.array([sum(table["n"].to_pylist())], pa.int64()), "squares": pa.array([sum(table["squares"].to_pylist())]), "total": pa.array([total.tolist()], pa.list_(pa.float64()))})

    schema = "restart int, k int, n long, squares double, total array<double>"
    new, squares = [c.copy() for c in centres], [0.0] * len(centres)
    made = points.mapInArrow(sums, f"part int, {schema}").groupBy("restart", "k").applyInArrow(added, schema).collect()  # a row a centre
    for r, k, n, s, total in sorted(made, key=lambda m: (m[0], m[1])):
        new[r][k] = np.array(total) / n
        squares[r] += s
    return new, squares


def clustered(points: DataFrame, k: int, restarts: int = 20, seed: int = 1, runs: int | None = None) -> DataFrame:
    """``id, cluster, within``: points (``id, x``) by the nearest centre of the restart with the
    least sum of squares (ties: the first), which is ``within``. Clusters are numbered by
    the order in which their seeds were drawn; only centres reach the driver. With ``runs``
    points are ``profiles.Rows`` (``id, base, at, x``) of so many places."""
    read = Dense if runs is None else lambda batch: Rows(batch, runs)
    points = written(points.select("id", "x") if runs is None else points.select("id", "base", "at", "x"), "points")
    centres = _seeded(points, read, k, restarts, seed)
    squares, moving = [0.0] * restarts, list(range(restarts))
    for turn in range(ROUNDS + 1):
        new, told = _moved(points, read, [centres[r] for r in moving])  # restarts at rest stay out
        still = []
        for r, c, s in zip(moving, new, told, strict=True):
            squares[r] = s
            if not np.array_equal(centres[r], c):
                still.append(r)
                if turn < ROUNDS:
                    centres[r] = c
        moving = still
        if not moving:
            break
    best = int(np.argmin(np.round(squares, 9)))
    chosen, within = centres[best], squares[best]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = read(batch).apart(chosen).argmin(1)
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(own, pa.int32()), pa.array([within] * batch.num_rows)], names=["id", "cluster", "within"])

    return points.mapInArrow(place, "id long, cluster int, within double")

"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors become integers, floor(64 x). Candidates are cut into blocks of
``BLOCK`` rows (of one length) along a sort key that puts similar vectors
together; a block's forward index is its id list and integer matrix, with the
largest and smallest value of each term. For a query, a block's bound is the sum
over terms of the larger of q*max and q*min. Blocks are visited from the highest
bound down and scored through their forward index until the bound falls below
the query's k-th best score so far.

The work is a grid: groups of blocks (cells) times groups of queries, each pair one
cogrouped task; it returns at most k rows a query and a last aggregation merges them.
Each query first scores a bounded set of seed rows (``SEEDS``): the k-th best score
among some candidates is a lower bound of the final one. It is then sent only to cells
whose own bound reaches that score, as long as the cells' bounds are small enough
(``BOUND_BYTES``) to go to the tasks; beyond that it is sent to all of them.

Edge cases: rows without a vec_id, and vectors that are null, empty, or hold null or
non-finite components, take no part; a query meets only candidates of its own length; repeated ids are
separate candidates, but none that carries the query's id; ties go to the
smaller vec_id; fewer than k candidates give all; an empty table gives no rows.
Scores are 64-bit integers; where a product could pass 2**53 integer arithmetic
replaces the exact floating-point one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionframe.llm.shared import groups_for, rows_made, written

BLOCK = 256
BLOCKS_PER_CELL = 32
QUERIES_PER_CELL = 4096
SEEDS = 1024
#: Cell bounds (two integers a term and cell) that may be sent to all tasks.
BOUND_BYTES = 64 << 20
SCALE = 64
HIT = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` (integers) of the valid rows."""
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & sound).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _sort_key() -> Column:
    """Signs of the first twelve terms: near vectors lie close."""
    bits = [F.when(F.coalesce(F.try_element_at("v", F.lit(k + 1)), F.lit(0)) > 0, F.lit(1 << (11 - k))).otherwise(F.lit(0)) for k in range(12)]
    out = bits[0]
    for b in bits[1:]:
        out = out + b
    return out


def block_index(rows: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """Forward index: ``cell, dim, ids, data, hi, lo``; ``n`` is the number of rows.

    A range partitioning by (length, sort key, id) gives runs of rows; each run is
    cut into blocks as it streams by, so no group is ever gathered. A row without ids
    ends each cell and length: its ``hi`` and ``lo`` hold for all blocks of the cell.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int] = []
        data: list[np.ndarray] = []
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def row(ids: bytes, data: bytes, hi: np.ndarray, lo: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"dim": [len(hi)], "ids": [ids], "data": [data], "hi": [hi.tobytes()], "lo": [lo.tobytes()]})

        def made() -> pd.DataFrame:
            m, i = np.stack(data).astype("<i8"), np.array(ids, "<i8")
            ids.clear(), data.clear()
            hi, lo = m.max(0), m.min(0)
            top, low = bounds.get(len(hi), (hi, lo))
            bounds[len(hi)] = np.maximum(top, hi), np.minimum(low, lo)
            return row(i.tobytes(), m.tobytes(), hi, lo)

        for batch in batches:
            for vec_id, v in zip(batch["vec_id"], batch["v"], strict=True):
                if data and (len(data) >= block or len(data[0]) != len(v)):
                    yield made()
                ids.append(vec_id)
                data.append(v)
        if data:
            yield made()
        for hi, lo in bounds.values():
            yield row(b"", b"", hi, lo)

    parts = groups_for(n, block * BLOCKS_PER_CELL)
    ordered = rows.repartitionByRange(parts, F.size("v"), _sort_key(), "vec_id").sortWithinPartitions(F.size("v"), _sort_key(), "vec_id")
    made = ordered.mapInPandas(run, "dim int, ids binary, data binary, hi binary, lo binary")
    return made.withColumn("cell", F.spark_partition_id())


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def upper(q: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Largest inner product that rows between ``lo`` and ``hi`` can have with each query."""
    return dot(np.maximum(q, 0), hi) + dot(np.minimum(q, 0), lo)


#: Below every score, and its negative still fits.
NOTHING = -np.iinfo(np.int64).max


def asked(queries: DataFrame, k: int, seeds: tuple[np.ndarray, np.ndarray] | None, bounds: list[tuple], cells: int) -> DataFrame:
    """``vec_id, v, cell, least``: each query for the cells that can reach its k-th best
    score among the seeds (``least``). bounds: ``cell, dim, hi, lo``; empty: all cells."""

    def start() -> Callable:
        told: dict[int, tuple] = {}
        for dim in {b[1] for b in bounds}:
            own = [b for b in bounds if b[1] == dim]
            told[dim] = (np.array([b[0] for b in own]), *(np.stack([np.frombuffer(b[i], "<i8") for b in own]) for i in (2, 3)))

        def run(batch: pa.RecordBatch) -> tuple[np.ndarray, dict]:
            ids, v = batch.column("vec_id").to_numpy(), batch.column("v").to_pylist()
            dims = np.array([len(x) for x in v], np.int64)
            of, cell, least = [], [], []
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                q = np.array([v[i] for i in at.tolist()], np.int64)
                low = np.full(len(at), NOTHING)
                if seeds is not None and seeds[1].shape[1] == dim and len(seeds[0]) >= k:
                    # the query's own row is below all others
                    found = np.where(seeds[0][None, :] == ids[at][:, None], NOTHING, dot(q, seeds[1]))
                    low = -np.partition(-found, k - 1, axis=1)[:, k - 1]
                if bounds:
                    own, hi, lo = told.get(dim, (np.array([], np.int64), np.zeros((0, dim), np.int64), np.zeros((0, dim), np.int64)))
                    row, column = np.nonzero(upper(q, hi, lo) >= low[:, None])
                    of.append(at[row]), cell.append(own[column]), least.append(low[row])
                else:
                    of.append(np.repeat(at, cells)), cell.append(np.tile(np.arange(cells), len(at))), least.append(np.repeat(low, cells))
            joined = lambda parts: np.concatenate(parts) if parts else np.array([], np.int64)
            return joined(of), {"cell": joined(cell), "least": joined(least)}

        return run

    return rows_made(queries.select("vec_id", "v"), ["vec_id", "v"], {"cell": "int", "least": "long"}, start)


def _cell(k: int) -> object:
    def matrix(blob: bytes, dim: int) -> np.ndarray:
        return np.frombuffer(blob, "<i8").reshape(-1, dim)

    def best(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]

    def run(key: tuple, blocks: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if blocks.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        out = []
        for dim, asked_ in queries.groupby(queries["v"].map(len)):
            own = blocks[blocks["dim"] == dim]
            if own.empty:
                continue
            q_ids, q, least = asked_["vec_id"].to_numpy(), np.stack(asked_["v"].to_numpy()).astype(np.int64), asked_["least"].to_numpy().copy()
            hi, lo = np.stack([np.frombuffer(b, "<i8") for b in own["hi"]]), np.stack([np.frombuffer(b, "<i8") for b in own["lo"]])
            bound = upper(q, hi, lo)
            kept = [(np.array([], np.int64), np.array([], np.int64))] * len(q)
            order = np.argsort(-bound, axis=1, kind="stable")
            index = [(np.frombuffer(i, "<i8"), matrix(d, dim)) for i, d in zip(own["ids"], own["data"], strict=True)]
            alive = np.arange(len(q))
            for turn in range(len(own)):
                now = order[alive, turn]
                go = bound[alive, now] >= least[alive]
                alive, now = alive[go], now[go]
                if not len(alive):
                    break
                for b in np.unique(now).tolist():
                    here = alive[now == b]
                    ids, data = index[b]
                    scores = dot(q[here], data)
                    for row, at in enumerate(here.tolist()):
                        take = (scores[row] >= least[at]) & (ids != q_ids[at])
                        if take.any():
                            kept[at] = best(np.concatenate((kept[at][0], ids[take])), np.concatenate((kept[at][1], scores[row][take])))
                            if len(kept[at][1]) == k:
                                least[at] = max(least[at], kept[at][1][-1])
            out += [pd.DataFrame({"query_id": q_ids[at], "vec_id": ids, "score": scores}) for at, (ids, scores) in enumerate(kept) if len(ids)]
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` for quantised rows (``vec_id, v``)."""
    rows = written(candidates, "vectors")
    n = rows.count()
    index = written(block_index(rows, n), "blocks")
    blocks, ends = index.where("ids != x''"), index.where("ids = x''")
    seed_rows = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEEDS).collect() if n else []
    dims = {len(r["v"]) for r in seed_rows}
    seeds = (np.array([r["vec_id"] for r in seed_rows]), np.array([r["v"] for r in seed_rows], np.int64)) if len(dims) == 1 else None
    size = ends.agg((F.max("cell") + 1).alias("cells"), F.sum(F.octet_length("hi") + F.octet_length("lo")).alias("bytes")).first()
    small = (size["bytes"] or 0) <= BOUND_BYTES
    bounds = [tuple(r) for r in ends.select("cell", "dim", "hi", "lo").collect()] if small else []
    groups = groups_for(queries.count(), QUERIES_PER_CELL, 1)
    # the stated query set against all rows, in blocks: a group of blocks visits the
    # groups of queries, a query the cells that can hold one of its best
    left = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asked(queries, k, seeds, bounds, size["cells"] or 0).withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    hits = left.groupBy("cell", "group").cogroup(right.groupBy("cell", "group")).applyInPandas(_cell(k), HIT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """Rows whose vec_id is divisible by ``every`` against all other rows."""
    rows = quantised(embeddings)
    return top_k(rows, rows.where(F.col("vec_id") % every == 0), k)

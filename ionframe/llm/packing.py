"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token pieces of at most ``capacity`` tokens; only longer
documents are cut, the remainder coming first so that all later pieces are full
sequences by themselves. Pieces are dealt by hash into instances of about
``ITEMS`` pieces, and every instance is evolved on several islands, one Spark
group each. An individual is a set of bins. Crossover takes whole well-filled
bins of one parent, drops the other parent's bins that hold a document twice,
and best-fits the displaced pieces, largest first; mutation dissolves a few
badly filled bins. Islands begin with best fit in random orders, the first one also
with largest-first best fit. After each epoch the best individuals of every island
also move to the next island of a ring (a shuffle), and at last the individual with
the fewest bins wins its instance. An island that holds one at the lower bound stops.

Edge cases: null text is empty and one token (the end id) long; texts of any length
are encoded whole; ties between individuals go to the lower island; repeated rows are
pieces of their own; a null doc_id stays null; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionframe.llm.shared import groups_for, rows_made, text_or_empty, written
from ionframe.llm.tokens import byte_encoder

CAPACITY = 2048
END_ID = 0
ITEMS = 8192
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 6
POPULATION = 4
ELITES = 2

FIELDS = {"piece": "int", "start": "long", "length": "long", "ids_crc32": "long"}
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, encoder: str | None = None) -> DataFrame:
    """Pieces of every document's ids (end id included)."""

    def start() -> Callable:
        encode = byte_encoder(encoder).encode
        end = np.array([END_ID], "<u4").tobytes()

        def run(batch: pa.RecordBatch) -> tuple[list, dict]:
            of: list[int] = []
            made: dict[str, list] = {f: [] for f in FIELDS}
            for at, ids in enumerate(encode(batch.column("text").to_pylist())):
                ids += end
                n = len(ids) // 4
                cuts = [0, n] if n <= capacity else [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    of.append(at)
                    for f, value in zip(FIELDS, (k, a, b - a, zlib.crc32(ids[4 * a:4 * b])), strict=True):
                        made[f].append(value)
            return of, made

        return run

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows_made(texts, ["doc_id"], FIELDS, start)


class Bins:
    """Bins under best fit: for each free size, the bins that have it; a bit mask
    over free sizes finds the tightest that still takes a piece."""

    def __init__(self, free: np.ndarray, capacity: int):
        self.capacity, self.count, self.mask = capacity, len(free), 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        for b, f in enumerate(free.tolist()):
            self.by_free[f].append(b)
        for f, bins in enumerate(self.by_free):
            if bins:
                self.mask |= 1 << f

    def place(self, size: int) -> int:
        fits = self.mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bins = self.by_free[free]
            b = bins.pop()
            if not bins:
                self.mask &= ~(1 << free)
        else:
            free, b = self.capacity, self.count
            self.count += 1
        left = free - size
        if not self.by_free[left]:
            self.mask |= 1 << left
        self.by_free[left].append(b)
        return b


def best_fit(assign: np.ndarray, sizes: np.ndarray, loose: np.ndarray, capacity: int, ordered: bool = False) -> np.ndarray:
    """Places the loose pieces, largest first unless they are ``ordered``; the others stay
    in their bins (-1: none)."""
    assign = assign.copy()
    held = np.ones(len(sizes), bool)
    held[loose] = False
    names, packed = np.unique(assign[held], return_inverse=True)
    assign[held] = packed
    free = capacity - np.bincount(packed, sizes[held], minlength=len(names)).astype(np.int64)
    bins = Bins(free, capacity)
    order = loose if ordered else loose[np.argsort(-sizes[loose], kind="stable")]
    for k, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        assign[k] = bins.place(size)
    return assign


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The larger of the volume bound and Martello and Toth's bound L2."""
    best, ordered = -(-int(sizes.sum()) // capacity), np.sort(sizes)
    total = np.concatenate(([0], np.cumsum(ordered)))
    half = np.searchsorted(ordered, capacity // 2, "right")
    for k in np.unique(ordered[ordered <= capacity // 2]).tolist():
        low, high = np.searchsorted(ordered, k, "left"), np.searchsorted(ordered, capacity - k, "right")
        n1, n2 = len(ordered) - high, high - half
        room = n2 * capacity - (total[high] - total[half])
        best = max(best, int(n1 + n2 + max(0, -(-int(total[half] - total[low] - room) // capacity))))
    return best


def fitness(assign: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller bins (mean squared fill); larger is better."""
    fills = np.bincount(assign, sizes) / capacity
    return -len(fills), float((fills**2).mean())


def crossover(one: np.ndarray, two: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    fills = np.bincount(two, sizes) / capacity
    good = np.flatnonzero(fills >= np.quantile(fills, 0.5))
    chosen = np.zeros(len(fills), bool)
    chosen[good[rng.random(len(good)) < rng.uniform(0.1, 0.5)]] = True
    injected = chosen[two]
    hit = np.zeros(one.max() + 1, bool)
    hit[one[injected]] = True
    child = np.where(injected, two + one.max() + 1, one)
    return best_fit(child, sizes, np.flatnonzero(hit[one] & ~injected), capacity)


def mutate(one: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    fills = np.bincount(one, sizes)
    worst = np.argsort(fills + rng.random(len(fills)))[: max(2, len(fills) // 50)]
    mixed = np.union1d(worst, rng.integers(0, len(fills), max(2, len(fills) // 50)))
    return best_fit(one, sizes, np.flatnonzero(np.isin(one, mixed)), capacity)


def seeded(sizes: np.ndarray, capacity: int, rng: np.random.Generator, decreasing: bool) -> list[np.ndarray]:
    """First individuals: best fit in random orders, and in decreasing order if asked for."""
    nobody, everything = np.full(len(sizes), -1), np.arange(len(sizes))
    people = [best_fit(nobody, sizes, everything, capacity)] if decreasing else []
    while len(people) < POPULATION:
        people.append(best_fit(nobody, sizes, rng.permutation(len(sizes)), capacity, ordered=True))
    return people


def evolve(sizes: np.ndarray, elites: list[np.ndarray], seed: int, capacity: int, generations: int, decreasing: bool = True) -> list[np.ndarray]:
    """The best individuals of an island after some generations.

    Islands start from different people; one that has none at its lower bound goes on by
    crossover and mutation until it has, or the generations end.
    """
    rng = np.random.default_rng(seed)
    bound = lower_bound(sizes, capacity)
    people = elites or seeded(sizes, capacity, rng, decreasing)
    score = lambda p: fitness(p, sizes, capacity)
    people.sort(key=score, reverse=True)
    for _ in range(generations):
        if -score(people[0])[0] <= bound or len(people) < 2:
            break
        a, b = rng.choice(len(people), 2, replace=False)
        people.append(crossover(people[a], people[b], sizes, capacity, rng))
        people.append(mutate(people[int(rng.integers(len(people)))], sizes, capacity, rng))
        people = sorted(people, key=score, reverse=True)[:POPULATION]
    return people[:ELITES]


ELITE = pa.schema([("inst", pa.int32()), ("island", pa.int32()), ("bins", pa.int64()), ("fill", pa.float64()), ("assign", pa.binary())])
ELITE_DDL = "inst int, island int, bins long, fill double, assign binary"


def _island_rows(inst: int, island: int, people: list[np.ndarray], sizes: np.ndarray, capacity: int) -> pa.Table:
    rows = [(inst, island, -f[0], f[1], p.astype("<i4").tobytes()) for p in people for f in [fitness(p, sizes, capacity)]]
    columns = list(zip(*rows, strict=True)) or [()] * len(ELITE)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, ELITE.types, strict=True)], schema=ELITE)


def _ordered(items: pa.Table) -> pa.Table:
    """One order of an instance's pieces, the same on all islands."""
    keys = [(c, "ascending") for c in ("doc_id", "piece", "ids_crc32", "length")]
    return items.take(pc.sort_indices(items, sort_keys=keys))


def _epoch(at: int, capacity: int, generations: int) -> Callable:
    def run(key: tuple, items: pa.Table, elites: pa.Table) -> pa.Table:
        inst, island = (k.as_py() for k in key)
        if not items.num_rows:
            return _island_rows(inst, island, [], np.array([], np.int64), capacity)
        sizes = _ordered(items)["length"].to_numpy()
        people = [np.frombuffer(a, "<i4").astype(np.int64) for a in elites["assign"].to_pylist()]
        best = evolve(sizes, people, 1000 * at + 10 * inst + island, capacity, generations, decreasing=island == 0)
        return _island_rows(inst, island, best, sizes, capacity)

    return run


def _place(capacity: int) -> Callable:
    """Bins as sequences; pieces of the whole capacity are sequences by themselves."""

    def run(key: tuple, rows: pa.Table, best: pa.Table) -> pa.Table:
        is_loose = pc.less(rows["length"], capacity)
        loose, full = _ordered(rows.filter(is_loose)), rows.filter(pc.invert(is_loose))
        bins = np.frombuffer(best["assign"][0].as_py(), "<i4").astype(np.int64) if loose.num_rows else np.array([], np.int64)
        order = np.argsort(bins, kind="stable")
        loose, bins = loose.take(pa.array(order)), bins[order]
        ends = np.cumsum(loose["length"].to_numpy())
        starts = ends - loose["length"].to_numpy()
        offsets = starts - starts[np.searchsorted(bins, bins, "left")] if len(bins) else starts
        alone = np.arange(full.num_rows) + (bins.max() + 1 if len(bins) else 0)
        sequence = key[0].as_py() * (1 << 40) + np.concatenate([bins, alone])
        out = pa.concat_tables([loose, full]).select(["doc_id", *FIELDS])
        offset = np.concatenate([offsets, np.zeros(full.num_rows, np.int64)])
        return out.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to written pieces.

    Instances are dealt by the pieces' running number ``turn``, so that pieces that are alike
    (repeated rows, null doc_ids) spread like any others; without one by what they hold.
    """
    n = groups_for(pieces.count(), ITEMS)
    told = ["turn"] if "turn" in pieces.columns else ["doc_id", "piece", "ids_crc32"]
    spread = pieces.withColumn("inst", F.pmod(F.xxhash64(*told), F.lit(n)).cast("int"))
    items = spread.where(F.col("length") < capacity).select("inst", "doc_id", "piece", "ids_crc32", "length").withColumn("island", F.explode(F.array(*[F.lit(k) for k in range(islands)])))
    elites = pieces.sparkSession.createDataFrame([], ELITE_DDL)
    for at in range(epochs):
        # everyone stays at home, and the elites also visit the next island of the ring
        visiting = elites.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int"))
        there = elites.unionByName(visiting) if islands > 1 else elites
        grown = items.groupBy("inst", "island").cogroup(there.groupBy("inst", "island"))
        elites = written(grown.applyInArrow(_epoch(at, capacity, generations), ELITE_DDL), "elites")
    best = elites.groupBy("inst").agg(F.min_by("assign", F.struct("bins", -F.col("fill"), "island")).alias("assign"))
    return spread.groupBy("inst").cogroup(best.groupBy("inst")).applyInArrow(_place(capacity), PLACED)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    return pack(written(token_pieces(docs, capacity).withColumn("turn", F.monotonically_increasing_id()), "pieces"), capacity)

"""Exact dedup: a cuckoo-filter index over live digests.

Texts are equal when they agree after every run of ``[\\x20\\x09-\\x0D]`` has
become one space. The index is split into hash buckets. A bucket holds a cuckoo
filter over its live digests and, as its content, a row for each digest (smallest
doc_id, number of documents). Documents of a bucket arrive in the order of their ids:
one that the filter misses is new and enters filter and content; a hit is looked up
in the content, and only the full SHA-256 there makes it a copy. A filter that
overflows is rebuilt at twice the size from the stored digests. When no live document
carries a digest any more, it leaves filter and content.

Each task first merges the copies that it holds itself, so a group with a third of all
rows sends its bucket one row a task. Changes read and replace the tables' rows of the
buckets that they touch, and no others.

Edge cases: null text counts as empty, all empty texts form one group; texts of any
length are read whole; a null ``doc_id`` never wins over a number; repeated rows count
in ``group_size`` and rows that repeat the winning ``doc_id`` are all marked kept (they
are the same document); an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionframe.llm.shared import BROADCAST_IDS, groups_for, keep_documents, release, small_batches, text_or_empty, written

SPACES = r"[\x20\x09-\x0D]+"
SLOTS = 4
DIGESTS_PER_BUCKET = 20_000
#: Distinct digests that a task holds before it sends them on.
GATHER = 100_000


class CuckooFilter:
    """Partial-key cuckoo filter over 64-bit keys: 16-bit fingerprints, 4 slots."""

    def __init__(self, buckets: int = 64, cells: bytes | None = None):
        self.buckets = buckets
        self.cells = np.zeros(buckets * SLOTS, np.uint16) if cells is None else np.frombuffer(cells, np.uint16).copy()

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 64
        while buckets * SLOTS * 0.9 < keys:
            buckets *= 2
        return cls(buckets)

    def _places(self, key: int) -> tuple[int, int, int]:
        print_ = (key & 0xFFFF) or 1
        first = (key >> 16) & (self.buckets - 1)
        return print_, first, self._other(first, print_)

    def _other(self, place: int, print_: int) -> int:
        return place ^ ((print_ * 0x5BD1E995 >> 7) & (self.buckets - 1))

    def _slot(self, place: int, print_: int) -> int:
        start = place * SLOTS
        for k in range(start, start + SLOTS):
            if self.cells[k] == print_:
                return k
        return -1

    def insert(self, key: int, kicks: int = 200) -> bool:
        """False when no room was found: the filter must then be rebuilt."""
        print_, place, other = self._places(key)
        for at in (place, other):
            if (k := self._slot(at, 0)) >= 0:
                self.cells[k] = print_
                return True
        at = other
        for turn in range(kicks):
            k = at * SLOTS + (print_ + turn) % SLOTS
            print_, self.cells[k] = int(self.cells[k]), print_
            at = self._other(at, print_)
            if (k := self._slot(at, 0)) >= 0:
                self.cells[k] = print_
                return True
        return False

    def __contains__(self, key: int) -> bool:
        print_, place, other = self._places(key)
        return self._slot(place, print_) >= 0 or self._slot(other, print_) >= 0

    def delete(self, key: int) -> bool:
        print_, place, other = self._places(key)
        for at in (place, other):
            if (k := self._slot(at, print_)) >= 0:
                self.cells[k] = 0
                return True
        return False

    def dump(self) -> bytes:
        return self.cells.tobytes()

    @classmethod
    def load(cls, cells: bytes) -> CuckooFilter:
        return cls(len(cells) // (2 * SLOTS), cells)


def key_of(digest: str) -> int:
    return int(digest[-16:], 16)


def rebuilt(digests: list[str], buckets: int) -> CuckooFilter:
    """A filter of ``buckets`` buckets or, where they overflow, more."""
    while True:
        bigger = CuckooFilter(buckets)
        if all(bigger.insert(key_of(d)) for d in digests):
            return bigger
        buckets *= 2


class Bucket:
    """Filter and content of one bucket while it changes."""

    def __init__(self, stored: pa.Table | None = None, expected: int = 0):
        self.content: dict[str, list] = {}
        cells = None
        for row in stored.to_pylist() if stored is not None else ():
            if row["digest"] is None:
                cells = row["cells"]
            else:
                self.content[row["digest"]] = [row["keep_id"], row["group_size"]]
        self.filter = CuckooFilter.load(cells) if cells is not None else CuckooFilter.sized(max(expected, len(self.content)))

    def find(self, digest: str) -> list | None:
        """Content is read only on a hit, and only the whole digest counts."""
        return self.content.get(digest) if key_of(digest) in self.filter else None

    def insert(self, digest: str, doc_id: int | None, n: int) -> None:
        known = self.find(digest)
        if known is not None:
            known[:] = [smaller(known[0], doc_id), known[1] + n]
            return
        self.content[digest] = [doc_id, n]
        if not self.filter.insert(key_of(digest)):
            self.filter = rebuilt(list(self.content), self.filter.buckets * 2)

    def delete(self, digest: str) -> None:
        if self.find(digest) is not None:
            del self.content[digest]
            self.filter.delete(key_of(digest))

    def table(self, bucket: int) -> pa.Table:
        rows = [(bucket, d, k, n, None) for d, (k, n) in self.content.items()]
        rows.append((bucket, None, None, None, self.filter.dump()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), STATE.types, strict=True)], schema=STATE)


#: A bucket's rows: one a digest, and one without a digest for the filter's cells.
STATE = pa.schema([("bucket", pa.int32()), ("digest", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("cells", pa.binary())])
STATE_DDL = "bucket int, digest string, keep_id long, group_size long, cells binary"
PARTIAL = pa.schema([("digest", pa.string()), ("keep_id", pa.int64()), ("n", pa.int64())])


def smaller(a: int | None, b: int | None) -> int | None:
    """The smaller id; None never wins over a number."""
    return b if a is None else a if b is None else min(a, b)


def text_digest(col: str = "text") -> Column:
    return F.sha2(F.regexp_replace(text_or_empty(col), SPACES, " ").cast("binary"), 256)


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, digest`` of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"))


def merged(rows: DataFrame) -> DataFrame:
    """``digest, keep_id, n``: the copies that one task holds become one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def sent() -> pa.RecordBatch:
            ids, counts = [v[0] for v in held.values()], [v[1] for v in held.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], schema=PARTIAL)

        for batch in batches:
            for digest, doc_id in zip(batch.column("digest").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
                known = held.get(digest)
                if known is None:
                    held[digest] = [doc_id, 1]
                else:
                    known[:] = [smaller(known[0], doc_id), known[1] + 1]
            if len(held) >= GATHER:
                yield sent()
                held = {}
        yield sent()
        release()

    return rows.select("doc_id", "digest").mapInArrow(run, "digest string, keep_id long, n long")


def _bucket(n: int) -> Column:
    return F.pmod(F.conv(F.substring("digest", 1, 12), 16, 10).cast("long"), F.lit(n)).cast("int").alias("bucket")


def _inserted(key: tuple, new: pa.Table, stored: pa.Table) -> pa.Table:
    bucket = Bucket(stored, new.num_rows)
    rows = list(zip(*(new.column(c).to_pylist() for c in ("keep_id", "digest", "n")), strict=True))
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    for doc_id, digest, n in rows:
        bucket.insert(digest, doc_id, n)
    return bucket.table(key[0].as_py())


def _deleted(key: tuple, left: pa.Table, stored: pa.Table) -> pa.Table:
    """``left``: what is still live of the digests that lost documents (n = 0: nothing)."""
    bucket = Bucket(stored)
    rows = list(zip(*(left.column(c).to_pylist() for c in ("digest", "keep_id", "n")), strict=True))
    for digest, _, _ in rows:
        bucket.delete(digest)
    for digest, doc_id, n in rows:
        if n:
            bucket.insert(digest, doc_id, n)
    return bucket.table(key[0].as_py())


def _found(key: tuple, asked: pa.Table, stored: pa.Table) -> pa.Table:
    bucket = Bucket(stored)
    hits = [(d, *v) for d in asked.column("digest").to_pylist() if (v := bucket.find(d)) is not None]
    columns = list(zip(*hits, strict=True)) if hits else [[], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["digest", "keep_id", "group_size"])


class CuckooIndex:
    """Live documents by digest. Every change returns a new index (tables are immutable).

    live: ``bucket, doc_id, digest``, a row a document; state: the buckets' filters and
    contents. A change writes the rows of the buckets that it touches anew; the new
    tables are those rows and, unread, the others of the old ones.
    """

    def __init__(self, live: DataFrame, state: DataFrame, buckets: int):
        self.live, self.state, self.buckets = live, state, buckets

    @classmethod
    def build(cls, live: DataFrame, buckets: int | None = None) -> CuckooIndex:
        """live: ``doc_id, digest`` rows, read twice (write them first if costly)."""
        small_batches(live.sparkSession)
        n = buckets or groups_for(live.count(), DIGESTS_PER_BUCKET, 256)
        none = live.sparkSession.createDataFrame([], STATE_DDL)
        live = live.select(_bucket(n), "doc_id", "digest")
        return cls(live, cls._changed(merged(live).withColumn("bucket", _bucket(n)), none, _inserted), n)

    @staticmethod
    def _changed(change: DataFrame, state: DataFrame, how: Callable) -> DataFrame:
        return written(change.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(how, STATE_DDL), "cuckoo")

    @property
    def entries(self) -> DataFrame:
        """``digest, keep_id, group_size`` of every live digest."""
        return self.state.where("digest is not null").select("digest", "keep_id", "group_size")

    def insert(self, more: DataFrame) -> CuckooIndex:
        """Adds ``doc_id, digest`` rows."""
        more = written(more.select(_bucket(self.buckets), "doc_id", "digest"), "more")
        touched = written(more.select("bucket").distinct(), "touched")
        change = merged(more).withColumn("bucket", _bucket(self.buckets))
        state = self._changed(change, within(self.state, touched), _inserted)
        return CuckooIndex(self.live.unionByName(more), outside(self.state, touched).unionByName(state), self.buckets)

    def delete(self, gone: DataFrame) -> CuckooIndex:
        """Drops the documents whose ``doc_id, digest`` appear in ``gone``."""
        gone = written(gone.select(_bucket(self.buckets), "doc_id", "digest").distinct(), "gone")
        touched = written(gone.select("bucket").distinct(), "touched")
        before = within(self.live, touched)
        same = before["doc_id"].eqNullSafe(gone["doc_id"]) & (before["digest"] == gone["digest"])
        left = written(before.join(gone, same, "left_anti"), "live")
        asked = gone.select("digest").distinct()
        still = merged(left.join(asked, "digest", "left_semi"))
        nothing = asked.select("digest", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("n"))
        change = still.unionByName(nothing).withColumn("bucket", _bucket(self.buckets))
        state = self._changed(change, within(self.state, touched), _deleted)
        return CuckooIndex(outside(self.live, touched).unionByName(left), outside(self.state, touched).unionByName(state), self.buckets)

    def lookup(self, rows: DataFrame) -> DataFrame:
        """``digest, keep_id, group_size`` of the distinct digests in ``rows`` that are live."""
        asked = rows.select("digest").distinct().select(_bucket(self.buckets), "digest")
        return asked.groupBy("bucket").cogroup(self.state.groupBy("bucket")).applyInArrow(_found, "digest string, keep_id long, group_size long")


def _some(touched: DataFrame) -> DataFrame:
    return F.broadcast(touched) if touched.count() <= BROADCAST_IDS else touched


def within(rows: DataFrame, touched: DataFrame) -> DataFrame:
    return rows.join(_some(touched), "bucket", "left_semi")


def outside(rows: DataFrame, touched: DataFrame) -> DataFrame:
    return rows.join(_some(touched), "bucket", "left_anti")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = written(digests(docs), "digests")
    index = CuckooIndex.build(rows)
    return rows.join(index.entries, "digest").select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with the row of the smallest doc_id of each group of equal texts."""
    rows = written(exact_groups(docs).select("doc_id", F.col("text_sha256").alias("key"), "kept"), "groups")
    return keep_documents(docs, rows.where("kept"), rows.select("doc_id", "key"), text_digest())

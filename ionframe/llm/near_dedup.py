"""Near-duplicate documents by order MinHash, verified by banded alignment.

A text's k-mers are its runs of five words (lower-cased), labelled with their
occurrence number, so that every labelled k-mer is unique in its text. A sketch
takes the ``PICK`` labelled k-mers with the smallest hashes and keeps them in
text order; two texts share a sketch when the same k-mers come in the same
order, which follows edit similarity rather than set overlap. ``TABLES``
independent sketches make missing a pair of similarity 0.8 a matter of one in
some thousands.

Verification aligns the two k-mer sequences inside the band that a similarity of
0.8 allows: as labelled k-mers are unique, the alignment is the longest
increasing run of matched positions. Similarity is aligned k-mers over all
(aligned, and unaligned on either side).

Copies with equal words are merged first and stand for one text, named by the digest
of its words. Texts that share a bucket get their k-mers written once; candidates are
pairs of digests, dealt into cells of bounded volume, to which one text of each pair
brings its k-mers and the other comes once a cell.

Linked texts form classes by connected components (large-star, small-star), all in
tables. In the first round the members of a bucket meet its anchor, the first in a hash
order that all buckets share. Buckets whose members are then in several classes go on:
of ``SMALL`` members or fewer with all their pairs, larger ones with more anchors, in
rounds. Larger buckets that still hold several classes are finished exactly: of their
texts, every pair that shares a rare enough labelled k-mer (prefix filter with the
length and position bounds of 0.8) is a candidate, first one pair of every two classes,
then all pairs whose classes are still apart. So no pair that shares a sketch is left
untested, unless its texts are in one class or bounds exclude it. Pairs are verified
once, and not at all where their numbers of k-mers exclude it, or their ``BITS`` bits:
each labelled k-mer turns one bit of its text, so texts whose bits differ in more places
than 0.8 leaves k-mers unaligned cannot be near.

Edge cases: null text is empty; texts without words form one class; texts of one
to four words are one k-mer; texts of any length are read whole; the class id is the
smallest doc_id of the class, and of texts that repeat this id one stays; each row is
in the class of its own text, whatever other rows share its doc_id; a null doc_id comes
last, and is the class id only where no row of the class has one; an empty table gives
no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionframe.llm.hashing import mix, word_hashes
from ionframe.llm.shared import groups_for, keep_documents, release, rows_made, small_batches, text_key, text_or_empty, written

K = 5
SIMILARITY = 0.8
PICK = 3
TABLES = 12
#: Anchors of a bucket in each round; what they leave open is finished exactly.
ANCHORS = (1, 4, 8)
#: Buckets of at most so many members have all their pairs compared after the first round.
SMALL = 16
#: Bits of a text that its labelled k-mers turn.
BITS = 1024
#: Members of a bucket that meet its anchors in one place.
PER_SALT = 256
#: k-mers (8 bytes each) that one cell of pairs holds.
PER_CELL = 1 << 20
#: Edges that one file holds about.
EDGES_PER_FILE = 4096
#: Ids (16 bytes each) that may be broadcast; beyond it both sides are shuffled.
BROADCAST_IDS = 300_000


def labelled_kmers(text: str) -> np.ndarray:
    """Hashes of the k-mers in text order, each made unique by its occurrence number."""
    with np.errstate(over="ignore"):
        words = word_hashes(text)
        n = len(words)
        if not n:
            return words
        size = min(K, n)
        mers = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            mers = mers * np.uint64(0x100000001B3) + words[k:n - size + 1 + k]
        order = np.argsort(mers, kind="stable")
        ordered = mers[order]
        first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        at = np.arange(len(mers))
        number = np.empty(len(mers), np.uint64)
        number[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
        return mix(mers + number * np.uint64(0x9E3779B97F4A7C15))


def sketches(mers: np.ndarray, tables: int = TABLES, pick: int = PICK) -> np.ndarray:
    """One 64-bit key a table: the smallest k-mers, in text order."""
    with np.errstate(over="ignore"):
        seeds = mix(np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
        turned = mix(mers[None, :] ^ seeds[:, None])
        pick = min(pick, len(mers))
        if pick < len(mers):
            places = np.sort(np.argpartition(turned, pick - 1, axis=1)[:, :pick], axis=1)
        else:
            places = np.broadcast_to(np.arange(pick), (tables, pick))
        key = seeds.copy()
        for k in range(pick):
            key = mix(key * np.uint64(0x100000001B3) + mers[places[:, k]])
        return key.view(np.int64)


def turned_bits(mers: np.ndarray) -> np.ndarray:
    """``BITS`` bits in 64-bit words: the parity of the labelled k-mers that fall on each."""
    odd = np.bincount((mers % np.uint64(BITS)).astype(np.int64), minlength=BITS) % 2
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY, order: np.ndarray | None = None) -> float:
    """Similarity of two labelled k-mer sequences; 0 where it is surely below ``least``.

    ``order``: b's argsort, where it is known.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 1.0 if n == m else 0.0
    if min(n, m) < least * max(n, m):
        return 0.0
    needed = least * (n + m) / (1 + least)
    band = n + m - 2 * int(np.ceil(needed - 1e-9))
    order = np.argsort(b, kind="stable") if order is None else order
    at = np.minimum(np.searchsorted(b, a, sorter=order), m - 1)
    places = order[at]
    i = np.flatnonzero(b[places] == a)
    j = places[i]
    j = j[np.abs(i - j) <= band]
    if len(j) < needed - 1e-9:
        return 0.0
    if np.all(j[1:] > j[:-1]):
        common = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        common = len(tails)
    return common / (n + m - common)


def words_digest(mers: np.ndarray) -> bytes:
    """Names a text by its words: k-mers of up to five words in order determine them."""
    return hashlib.blake2b(mers.tobytes(), digest_size=16).digest()


def sketched(docs: DataFrame) -> DataFrame:
    """``doc_id, key (of the text), id (digest of the words), keys, size (k-mers)`` of every row."""

    def start() -> Callable:
        def run(batch: pa.RecordBatch) -> tuple[None, dict]:
            found = [labelled_kmers(t) for t in batch.column("text").to_pylist()]
            return None, {
                "id": [words_digest(m) for m in found],
                "keys": [sketches(m) if len(m) else [] for m in found],
                "size": [len(m) for m in found]}

        return run

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), text_or_empty().alias("text"))
    return rows_made(texts, ["doc_id", "key"], {"id": "binary", "keys": "array<long>", "size": "long"}, start)


def bucket_members(texts: DataFrame) -> DataFrame:
    """``t, key, n (members), salt, id, size`` of the buckets that two texts share, from ``id, keys, size``."""
    spread = texts.select("id", "size", F.posexplode("keys").alias("t", "key"))
    shared = spread.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    salt = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / PER_SALT)).alias("salt")
    return spread.join(shared, ["t", "key"]).select("t", "key", "n", salt, "id", "size")


def kmers_of(docs: DataFrame, rows: DataFrame, seen: DataFrame) -> DataFrame:
    """``id, mers, bits`` of one row of each text in ``rows`` (``doc_id, key``); seen: those of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [labelled_kmers(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                pa.array([words_digest(m) for m in found], pa.binary()),
                pa.array([m.view(np.int64) for m in found], pa.list_(pa.int64())),
                pa.array([turned_bits(m) for m in found], pa.list_(pa.int64()))], names=["id", "mers", "bits"])
        release()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return keep_documents(texts, rows, seen).select("text").mapInArrow(run, "id binary, mers array<long>, bits array<long>")


def near_sizes(one: str | Column, two: str | Column) -> Column:
    return F.least(one, two) >= SIMILARITY * F.greatest(one, two)


def may_be_near(other: Column, bits: bool = True) -> Column:
    """Whether a row's text can be near ``other`` (``size, bits``) by size and, if told, by bits."""
    near = near_sizes(F.col("size"), other["size"])
    if not bits:
        return near
    unlike = sum((F.bit_count(F.col("bits")[k].bitwiseXOR(other["bits"][k])) for k in range(BITS // 64)), F.lit(0))
    return near & (unlike <= (F.col("size") + other["size"]) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6)


def salts() -> Column:
    """All ``salt`` of a bucket of ``n`` members."""
    return F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / PER_SALT) - 1)


def with_roots(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return members.withColumn("root", F.col("id"))
    return members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def once(met: DataFrame, *more: DataFrame) -> DataFrame:
    """Distinct pairs ``lo, hi, size_lo, size_hi, hub`` of ``id, size, other (id, size)``.

    ``hub``: whether the lower text is the one that many others meet.
    """
    for others in more:
        met = met.unionByName(others)
    both = met.select(
        F.least("id", "other.id").alias("lo"), F.greatest("id", "other.id").alias("hi"), "size", F.col("other.size").alias("size_other"),
        (F.col("other.id") < F.col("id")).alias("hub"))
    sizes = [F.when(F.col("hub"), F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in (("size_other", "size", "size_lo"), ("size", "size_other", "size_hi"))]
    return both.select("lo", "hi", *sizes, "hub").groupBy("lo", "hi", "size_lo", "size_hi").agg(F.max("hub").alias("hub"))


def anchored(classed: DataFrame, turn: int, *more: DataFrame) -> DataFrame:
    """Pairs of each member and its bucket's anchors of this turn, of different classes, and ``more`` pairs.

    The anchors of all a text's buckets become one list of those that it can be near, so
    that a text meets an anchor once, however many buckets hold both. Members may come
    without ``bits``.
    """
    own = [c for c in ("id", "root", "size", "bits") if c in classed.columns]
    firsts = [F.min(F.struct(F.xxhash64("id", F.lit(turn * 100 + k)).alias("turn"), *own)).alias(f"a{k}") for k in range(ANCHORS[turn])]
    ends = classed.groupBy("t", "key").agg(*firsts, F.max("n").alias("n"), F.min("root").alias("least_root"), F.max("root").alias("most_root"))
    others = F.array_distinct(F.array(*[F.struct(*[F.col(f"a{k}.{c}").alias(c) for c in own]) for k in range(ANCHORS[turn])]))
    ends = ends.where("least_root != most_root").select("t", "key", F.explode(salts()).alias("salt"), others.alias("others"))
    ends = written(ends, "anchors")  # the planner would trace each anchor's parts through the join
    near = F.filter("others", lambda other: (F.col("root") != other["root"]) & may_be_near(other, "bits" in own))
    near = F.transform(near, lambda other: F.struct(other["id"].alias("id"), other["size"].alias("size")))
    met = classed.join(ends, ["t", "key", "salt"]).select("id", "size", near.alias("others")).where(F.size("others") > 0)
    met = met.groupBy("id", "size").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    return once(met.select("id", "size", F.explode("others").alias("other")), *more)


def all_pairs(classed: DataFrame) -> DataFrame:
    """All pairs (``id, size, other``) of different classes of buckets of few members."""
    other = classed.select("t", "key", F.struct("id", "root", "size", "bits").alias("other"))
    met = classed.join(other, ["t", "key"]).where((F.col("id") > F.col("other.id")) & (F.col("root") != F.col("other.root")))
    return met.where(may_be_near(F.col("other"))).select("id", "size", F.struct("other.id", "other.size").alias("other"))


def open_texts(classed: DataFrame) -> DataFrame:
    """``id, root, size, bits`` of the texts in buckets that hold several classes."""
    several = classed.groupBy("t", "key").agg(F.max("n").alias("n"), F.min("root").alias("least_root"), F.max("root").alias("most_root")).where("least_root != most_root")
    several = several.select("t", "key", F.explode(salts()).alias("salt"))
    return classed.join(several, ["t", "key", "salt"], "left_semi").select("id", "root", "size", "bits").distinct()


def prefix_pairs(kmers: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of different classes of ``texts`` that may be near: none that is near is left out.

    All k-mers have one order, the rarest first. Near texts of n and m k-mers align
    ``needed`` or more, all at or after the first of them in that order, so from there
    each text has that many left; and its places differ by no more than the band.
    The texts' bits leave out most of the pairs that are less than near.
    """
    own = kmers.join(texts.select("id"), "id", "left_semi").select("id", F.posexplode("mers").alias("place", "mer"))
    often = own.groupBy("mer").agg(F.count("*").alias("often")).where("often > 1")
    # k-mers of one text alone come first and meet nothing
    shared = own.join(often, "mer").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("often", "mer", "place"))).alias("mers"))
    placed = texts.join(shared, "id").select("id", "root", "size", "bits", (F.col("size") - F.size("mers")).alias("alone"), F.posexplode("mers").alias("at", "m"))
    placed = placed.select("id", "root", "size", "bits", (F.col("size") - F.col("alone") - F.col("at")).alias("left"), "m.mer", "m.place")
    # the shortest text that can be near has 0.8 of the k-mers, all of them in common
    placed = written(placed.where(F.col("left") >= SIMILARITY * F.col("size") - 1e-6), "prefixes")
    other = placed.select("mer", F.struct("id", "root", "size", "bits", "left", "place").alias("other"))
    both = F.col("size") + F.col("other.size")
    needed = both * (SIMILARITY / (1 + SIMILARITY)) - 1e-6
    met = placed.join(other, "mer").where((F.col("id") > F.col("other.id")) & (F.col("root") != F.col("other.root")))
    met = met.where((F.least("left", "other.left") >= needed) & (F.abs(F.col("place") - F.col("other.place")) <= both - 2 * needed))
    return once(met.where(may_be_near(F.col("other"))))


def verified(kmers: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, similarity`` of the written pairs that are near.

    The hub of a pair comes once to each cell, the other text with the pair. Cells have
    about ``PER_CELL`` k-mers, as hubs with more are dealt over several.
    """
    dealt = pairs.select(*[F.when(F.col("hub"), F.col(x)).otherwise(F.col(y)).alias(c) for x, y, c in (("hi", "lo", "a"), ("lo", "hi", "b"), ("size_hi", "size_lo", "size"))])
    volume = dealt.groupBy("b").agg(F.sum("size").alias("volume"))
    cells = groups_for(pairs.agg(F.sum("size_lo") + F.sum("size_hi")).first()[0] or 0, PER_CELL)
    large = _few(written(volume.where(F.col("volume") > PER_CELL), "large-hubs"))
    part = F.pmod(F.xxhash64("a"), F.coalesce(F.ceil(F.col("volume") / PER_CELL), F.lit(1)))
    dealt = dealt.join(large, "b", "left").select("a", "b", F.pmod(F.xxhash64("b", part), F.lit(cells)).alias("cell"))
    dealt = written(dealt, "cells")
    # only the k-mers of texts in pairs are shuffled while their ids are few
    either = [dealt.select(F.col(c).alias("id")).distinct() for c in ("a", "b")]
    ids = written(either[0].unionByName(either[1]).distinct(), "ids")
    kmers = kmers.join(_few(ids), "id", "left_semi")
    left = dealt.join(kmers.withColumnRenamed("id", "a"), "a")
    right = dealt.select("cell", "b").distinct().join(kmers.withColumnRenamed("id", "b"), "b").select("cell", "b", "mers").toDF("of_cell", "b", "mers")

    def run(key: tuple, pairs: pa.Table, hubs: pa.Table) -> pa.Table:
        held = {b: (m, np.argsort(m, kind="stable")) for b, m in zip(hubs["b"].to_pylist(), _arrays(hubs["mers"]), strict=True)}
        found: list[tuple] = []
        for a, b, mers in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), _arrays(pairs["mers"]), strict=True):
            other, order = held[b]
            similarity = aligned(mers, other, order=order)
            if similarity >= SIMILARITY - 1e-12:
                found.append((a, b, similarity))
        release()
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.float64()), strict=True)], names=["a", "b", "similarity"])

    return left.groupBy("cell").cogroup(right.groupBy("of_cell")).applyInArrow(run, "a binary, b binary, similarity double")


def _few(ids: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast where its checked size allows it."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _arrays(column: pa.ChunkedArray) -> Iterator[np.ndarray]:
    for chunk in column.chunks:
        values, offsets = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        yield from (values[a:b] for a, b in zip(offsets, offsets[1:], strict=False))


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` of every id in ``edges`` (``a, b``); the root is the smallest id."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    n, before = now.count(), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # there are no more ids than ends of edges, each with another beside it
        few = F.broadcast if 4 * n <= BROADCAST_IDS else (lambda ids: ids)
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(few(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(few(least), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        now = written(small.coalesce(groups_for(n, EDGES_PER_FILE, 8)), "edges")
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if sign == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        n, before = sign[0], sign


class Classes:
    """Classes of the texts so far (``roots``: ``id, root``) and the pairs verified."""

    def __init__(self, kmers: DataFrame):
        self.kmers, self.roots, self.tested = kmers, None, None

    def join(self, pairs: DataFrame) -> bool:
        """Verifies the pairs that are new and joins their classes; whether there were any."""
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["lo", "hi"], "left_anti")
        pairs = written(pairs, "pairs")
        if self.roots is not None and pairs.isEmpty():
            return False
        found = written(verified(self.kmers, pairs).select("a", "b"), "links")
        pairs = pairs.select("lo", "hi")
        self.tested = pairs if self.tested is None else written(self.tested.unionByName(pairs), "tested")
        if self.roots is not None and found.isEmpty():
            return False
        # classes so far are stars: they stand for all links found before
        self.roots = components(found if self.roots is None else found.unionByName(self.roots.toDF("a", "b")))
        return True

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs of different classes with their roots."""
        lo, hi = (self.roots.toDF(c, f"root_{c}") for c in ("lo", "hi"))
        both = pairs.join(lo, "lo", "left").join(hi, "hi", "left")
        both = both.withColumns({f"root_{c}": F.coalesce(f"root_{c}", c) for c in ("lo", "hi")})
        return both.where("root_lo != root_hi")


def joined_classes(kmers: DataFrame, members: DataFrame) -> DataFrame:
    """``id, root`` of all texts that have a link: rounds with anchors, then the exact finish."""
    classes = Classes(kmers)
    large = members.where(F.col("n") > SMALL)
    classes.join(anchored(with_roots(members, None), 0))
    for turn in range(1, len(ANCHORS)):
        few = [all_pairs(with_roots(members.where(F.col("n") <= SMALL), classes.roots))] if turn == 1 else []
        pairs = anchored(with_roots(large, classes.roots), turn, *few)
        if not classes.join(pairs):
            break
    left = written(open_texts(with_roots(large, classes.roots)), "open")
    if not left.isEmpty():
        pairs = written(prefix_pairs(kmers, left), "prefix-pairs")
        one = F.min_by(F.struct("lo", "hi", "size_lo", "size_hi", "hub"), F.xxhash64("lo", "hi")).alias("pair")
        by_class = classes.apart(pairs).groupBy(F.least("root_lo", "root_hi").alias("x"), F.greatest("root_lo", "root_hi").alias("y"))
        classes.join(by_class.agg(one).select("pair.*"))
        classes.join(classes.apart(pairs).select(*pairs.columns))
    return classes.roots


def classified(docs: DataFrame) -> DataFrame:
    """``doc_id, key (of the text), class_id, class_size, kept, class`` of each row."""
    small_batches(docs.sparkSession)
    rows = written(sketched(docs), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    texts = written(rows.groupBy("id").agg(first, F.first("keys").alias("keys"), F.first("size").alias("size"), F.count("*").alias("n")), "texts")
    members = written(bucket_members(texts), "members")
    met = texts.join(members.select("id").distinct(), "id", "left_semi").select("first.doc_id", "first.key")
    kmers = written(kmers_of(docs, met, rows.select("doc_id", "key")), "kmers")
    members = written(members.join(kmers.select("id", "bits"), "id"), "members")
    roots = joined_classes(kmers.select("id", "mers"), members)
    named = written(texts.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("class"), "first", "n"), "classes")
    classes = named.groupBy("class").agg(F.min(F.struct("first", "id")).alias("keeper"), F.sum("n").alias("class_size"))
    named = named.select("id", "class").join(classes, "class").select(
        "id", "class", "class_size", F.col("keeper.first.doc_id").alias("class_id"), (F.col("keeper.id") == F.col("id")).alias("of_keeper"))
    kept = F.col("of_keeper") & F.col("doc_id").eqNullSafe(F.col("class_id"))
    return rows.select("doc_id", "key", "id").join(named, "id").select("doc_id", "key", "class_id", "class_size", kept.alias("kept"), "class")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, class_size, kept`` of each row."""
    return classified(docs).select("doc_id", "class_id", "class_size", "kept")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, that of its smallest doc_id."""
    rows = written(classified(docs).select("doc_id", "key", "kept", "class"), "classified")
    kept = rows.where("kept").groupBy("class").agg(F.min(F.struct("doc_id", "key")).alias("row"))
    return keep_documents(docs, kept.select("row.doc_id", "row.key"), rows.select("doc_id", "key"))

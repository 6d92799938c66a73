"""Merkle dataset manifest: a hash tree a group, a tree over the groups, and proofs.

Leaves are sorted by range over an RDD's partitions. Counts of rows by partition and group
give each partition the place of its first row in the group (only a partition's first and
last group reach beyond it). Each partition then builds the complete aligned subtrees that
lie inside it; nodes whose run of ``FAN`` lies in several partitions (at most
2 x (FAN - 1) a level, group and partition) are shuffled by their coordinate (group, level,
run) and finished level by level. The groups' roots, in the order of groups, are the leaves
of one more such tree. Proofs go the other way: what a ragged node learns about the levels
above it is sent to the partition that made it.

Defined cases: any column may be null (encoded as ``-``); a null group is the first one; null
doc_ids come first in their group; repeated doc_ids are ordered by their leaf; rows that are
alike in all fields have equal leaves and their own places; an empty table gives no rows;
columns beside the hashed ones are ignored, whatever their names. Texts of any length are
hashed in the JVM and not shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionframe.llm.ranged import beside, range_sorted
from ionframe.tables import written

FAN = 16
SHIFT = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<before:string,after:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def leaf_hash(*fields: Column) -> Column:
    """sha256 of fields, each ``-`` if null, else its UTF-8 bytes' count, ``:`` and value."""
    told = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda now, p: F.sha2(F.concat(p["before"], now, p["after"]).cast("binary"), 256))


def siblings(proof: Column) -> Column:
    """A proof's digests, level by level, left to right, as one text."""
    return F.array_join(F.transform(proof, lambda p: F.concat(p["before"], p["after"])), "")


class Span(NamedTuple):
    """A group's rows in one partition: [first, first + n) of ``total``."""

    group: str
    first: int
    n: int
    total: int


def above(n: int) -> int:
    """How many nodes the level above ``n`` nodes has."""
    return -(-n // FAN)


class Levels:
    """What one partition knows of one group's tree: level k holds nodes [first, first + len)."""

    def __init__(self, span: Span, leaves: list[str]):
        self.span, self.first, self.nodes, self.size = span, [span.first], [leaves], [span.total]
        while self.size[-1] > 1:
            a, held, n = self.first[-1], self.nodes[-1], self.size[-1]
            b = a + len(held)
            low, high = above(a), above(b) if b == n else b // FAN
            if low >= high:
                break
            self.first.append(low)
            self.nodes.append([digest("".join(held[FAN * j - a : FAN * (j + 1) - a])) for j in range(low, high)])
            self.size.append(above(n))

    def holds(self, level: int, at: int) -> bool:
        return level < len(self.nodes) and 0 <= at - self.first[level] < len(self.nodes[level])

    def ragged(self) -> Iterator[tuple[int, int, str]]:
        """Nodes (level, place, digest) whose parent this partition cannot make."""
        for level, (a, held, n) in enumerate(zip(self.first, self.nodes, self.size, strict=True)):
            if n > 1:
                yield from ((level, at, h) for at, h in enumerate(held, a) if not self.holds(level + 1, at >> SHIFT))

    @property
    def root(self) -> str | None:
        return self.nodes[-1][0] if self.size[-1] == 1 else None

    def climb(self, at: int) -> tuple[list[tuple[str, str]], int, int]:
        """The proof of leaf ``at`` as far as it is known here, and the node it ends at."""
        proof, level = [], 0
        while self.holds(level + 1, at >> SHIFT):
            a, held = self.first[level], self.nodes[level]
            start = (at >> SHIFT) * FAN - a
            proof.append(("".join(held[start : at - a]), "".join(held[at - a + 1 : start + FAN])))
            level, at = level + 1, at >> SHIFT
        return proof, level, at


def _spans(rows: list[tuple], edges: tuple) -> Iterator[tuple[Span, int]]:
    """The groups of a partition's rows (group, ...) with the index of their first row."""
    head, head_total, tail_total = edges
    start, groups = 0, []
    for k in range(1, len(rows) + 1):
        if k == len(rows) or rows[k][0] != rows[start][0]:
            groups.append((rows[start][0], start, k - start))
            start = k
    for j, (group, at, n) in enumerate(groups):
        first = head if j == 0 else 0
        total = head_total if j == 0 else tail_total if j == len(groups) - 1 else n
        yield Span(group, first, n, total), at


class Tree:
    """The hash trees of an RDD of rows (group, leaf, ...), sorted by group and place."""

    def __init__(self, spark: SparkSession, rows: RDD):
        self.spark, self.rows = spark, rows
        found, self.most = self._edges()
        edges = spark.sparkContext.broadcast(found)  # three numbers a partition

        def build(k: int, part: Iterator[tuple]) -> Iterator[tuple]:
            own = list(part)
            for span, at in _spans(own, edges.value[k]):
                made = Levels(span, [r[1] for r in own[at : at + span.n]])
                yield from ((k, span.group, span.total, level, place, h) for level, place, h in made.ragged())
                if made.root is not None:
                    yield (k, span.group, span.total, -1, 0, made.root)

        self.edges = edges
        made = rows.mapPartitionsWithIndex(build)
        nodes = written(spark.createDataFrame(made, "pid int, grp string, total long, level int, place long, hash string", verifySchema=False), "merkle-nodes")
        self._finish(nodes.where("level >= 0"), nodes.where("level < 0").select("grp", "hash"))

    def _edges(self) -> tuple[list[tuple[int, int, int]], int]:
        """For each partition: its first row's place in its group, and the sizes of the groups
        that its first and its last row belong to; and the largest group in several partitions."""

        def count(_: int, part: Iterator[tuple]) -> Iterator[tuple]:
            first = last = None
            head = tail = n_groups = 0
            for row in part:
                if n_groups == 0 or row[0] != last:
                    first, last, tail, n_groups = row[0] if n_groups == 0 else first, row[0], 0, n_groups + 1
                tail += 1
                head += n_groups == 1
            yield first, head, last, tail, n_groups

        counts = self.rows.mapPartitionsWithIndex(count).collect()
        totals: dict[str, int] = {}
        for first, head, last, tail, n in counts:
            if n:
                totals[first] = totals.get(first, 0) + head
            if n > 1:
                totals[last] = totals.get(last, 0) + tail
        seen: dict[str, int] = {}
        out, most = [], 1
        for first, head, last, tail, n in counts:
            most = max(most, *(total for total, here in ((totals.get(first, 0), head), (totals.get(last, 0), tail)) if total > here), 1)
            out.append((seen.get(first, 0), totals.get(first, 0), totals.get(last, 0)))
            if n:
                seen[first] = seen.get(first, 0) + head
            if n > 1:
                seen[last] = seen.get(last, 0) + tail
        return out, most

    def _finish(self, ragged: DataFrame, roots: DataFrame) -> None:
        """Upper levels from the ragged nodes; ``roots`` (grp, hash) and ``paths`` (pid, grp,
        level, place, proof) of what ragged nodes miss."""
        most, runs, level, now, size = self.most, [], 0, None, F.col("total")
        while most > 1:
            here = ragged.where(F.col("level") == level).select("grp", "total", "place", "hash")
            here = here if now is None else here.unionByName(now)
            run = here.groupBy("grp", "total", F.shiftright("place", SHIFT).alias("run")).agg(F.sort_array(F.collect_list(F.struct("place", "hash"))).alias("held"))
            size = F.ceil(size / FAN)
            runs.append(written(run.select("*", F.sha2(F.array_join("held.hash", "").cast("binary"), 256).alias("hash"), (size == 1).alias("top")), "merkle-runs"))
            now = runs[-1].where("not top").select("grp", "total", F.col("run").alias("place"), "hash")
            roots = roots.unionByName(runs[-1].where("top").select("grp", "hash"))
            level, most = level + 1, above(most)
        self.roots = roots
        paths, upper = None, None
        for level in reversed(range(len(runs))):
            nodes = runs[level].select("grp", "run", "top", F.posexplode("held").alias("k", "node"), "held")
            texts = lambda a, n: F.array_join(F.slice("held.hash", a, n), "")
            own = F.array(F.struct(texts(F.lit(1), F.col("k")).alias("before"), texts(F.col("k") + 2, F.lit(FAN)).alias("after")))
            nodes = nodes.select("grp", F.col("node.place").alias("place"), "run", "top", own.alias("own"))
            done = nodes.where("top").select("grp", "place", F.col("own").alias("proof"))
            if upper is not None:
                more = upper.toDF("grp", "run", "rest")
                done = done.unionByName(nodes.where("not top").join(more, ["grp", "run"]).select("grp", "place", F.concat("own", "rest").alias("proof")))
            upper = written(done, "merkle-paths")
            found = ragged.where(F.col("level") == level).join(upper, ["grp", "place"]).select("pid", "grp", "level", "place", "proof")
            paths = found if paths is None else paths.unionByName(found)
        self.paths = paths

    def proofs(self, told: RDD | None = None) -> RDD:
        """Rows (row, proof within its group, what ``told`` says of its group).

        told: (partition, (group, value)) pairs.
        """
        heard = self.spark.sparkContext.emptyRDD() if self.paths is None else self.paths.rdd.map(lambda r: (r[0], (r[1], r[2], r[3], [tuple(p) for p in r[4]])))
        heard = heard if told is None else heard.union(told)
        edges = self.edges

        def prove(k: int, own: list[tuple], notes: list) -> Iterator[tuple]:
            upper = {note[:3]: note[3] for note in notes if len(note) == 4}
            said = {note[0]: note[1] for note in notes if len(note) == 2}
            for span, at in _spans(own, edges.value[k]):
                made = Levels(span, [r[1] for r in own[at : at + span.n]])
                for j in range(span.n):
                    proof, level, place = made.climb(span.first + j)
                    yield own[at + j], proof + upper.get((span.group, level, place), []), said.get(span.group)

        return beside(self.rows, heard, prove)


def manifest(leaves: DataFrame) -> DataFrame:
    """``leaves`` (``source, doc_id, leaf`` and any more columns) with ``subroot, root`` and
    the ``proof`` of each: (before, after) digests level by level, from leaf to root."""
    spark = leaves.sparkSession
    carried = [c for c in leaves.columns if c not in ("source", "doc_id", "leaf")]
    grp = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))  # null first, bytes in order
    told = leaves.select(grp.alias("grp"), "leaf", "source", "doc_id", *carried)
    n = told.count()
    numbered = told.withColumn("turn", F.monotonically_increasing_id())  # tells equal rows apart
    documents = Tree(spark, range_sorted(numbered, ["grp", "doc_id", "leaf", "turn"], n))
    roots = written(documents.roots.select(F.lit("").alias("top"), "hash", "grp"), "merkle-roots")
    groups = Tree(spark, range_sorted(roots, ["grp"], roots.count()))
    root = groups.roots.select(F.col("hash").alias("root"))

    def pairs(k: int, part: Iterator[tuple]) -> Iterator[tuple]:
        before = None
        for row in part:
            if row[0] != before:
                before = row[0]
                yield before, k

    of_group = spark.createDataFrame(groups.proofs().map(lambda r: (r[0][2], r[0][1], r[1])), f"grp string, subroot string, rest {PROOF}", verifySchema=False)
    at = spark.createDataFrame(documents.rows.mapPartitionsWithIndex(pairs), "grp string, pid int", verifySchema=False)
    told = at.join(written(of_group, "merkle-groups"), "grp").select("pid", "grp", "subroot", "rest")
    sent = told.rdd.map(lambda r: (r[0], (r[1], (r[2], [tuple(p) for p in r[3]]))))
    fields = {f.name: f for f in numbered.schema.fields}
    schema = T.StructType([*(fields[c] for c in ("source", "doc_id", "leaf", *carried)), T.StructField("subroot", T.StringType()), T.StructField("proof", T.ArrayType(T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())])))])
    proved = documents.proofs(sent).map(lambda r: (r[0][2], r[0][3], r[0][1], *r[0][4:-1], r[2][0], r[1] + r[2][1]))
    return spark.createDataFrame(proved, schema, verifySchema=False).join(F.broadcast(root))  # the root is one row


def document_leaves(docs: DataFrame) -> DataFrame:
    """``source, doc_id, leaf`` of documents and ``claimed``: the leaf of what a tampered copy
    holds (text in lower-case ASCII letters) where 5 divides crc32(doc_id), else the leaf."""
    fields = {c: F.col(c).cast("string") for c in FIELDS}
    text = F.when(F.crc32(fields["doc_id"].cast("binary")) % 5 == 0, F.translate(fields["text"], UPPER, LOWER)).otherwise(fields["text"])
    both = [leaf_hash(*(fields | {"text": t}).values()) for t in (fields["text"], text)]
    return docs.select(fields["source"].alias("source"), F.col("doc_id").cast("long").alias("doc_id"), both[0].alias("leaf"), both[1].alias("claimed"))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` and the check of a copy in which every fifth document
    was tampered with: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``."""
    found = manifest(document_leaves(docs))
    told = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), folded(F.col("claimed"), F.col("proof")).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


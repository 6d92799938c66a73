"""Spelling variants: one-edit pairs of words by merging light subtrees of their trie.

Words are sorted by range, so each partition holds a stretch of the trie's leaves. Subtrees
inside a partition are weighed there; for the nodes that reach beyond it (prefixes of its
first or last word shared with a neighbour) each partition tells how many of its words
continue with which character, and gets back the heavy child of the whole. Every node hands
its light subtrees, the small ones, to its heavy child, with one character skipped in the
light word, skipped in the heavy word, or replaced; and light subtrees meet one another
with the replaced character left out. A word changes in as many places as it has light edges
above it, at most the logarithm of the number of words. Words end in an edge of their own.
Where a changed word and a word, or two changed words, end alike, they are one edit apart;
the changed text is compared whole, so a pair is exact.

Hot groups: the trie's root and other crowded prefixes are never grouped by key, as words lie
in order; what meets under one text is bounded by a word's length and the alphabet.

Defined cases: a null text has no words; a null doc_id deletes no characters; repeated rows
count again; texts and words of any length are read whole (an edge is a place in its word,
not a copied prefix); ties go to the word that is smaller in code points; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
from collections import Counter
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionframe.llm.ranged import beside, range_sorted
from ionframe.tables import written

#: A word is a maximal run of these; ASCII capitals count as small letters.
LETTERS = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: In one of so many (document, word) the word loses a character.
SLIPS = 31
#: How much more often than a word its form must occur.
TIMES = 10
#: Stands for a replaced character, and for a word's end as an edge.
HOLE, END = "*", ""


def slipped(run: Column, doc_id: Column) -> Column:
    """The run without the code point at h % length where SLIPS divides h = crc32(doc:run)."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % SLIPS == 0, cut).otherwise(run)


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all texts: words of LEAST_LENGTH code points, seen LEAST_COUNT times."""
    # a greedy match of that length begins where its run begins and takes all of it
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS}{{{LEAST_LENGTH},}})"))).alias("run"))
    small = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = runs.select("doc_id", small.alias("run")).select(slipped(F.col("run"), F.col("doc_id")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def edge(word: str, at: int) -> str:
    return word[at] if at < len(word) else END


def node_name(prefix: str) -> str:
    """A trie node's name: its prefix, or of a long one a digest."""
    return prefix if len(prefix) <= 40 else f"{len(prefix)}:{hashlib.sha256(prefix.encode()).hexdigest()}"


class Stretch:
    """A partition's words in order; ``back`` and ``on``: how much of its first word the
    partition before shares, and of its last word the next one (-1: there is none)."""

    def __init__(self, words: list[str], back: int, on: int):
        self.words, self.back, self.on = words, back, on

    def borders(self) -> Iterator[tuple[str, str, int]]:
        """(node, edge, words) of this partition at all nodes that reach beyond it."""
        w, m, seen = self.words, len(self.words), set()
        for word, deepest, left in ((w[0], self.back, True), (w[-1], self.on, False)):
            span = (0, m)
            for depth in range(deepest + 1):
                name = node_name(word[:depth])
                lo, hi = span
                own = edge(word, depth)
                # words that go on like the border word are next to the border
                if left:
                    cut = bisect.bisect_right(w, own, lo, hi, key=lambda v: edge(v, depth))  # noqa: B023
                    others, span = w[cut:hi], (lo, cut)
                else:
                    cut = bisect.bisect_left(w, own, lo, hi, key=lambda v: edge(v, depth))  # noqa: B023
                    others, span = w[lo:cut], (cut, hi)
                if name not in seen:
                    seen.add(name)
                    yield name, own, span[1] - span[0]
                    for c, n in Counter(edge(v, depth) for v in others).items():
                        yield name, c, n

    def light_edges(self, heavy: dict[str, str]) -> Iterator[tuple[str, list[tuple[int, str]]]]:
        """Each word with its light edges: (place, the heavy edge beside it).

        heavy: the heavy edges of the nodes in ``borders``.
        """
        w = self.words
        todo: list[tuple[int, int, int, list]] = [(0, len(w), 0, [])] if w else []
        while todo:
            lo, hi, depth, found = todo.pop()
            word, alone = w[lo], hi - lo == 1
            splits = len(word) if alone else depth + shared(word[depth:], w[hi - 1][depth:])
            reach = max(self.back if lo == 0 else -1, self.on if hi == len(w) else -1)
            # nodes without a branch here may have one in a neighbour's words
            for at in range(depth, min(splits if alone else splits - 1, reach) + 1):
                best = heavy[node_name(word[:at])]
                if best != edge(word, at):
                    found = [*found, (at, best)]
            if alone:
                yield word, found
                continue
            groups, start = [], lo
            for c, members in itertools.groupby(range(lo, hi), key=lambda k: edge(w[k], splits)):  # noqa: B023
                n = sum(1 for _ in members)
                groups.append((c, start, start + n))
                start += n
            best = heavy[node_name(word[:splits])] if splits <= reach else min(groups, key=lambda g: (g[1] - g[2], g[0]))[0]
            todo.extend((a, b, splits + 1, found if c == best else [*found, (splits, best)]) for c, a, b in groups)


def changed(word: str, edges: list[tuple[int, str]]) -> set[tuple[str, bool]]:
    """(text, whether it has a hole) of a word moved from light subtrees to their heavy
    neighbours, and of its light siblings' meeting."""
    out = set()
    for at, best in edges:
        before, after = word[:at], word[at + 1 :]
        if at < len(word):
            out |= {(before + after, False), (before + HOLE + after, True)}
            if best != END:
                out.add((before + best + after, False))
        if best != END:
            out.add((before + best + word[at:], False))
    return {(t, hole) for t, hole in out if len(t) >= LEAST_LENGTH}


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, b, n_a, n_b`` (a < b): all pairs of ``words`` (``word, n``, distinct) that differ
    by exactly one inserted, deleted or replaced code point."""
    spark = words.sparkSession
    words = words.select("word", "n")
    rows = range_sorted(words, ["word"], words.count())

    def ends(_: int, part: Iterator[tuple]) -> Iterator[tuple]:
        first = last = None
        for word, _n in part:
            first, last = word if first is None else first, word
        yield first, last

    told = rows.mapPartitionsWithIndex(ends).collect()  # two words a partition
    held = [k for k, (first, _) in enumerate(told) if first is not None]
    reach = {k: [-1, -1] for k in held}
    for one, two in itertools.pairwise(held):
        reach[one][1] = reach[two][0] = shared(told[one][1], told[two][0])
    reaches = spark.sparkContext.broadcast(reach)  # two numbers a partition

    def borders(k: int, part: Iterator[tuple]) -> Iterator[tuple]:
        own = [word for word, _ in part]
        if own:
            yield from ((k, *row) for row in Stretch(own, *reaches.value[k]).borders())

    parts = written(spark.createDataFrame(rows.mapPartitionsWithIndex(borders), "pid int, node string, edge string, n long", verifySchema=False), "trie-borders")
    weighed = parts.groupBy("node", "edge").agg(F.sum("n").alias("n")).groupBy("node").agg(F.min_by("edge", F.struct(-F.col("n"), F.col("edge"))).alias("best"))
    best: RDD = parts.select("pid", "node").distinct().join(weighed, "node").select("pid", "node", "best").rdd.map(lambda r: (r[0], (r[1], r[2])))

    def merge(k: int, own: list[tuple], heavy: list[tuple]) -> Iterator[tuple]:
        if own:
            counts = dict(own)
            for word, edges in Stretch([w for w, _ in own], *reaches.value[k]).light_edges(dict(heavy)):
                for text, hole in changed(word, edges):
                    yield text, hole, word, counts[word]

    moved = written(spark.createDataFrame(beside(rows, best, merge), "text string, hole boolean, word string, n long", verifySchema=False), "trie-moved")
    met = moved.where("not hole").join(words.toDF("text", "n_text"), "text").select("word", "n", F.col("text").alias("other"), F.col("n_text").alias("n_other"))
    holes = moved.where("hole").select("text", "word", "n")
    light = holes.join(holes.toDF("text", "other", "n_other"), "text").where(F.col("word") < F.col("other")).select("word", "n", "other", "n_other")

    def pair(first: bool) -> Column:
        x, y = (("word", "n"), ("other", "n_other"))[:: 1 if first else -1]
        return F.struct(F.col(x[0]).alias("a"), F.col(y[0]).alias("b"), F.col(x[1]).alias("n_a"), F.col(y[1]).alias("n_b"))

    return met.unionByName(light).select(F.when(F.col("word") < F.col("other"), pair(True)).otherwise(pair(False)).alias("p")).select("p.*").distinct()


def variants(words: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of ``words`` (``word, n``): the near word of
    largest n if it occurs TIMES as often, and where forms of forms end."""
    words = written(words.select("word", "n"), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("m")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.max("n").alias("n"), F.max("m").alias("m"), F.min_by("near", F.struct(-F.col("m"), F.col("near"))).alias("near"))
    often = F.col("m") >= TIMES * F.col("n")
    near = written(best.select("word", "n_near", F.when(often, F.col("near")).alias("form"), F.when(often, F.col("m")).alias("form_n")), "forms")
    most = words.agg(F.max("n")).first()[0] or 1
    steps = int(math.log10(max(most, 10)))  # forms occur ever more often
    ends = near.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        ends = written(ends, "ends")
        ends = ends.join(ends.toDF("root", "further"), "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    out = words.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The variants of all words of ``documents``."""
    return variants(word_counts(docs))

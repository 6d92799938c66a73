"""The manifest against a tree built in one piece, and its partition arithmetic."""

from __future__ import annotations

import hashlib
import random
import zlib
from functools import reduce

import pytest
from pyspark.sql import functions as F

from ionframe.llm import merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    """Root and every leaf's (before, after) pairs, level by level."""
    proofs, at, now = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(now) > 1:
        for k, place in enumerate(at):
            run = place // 16 * 16
            proofs[k].append(("".join(now[run:place]), "".join(now[place + 1 : run + 16])))
        at = [p // 16 for p in at]
        now = [digest("".join(now[k : k + 16])) for k in range(0, len(now), 16)]
    return now[0], proofs


def expected(rows):
    """(doc_id, leaf, subroot, root, proof digest, folded root) of (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r: digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    by = {}
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
        changed = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])) if hit else r
        by.setdefault(r[1], []).append((r[0], leaf(r), leaf(changed)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {s: tree([r[1] for r in by[s]]) for s in order}
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for (doc, h, claimed), own in zip(by[s], trees[s][1], strict=True):
            proof = own + top
            out.append((doc, h, trees[s][0], root, digest("".join(a + z for a, z in proof)), reduce(lambda now, p: digest(p[0] + now + p[1]), proof, claimed)))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, turn long, leaf string, hash string"


def made(spark, rows, parts=5):
    wide = [(*r, "g", 3, "l", "h") for r in rows]
    return spark.createDataFrame(wide, SCHEMA).repartition(parts)


def checked(spark, rows, parts=5):
    got = merkle.verified_manifest(made(spark, rows, parts)).collect()
    order = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in got), key=order) == sorted(expected(rows), key=order)
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in got)
    return got


def test_hot_source_and_hard_rows(spark, monkeypatch):
    """One source holds most rows over many partitions; nulls, repeats, long and odd texts."""
    monkeypatch.setattr(merkle, "range_sorted", lambda df, keys, rows: __import__("ionframe.llm.ranged", fromlist=["x"]).range_sorted(df, keys, rows, 40))
    rng = random.Random(2)
    rows = [(k, "hot", "en", k % 7, "Text %d " % k * rng.randint(0, 4)) for k in range(700)]
    rows += [(k, rng.choice(["a", "b", "ü", "Z", ""]), None, None, rng.choice([None, "", "ABC é 中 \U0001f600", "x" * 100_000])) for k in range(1000, 1080)]
    rows += [(None, None, None, None, None)] * 40 + [(5, "hot", "en", 5, "again"), (5, "hot", "en", 5, "again"), ((1 << 62) + 1, "hot", None, 1, "BIG"), (-3, "one", "x", 1, "UP")]
    got = checked(spark, rows)
    changed = {r["doc_id"] for r in got if not r["verified"]}
    assert changed and all(zlib.crc32(str(k).encode()) % 5 == 0 for k in changed)


def test_many_sources(spark):
    checked(spark, [(k, f"s{k}", None, k, "T") for k in range(300)], 3)


@pytest.mark.parametrize("n", [1, 2, 16, 17])
def test_small_trees(spark, n):
    checked(spark, [(k, "s", None, k, "T") for k in range(n)], 2)


def test_no_rows(spark):
    assert merkle.verified_manifest(made(spark, [])).count() == 0


def test_proofs_are_the_siblings(spark):
    rows = [(k, "s", None, k, "T") for k in range(20)]
    found = merkle.manifest(merkle.document_leaves(made(spark, rows)))
    leaves = [r["leaf"] for r in found.orderBy("doc_id").collect()]
    own = [[tuple(p) for p in r["proof"]] for r in found.orderBy("doc_id").collect()]
    assert own == tree(leaves)[1]
    good = found.select((merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok")).distinct().collect()
    assert [r["ok"] for r in good] == [True]


@pytest.mark.parametrize("cuts", [(0, 7, 300), (0, 16, 32, 33, 300), (0, 1, 2, 255, 257, 300), (0, 300)])
def test_partitions_hold_each_node_once(cuts):
    leaves = [digest(str(k)) for k in range(300)]
    held = [merkle.Levels(merkle.Span("g", a, b - a, 300), leaves[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    for part in held:
        ragged = {(level, place) for level, place, _ in part.ragged()}
        assert len(ragged) <= 2 * 15 * 3
        for k in range(part.span.first, part.span.first + part.span.n):
            proof, level, place = part.climb(k)
            assert (level, place) in ragged or part.root is not None
            assert len(proof) == level


def test_more_partitions_than_asked(spark, monkeypatch):
    """A session may deal keys to more partitions than asked for."""
    from pyspark import RDD

    dealt = RDD.partitionBy
    monkeypatch.setattr(RDD, "partitionBy", lambda self, n, *a: dealt(self, n + 5, *a))
    checked(spark, [(k, "s", None, k, "T") for k in range(50)], 2)

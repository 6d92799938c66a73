"""Reaction weights, scores and chains against loops."""

from __future__ import annotations

import random
from statistics import NormalDist, fmean, variance

import pytest
from pyspark.sql import functions as F

from ionframe.operators import pathways

NODES = [("A", 1, 2.0), ("A", 2, 4.0), ("A", 3, 5.0), ("A", 4, 4.0), ("A", 5, 0.0), ("B", 1, 1.0), ("B", 2, 1.0), ("B", 3, 10.0), ("B", 4, 9.0), ("C", 1, 3.0)]
REACTIONS = [("A", "B"), ("A", "B"), ("B", "C"), ("C", "D"), ("D", "A"), ("C", "A")]


def test_weights_and_tests(spark):
    nodes = spark.createDataFrame(NODES, "node string, file_id long, value double")
    weights = pathways.reaction_weights(nodes, spark.createDataFrame(REACTIONS, "source string, target string"))
    got = sorted((r["source"], r["target"], r["file_id"], r["weight"]) for r in weights.collect())
    # no weight without the reactant, zero without the product, none for the unmeasured D
    assert got == [("A", "B", 1, 0.5), ("A", "B", 2, 0.25), ("A", "B", 3, 2.0), ("A", "B", 4, 2.25), ("B", "C", 1, 3.0), ("B", "C", 2, 0.0), ("B", "C", 3, 0.0), ("B", "C", 4, 0.0), ("C", "A", 1, 2 / 3)]
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2), (5, 2)], "file_id long, grp int")
    told = {(r["source"], r["target"]): r for r in pathways.tested(weights, groups).collect()}
    assert set(told) == {("A", "B"), ("B", "C")}
    a, b = [0.5, 0.25], [2.0, 2.25]
    t = (fmean(a) - fmean(b)) / (variance(a) / 2 + variance(b) / 2) ** 0.5
    r = told["A", "B"]
    assert r["t"] == pytest.approx(t) and r["z"] < 0 and r["z"] == pytest.approx(-NormalDist().inv_cdf(1 - r["p"] / 2))


def test_scores(spark):
    rows = spark.createDataFrame([(0.0, -3.0), (1.0, 2.0), (0.05, 1.0)], "p double, d double")
    got = [r[0] for r in rows.select(pathways.signed_score(F.col("p"), F.col("d"))).collect()]
    assert got == pytest.approx([-NormalDist().inv_cdf(1 - 5e-16), 0.0, 1.959964], rel=1e-6)


@pytest.mark.parametrize("least", [0.0, 1.0, 1.5])
def test_chains_equal_the_search(spark, least):
    rng = random.Random(6)
    edges = {(a, b): rng.gauss(0, 1.2) for a in "ABCDEFG" for b in "ABCDEFG" if a != b and rng.random() < 0.5}
    expected = {}

    def search(path, total):
        if len(path) > 1 and abs(total / (len(path) - 1) ** 0.5) >= least:
            expected[tuple(path)] = total / (len(path) - 1) ** 0.5
        if len(path) <= 4:
            for (a, b), z in edges.items():
                if a == path[-1] and b not in path:
                    search([*path, b], total + z)

    for a in "ABCDEFG":
        search([a], 0.0)
    got = pathways.chains(spark.createDataFrame([(a, b, z) for (a, b), z in edges.items()] + [("A", "G", None)], "source string, target string, z double"), 4, least)
    assert {tuple(r["nodes"]): r["z"] for r in got.collect()} == pytest.approx(expected) and len(expected) > 3


def test_exact_rank_tests_by_enumeration(spark):
    """Small groups without ties are counted; ties go by the normal curve."""
    from itertools import combinations, product

    from ionframe.operators import statistics

    rng = random.Random(3)
    values = {s: [(1, rng.random()) for _ in range(4)] + [(2, rng.random() + s / 4) for _ in range(5)] for s in range(4)}
    rows = [(s, g, v) for s, own in values.items() for g, v in own] + [(9, 1, 1.0), (9, 1, 2.0), (9, 2, 2.0), (9, 2, 3.0)]
    got = {r["spot_id"]: r for r in statistics.mann_whitney_tested(spark.createDataFrame(rows, "spot_id long, grp int, height double")).collect()}
    for s, own in values.items():
        ranks = {v: k + 1 for k, v in enumerate(sorted(v for _, v in own))}
        u = sum(ranks[v] for g, v in own if g == 1) - 10
        all_u = [sum(c) - 10 for c in combinations(range(1, 10), 4)]
        low, high = (sum(f(x) for x in all_u) / len(all_u) for f in (lambda x: x <= u, lambda x: x >= u))  # noqa: B023
        assert got[s]["u"] == u and got[s]["p"] == pytest.approx(min(1, 2 * min(low, high)))
    assert got[9]["p"] == pytest.approx(2 * NormalDist().cdf(-abs(got[9]["z"])))
    d = {1: [0.5, -0.2, 1.5, 2.0, -0.1, 0.0], 2: [1.0, 2.0, 3.0], 3: [1.0, -1.0, 2.0]}
    told = {r["spot_id"]: r for r in statistics.signed_rank_tested(spark.createDataFrame([(s, v) for s, own in d.items() for v in own], "spot_id long, d double")).collect()}
    for s in (1, 2):
        own = sorted((v for v in d[s] if v), key=abs)
        w = sum(k for k, v in enumerate(own, 1) if v > 0)
        sums = [sum(k for k, up in enumerate(signs, 1) if up) for signs in product([0, 1], repeat=len(own))]
        low, high = (sum(f(x) for x in sums) / len(sums) for f in (lambda x: x <= w, lambda x: x >= w))  # noqa: B023
        assert (told[s]["n"], told[s]["w"]) == (len(own), w) and told[s]["p"] == pytest.approx(min(1, 2 * min(low, high)))
    assert told[3]["w"] == 4.5 and told[3]["p"] == pytest.approx(2 * NormalDist().cdf(-abs(told[3]["z"])))

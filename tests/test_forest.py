"""Random forest and k-means against loops that make the same draws."""

from __future__ import annotations

import math

import numpy as np
import pytest

from ionframe.operators import forest, kmeans


def table_of(spots, runs, seed):
    rng = np.random.default_rng(seed)
    labels = [k * 3 // runs for k in range(runs)]
    x = np.round(rng.normal(size=(spots, runs)), 1)  # with ties
    x[0] += np.array(labels) * 2.0
    x[1] -= (np.array(labels) == 2) * 3.0
    x[2] = 1.0
    return x, labels


def gini(weights, own):
    counts = np.bincount(own, weights, 3)
    return weights.sum() - (counts**2).sum() / max(weights.sum(), 1e-300)


def grown_loop(x, labels, trees, seed):
    spots, runs = x.shape
    own, share, out = np.array(labels), math.isqrt(spots), []
    leaves = np.zeros((trees, runs), int)
    drawn = forest.bootstraps(trees, runs, seed)
    for t in range(trees):
        level, made = [0], 1
        while level:
            after = []
            for node in level:
                inside = leaves[t] == node
                w = drawn[t] * inside
                if len(set(own[w > 0])) < 2:
                    continue
                a, b = forest.draws(np.array([t]), np.array([node]), spots, seed)
                best = None
                for j in range(spots):
                    if (a[0] * j + b[0]) % spots >= share:
                        continue
                    values = sorted(set(x[j][w > 0]))
                    for lo, hi in zip(values, values[1:]):
                        cut = (lo + hi) / 2
                        gain = gini(w, own) - gini(w * (x[j] <= cut), own) - gini(w * (x[j] > cut), own)
                        if gain > 1e-12 and (best is None or round(gain, 9) > best[0]):
                            best = round(gain, 9), j, cut
                if best is None:
                    continue
                out.append((t, node, best[0], best[1], best[2], made, made + 1))
                left = x[best[1]] <= best[2]
                leaves[t][inside & left], leaves[t][inside & ~left] = made, made + 1
                after += [made, made + 1]
                made += 2
            level = after
    return sorted(out), leaves


def test_forest_equals_the_loop(spark):
    x, labels = table_of(30, 15, 4)
    rows = spark.createDataFrame([(j, [float(v) for v in x[j]]) for j in range(30)], "spot_id long, x array<double>").coalesce(1)
    got = forest.grow(rows, labels, 12, 5)
    expected, leaves = grown_loop(x, labels, 12, 5)
    assert [(t, n, s, a, b) for t, n, _, s, _, a, b in sorted(got.splits)] == [(t, n, s, a, b) for t, n, _, s, _, a, b in expected]
    assert [g for _, _, g, *_ in sorted(got.splits)] == pytest.approx([g for _, _, g, *_ in expected])
    assert [s[4] for s in sorted(got.splits)] == pytest.approx([s[4] for s in expected])
    assert (got.node_of == leaves).all()
    error, told = forest.out_of_bag(got, labels)
    assert error == np.mean([a != b for a, b in zip(told, labels) if a is not None]) and error < 0.6
    found = {r["spot_id"]: r for r in forest.importance(rows, got, labels, 5).collect()}
    assert set(found) == {s[3] for s in expected}
    for spot, r in found.items():
        assert r["gini"] == pytest.approx(sum(s[2] for s in expected if s[3] == spot) / 12)
    assert max(found, key=lambda s: found[s]["gini"]) in (0, 1)
    falls = {}
    for t in range(12):
        bag = np.flatnonzero(got.drawn[t] == 0)
        called = forest.leaf_classes(labels, got.drawn[t], got.node_of[t])
        splits = {s[1]: s for s in expected if s[0] == t}

        def hits(table):
            n = 0
            for run in bag:
                k = 0
                while k in splits:
                    k = splits[k][5] if table[splits[k][3], run] <= splits[k][4] else splits[k][6]
                n += called.get(k) == labels[run]
            return n

        for spot in {s[3] for s in splits.values()}:
            other = x.copy()
            other[spot, bag] = x[spot, bag[np.random.default_rng([5, t, spot]).permutation(len(bag))]]
            falls[spot] = falls.get(spot, 0.0) + (hits(x) - hits(other)) / max(len(bag), 1)
    for spot, fall in falls.items():
        assert found[spot]["accuracy_fall"] == pytest.approx(fall / 12)


def test_each_node_draws_as_many_spots():
    a, b = forest.draws(np.zeros(50, int), np.arange(50), 36, 3)
    taken = (a[:, None] * np.arange(36)[None] + b[:, None]) % 36 < 6
    assert (taken.sum(1) == 6).all() and len({tuple(t) for t in taken}) > 10


def test_pure_labels_and_no_spots(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "spot_id long, x array<double>")
    assert forest.grow(rows, [1, 1, 1], 3).splits == []
    assert forest.grow(rows.limit(0), [1, 2, 1], 3).splits == []


def kmeans_loop(points, k, restarts, seed):
    best = None
    ids, x = list(points), np.array(list(points.values()))
    for r in range(restarts):
        centres = []
        for step in range(k):
            d = [1.0] * len(ids) if not centres else [min(((p - c) ** 2).sum() for c in centres) for p in x]
            keys = [(math.log(kmeans.chance(seed, r, step, i)) / w, -i, n) for n, (i, w) in enumerate(zip(ids, d)) if w > 1e-12]
            centres.append(x[max(keys)[2]])
        c = np.array(centres)
        while True:
            own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            new = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c, atol=1e-12):
                break
            c = new
        within = ((x - c[own]) ** 2).sum()
        if best is None or within < best[0] - 1e-9:
            best = within, dict(zip(ids, own.tolist()))
    return best


def test_clusters_equal_the_loop(spark):
    rng = np.random.default_rng(9)
    points = {k: rng.normal(size=4) + (k % 3) * 1.5 for k in range(60)}
    frame = spark.createDataFrame([(k, [float(v) for v in x]) for k, x in points.items()], "id long, x array<double>").repartition(4)
    got = kmeans.clustered(frame, 4, 6, 3).collect()
    within, own = kmeans_loop(points, 4, 6, 3)
    assert {r["id"]: r["cluster"] for r in got} == own
    assert got[0]["within"] == pytest.approx(within)

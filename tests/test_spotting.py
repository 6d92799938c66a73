"""Spotting, deconvolution, robust drift and linkage against loops and known mixtures."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ionframe.operators import clustering, smoothers, spotting


def gauss(x, at, wide, high):
    return high * np.exp(-0.5 * ((x - at) / wide) ** 2)


def run_of(file_id, ions, n=120):
    """Centroids of ions (mz, apex scan, width, height) that jitter a little in mass."""
    rng = random.Random(file_id)
    rows = []
    for k in range(n):
        rows.append((file_id, k / 10, 999.0, 1.0))  # every scan has some point
        for mz, at, wide, high in ions:
            y = gauss(k, at, wide, high)
            if y > high * 1e-4:
                rows.append((file_id, k / 10, mz + rng.choice([-0.002, 0.0, 0.002]), float(y)))
    return rows


IONS = [(200.01, 30, 3, 1000.0), (200.06, 33, 3, 800.0), (200.01, 70, 4, 500.0), (300.0999, 50, 3, 400.0), (300.1001, 90, 2, 900.0)]


@pytest.mark.parametrize("shift", [0.0, 0.013, 0.05, 0.087])
def test_spotted_peaks_do_not_depend_on_the_slices(spark, shift):
    """Ions at slice borders, neighbours in one slice, two peaks of one mass; both runs alike."""
    rows = run_of(1, [(m + shift, *rest) for m, *rest in IONS]) + run_of(2, [(m + shift, *rest) for m, *rest in IONS])
    frame = spark.createDataFrame(rows, "file_id long, rt double, mz double, intensity double")
    got = spotting.spot_peaks(frame, spotting.Rule(width=0.1, tol=0.01, smooth=2, least_scans=4, least_height=50.0)).collect()
    for file_id in (1, 2):
        own = sorted((round(r["mz"] - shift, 2), round(r["rt"], 3)) for r in got if r["file_id"] == file_id)
        assert own == sorted((round(m, 2), at / 10) for m, at, _, _ in IONS)
    for r in got:
        m, at, wide, high = min(IONS, key=lambda i: (abs(i[0] + shift - r["mz"]) > 0.01, abs(i[1] / 10 - r["rt"])))
        line = spotting.smooth(gauss(np.arange(120), at, wide, high), 2)
        assert r["height"] == pytest.approx(line[at], rel=1e-3) and r["area"] == pytest.approx(line.sum() / 10, rel=0.01)


def test_tops_by_hand():
    assert spotting.tops(np.array([0.0, 1, 3, 3, 2, 2, 1, 5, 4])) == [(0, 2, 6), (6, 7, 8)]
    assert spotting.tops(np.array([1.0, 1, 1])) == [] and spotting.tops(np.array([3.0, 2, 1])) == []


def test_nonnegative_least_squares():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, x = rng.normal(size=(12, 4)), np.maximum(0, rng.normal(size=4))
        assert spotting.nonnegative(a, a @ x) == pytest.approx(x, abs=1e-9)
        b = rng.normal(size=12)
        got = spotting.nonnegative(a, b)
        slope = a.T @ (b - a @ got)
        assert (got >= 0).all() and (slope[got > 0] == pytest.approx(0, abs=1e-9)) and (slope[got == 0] <= 1e-9).all()


A, B = {50.0: 100.0, 60.0: 40.0, 70.0: 30.0}, {55.0: 80.0, 60.0: 90.0, 70.0: 10.0, 75.0: 5.0}


def test_a_mixture_comes_apart(spark):
    """Two spectra with shared ions, apexes four scans apart."""
    x, rows = np.arange(60), []
    for k in x:
        for m in sorted({*A, *B}):
            y = A.get(m, 0.0) * gauss(k, 28, 3, 1) + B.get(m, 0.0) * gauss(k, 32, 3, 1)
            rows.append((1, float(k) / 10, 500.0, m, float(y)))
    rows += [(1, 2.8, 700.0, 50.0, 1e6), (2, 2.8, 500.0, 50.0, 1e6), (1, 9.0, 500.0, 50.0, 1e6)]  # other precursor, run, time
    products = spark.createDataFrame(rows, "file_id long, rt double, precursor_mz double, mz double, intensity double")
    peaks = spark.createDataFrame([(1, 1, 500.1, 2.8, 2.0, 3.6), (2, 1, 500.1, 3.2, 2.4, 4.0), (3, 3, 500.0, 1.0, 0.0, 2.0)], "peak_id long, file_id long, mz double, rt double, rt_left double, rt_right double")
    got = spotting.deconvoluted(peaks, products, 0.01, 0.5, 0.8).collect()
    assert all(r["deconvoluted"] for r in got) and {r["peak_id"] for r in got} == {1, 2}
    for peak, spectrum in ((1, A), (2, B)):
        own = {r["mz"]: r["intensity"] for r in got if r["peak_id"] == peak and r["intensity"] > 1e-6}
        assert own == pytest.approx(spectrum, rel=1e-6)


def test_single_scans_stay_as_they_are(spark):
    products = spark.createDataFrame([(1, 1.0, 500.0, 50.0, 3.0), (1, 1.0, 500.0, 50.004, 4.0), (1, 1.0, 500.0, 60.0, 1.0)], "file_id long, rt double, precursor_mz double, mz double, intensity double")
    peaks = spark.createDataFrame([(1, 1, 500.0, 1.0, 1.0, 1.0), (2, 1, 600.0, 1.0, 1.0, 1.0)], "peak_id long, file_id long, mz double, rt double, rt_left double, rt_right double")
    got = {(r["peak_id"], r["mz"]): r["intensity"] for r in spotting.deconvoluted(peaks, products, 0.01, 0.5, 0.5).collect()}
    assert got == {(1, 50.004): 7.0, (1, 60.0): 1.0}


def lowess_loop(x, y, span, rounds):
    n, g, fit = len(x), [1.0] * len(x), list(y)
    held = min(n, max(2, int(n * span)))
    for _ in range(rounds):
        for j in range(n):
            near = sorted((k for k in range(n) if abs(k - j) <= held), key=lambda k: (abs(x[k] - x[j]), k))[:held]
            far = max(abs(x[k] - x[j]) for k in near)
            w = np.array([(1 - (abs(x[k] - x[j]) / far) ** 3) ** 3 * g[k] if far else 0.0 for k in near])
            d = np.array([x[k] - x[j] for k in near])
            v = np.array([y[k] for k in near])
            det = (w * d * d).sum() * w.sum() - (w * d).sum() ** 2
            fit[j] = ((w * d * d).sum() * (w * v).sum() - (w * d).sum() * (w * d * v).sum()) / det if det != 0 else v.mean()
        left = np.abs(np.array(y) - np.array(fit))
        middle = np.median(left)
        g = [(1 - (r / 6 / middle) ** 2) ** 2 if r < 6 * middle else 0.0 for r in left]
    return fit


def test_lowess_equals_the_loop():
    rng = np.random.default_rng(1)
    x = np.sort(rng.choice(np.arange(100), 15, replace=False)).astype(float)
    y = rng.normal(100, 10, size=(6, 15))
    y[1, 7] = 900.0  # an outlier loses its weight
    y[2] = 5.0
    for span in (0.2, 0.5, 1.0):
        got = smoothers.lowess(x, y, span)
        for row, expected in zip(got, y, strict=True):
            assert row == pytest.approx(lowess_loop(x, expected, span, 3), rel=1e-9)


def test_spline_solves_the_system():
    rng = np.random.default_rng(2)
    for n in (2, 3, 4, 9):
        x = np.cumsum(rng.uniform(0.5, 2, n))
        y = rng.normal(size=(3, n))
        h = np.diff(x)
        m = np.zeros((n, n))
        m[0, 0] = m[-1, -1] = 1
        r = np.zeros((n, 3))
        for k in range(1, n - 1):
            m[k, k - 1 : k + 2] = h[k - 1], 2 * (h[k - 1] + h[k]), h[k]
            r[k] = 6 * ((y[:, k + 1] - y[:, k]) / h[k] - (y[:, k] - y[:, k - 1]) / h[k - 1])
        bend = smoothers.spline(x, y)
        assert bend == pytest.approx(np.linalg.solve(m, r).T, abs=1e-12)
        assert smoothers.spline_at(x, y, bend, x) == pytest.approx(y)
        assert smoothers.spline_at(x, y[:, :2], bend[:, :2], x[:1] - 1).shape == (3, 1) if n == 2 else True


def test_drift_goes_and_small_batches_stay(spark):
    """A smooth drift over the controls is divided out; two controls change nothing."""
    rows, samples = [], []
    for k in range(40):
        batch = 1 if k < 30 else 2
        control = (k % 3 == 0 and batch == 1) or k in (31, 35)
        samples.append((k, "QC" if control else "Sample", k + 1, batch))
        drift = 1 + 0.02 * k
        rows += [(1, k, 100.0 * drift), (2, k, 7.0), (3, k, 0.0)]
    values = spark.createDataFrame(rows, "spot_id long, file_id long, value double")
    files = spark.createDataFrame(samples, "file_id long, sample_type string, injection_order long, batch long")
    got = {(r["spot_id"], r["file_id"]): r["value"] for r in smoothers.lowess_normalised(values, files, 0.7).collect()}
    controls = [100 * (1 + 0.02 * k) for k, kind, _, _ in samples if kind == "QC"]
    assert [got[1, k] for k in range(28)] == pytest.approx([np.median(controls)] * 28, rel=1e-9)
    assert [got[1, k] for k in range(30, 40)] == pytest.approx([100 * (1 + 0.02 * k) for k in range(30, 40)])
    assert [got[2, k] for k in range(40)] == pytest.approx([7.0] * 40) and {got[3, k] for k in range(40)} == {0.0}


def test_spans_equal_the_loop(spark):
    rng = np.random.default_rng(6)
    x = np.arange(1.0, 13.0)
    y = rng.normal(50, 5, size=(4, 12)) + np.sin(x / 2) * 30
    least = smoothers.least_span(12)
    expected = []
    for row in y:
        best, at, span = np.inf, 0.7, max(least, smoothers.least_span(10))
        while span <= 1.0:
            total, tried = 0.0, 0
            for f in range(7):
                test = [k for k in range(12) if k % 7 == f]
                train = [k for k in range(12) if k % 7 != f]
                fit = np.array(lowess_loop(x[train], row[train], span, 3))[None]
                told = smoothers.spline_at(x[train], fit, smoothers.spline(x[train], fit), x[test])[0]
                told = np.where(told <= 0, row[train].mean(), told)
                total, tried = total + ((told - row[test]) ** 2).mean(), tried + 1
            if total / tried < best:
                best, at = total / tried, span
            span += 0.05
        expected.append(round(at, 3))
    values = spark.createDataFrame([(s, k, float(y[s, k])) for s in range(4) for k in range(12)], "spot_id long, file_id long, value double")
    files = spark.createDataFrame([(k, "QC", k + 1, 1) for k in range(12)], "file_id long, sample_type string, injection_order long, batch long")
    got = {r["spot_id"]: r["span"] for r in smoothers.tuned_spans(values, files).collect()}
    assert [got[s] for s in range(4)] == expected
    assert smoothers.tuned_span(values, files).first()["span"] == pytest.approx(round(np.mean(expected), 2))


def linkage_loop(d, kind):
    n = len(d)
    d = d**2 if kind == "ward" else d.copy()
    size, live, out = {k: 1 for k in range(n)}, list(range(n)), []
    while len(live) > 1:
        h, a, b = min((d[a, b], a, b) for a in live for b in live if a < b)
        for o in live:
            if o not in (a, b):
                na, nb, no = size[a], size[b], size[o]
                new = {"single": min(d[a, o], d[b, o]), "complete": max(d[a, o], d[b, o]), "average": (na * d[a, o] + nb * d[b, o]) / (na + nb), "ward": ((na + no) * d[a, o] + (nb + no) * d[b, o] - no * h) / (na + nb + no)}[kind]
                d[a, o] = d[o, a] = new
        size[a] += size[b]
        live.remove(b)
        out.append((a, b, float(np.sqrt(max(0, h)) if kind == "ward" else h), size[a]))
    return sorted(out, key=lambda m: (m[2], m[0]))


@pytest.mark.parametrize("together", [1, 6, 1024])
@pytest.mark.parametrize("kind", clustering.LINKAGES)
def test_merges_equal_the_loop(spark, monkeypatch, kind, together):
    """In rounds only, rounds and a rest, in one task."""
    monkeypatch.setattr(clustering, "TOGETHER", together)
    points = np.random.default_rng(8).normal(size=(14, 3))
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    pairs = [(a, b, float(d[a, b])) for a in range(14) for b in range(a + 1, 14)]
    got = clustering.linkage(spark.createDataFrame(pairs, "a long, b long, d double"), kind).collect()
    mine = sorted(((r["left"], r["right"], r["height"], r["size"]) for r in got), key=lambda m: (m[2], m[0]))
    expected = linkage_loop(d, kind)
    assert [m[:2] + m[3:] for m in mine] == [m[:2] + m[3:] for m in expected]
    assert [m[2] for m in mine] == pytest.approx([m[2] for m in expected])


def test_no_pairs_and_unknown_linkage(spark):
    assert clustering.linkage(spark.createDataFrame([], "a long, b long, d double")).count() == 0
    with pytest.raises(ValueError, match="linkage"):
        clustering.linkage(spark.createDataFrame([], "a long, b long, d double"), "median")

"""Rules checked on small cases worked out by hand, and loops that rounds must equal."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionframe.functions import chemistry
from ionframe.operators import leaders, matching, matrix, network, quantities, search, signal
from ionframe.plans import views
from ionframe.queries import alignment


def trace_of(spark, *values):
    return spark.createDataFrame([(1, float(k), float(v)) for k, v in enumerate(values)], "file_id long, rt double, intensity double")


def test_peak_summary_by_hand(spark):
    got = signal.peak_summary(trace_of(spark, 0, 1, 10, 50, 100, 60, 20, 4, 0)).first()
    assert (got["apex_rt"], got["apex_intensity"], got["rt_left"], got["rt_right"], got["n_points"]) == (4.0, 100.0, 1.0, 7.0, 7)
    assert got["area"] == pytest.approx(242.5) and got["fwhm"] == pytest.approx(2.25)
    assert got["noise"] == pytest.approx(15.5 * 1.4826 / math.sqrt(2)) and got["snr"] == pytest.approx(100 / got["noise"])


def test_peak_ends_before_a_rise(spark):
    got = signal.peak_summary(trace_of(spark, 0, 40, 100, 30, 60, 0)).first()
    assert (got["rt_left"], got["rt_right"], got["area"]) == (0.0, 3.0, 20 + 70 + 65)


def test_noise_falls_back_to_the_lower_half(spark):
    assert signal.automatic_noise(trace_of(spark, 5, 5, 5, 5, 7, 5)).first()["noise"] is None
    assert signal.automatic_noise(trace_of(spark, 1, 1, 1, 2, 2, 9, 9, 9)).first()["noise"] == pytest.approx(np.std([1, 1, 1, 2], ddof=1))
    assert signal.automatic_noise(trace_of(spark, 1, 2)).count() == 0


def test_apex_patterns_and_gap_walk(spark):
    points = signal.numbered(trace_of(spark, 0, 3, 3, 2, 2, 1, 5, 5, 4, 0))
    assert sorted(r["rt"] for r in points.where(signal.is_apex()).collect()) == [2.0, 6.0, 7.0]  # rise or level, then fall; rise, then level or fall
    got = signal.gaps_filled(trace_of(spark, 9, 1, 2, 4, 8, 6, 5, 3, 7, 9), 4.0, 1.0).first()
    assert (got["apex_rt"], got["height"], got["rt_left"], got["rt_right"]) == (4.0, 8.0, 1.0, 7.0)
    assert got["area"] == pytest.approx((1.5 + 3 + 6 + 7 + 5.5 + 4) * 60)
    assert got["area_above_baseline"] == pytest.approx(got["area"] - (1 + 3) * 6 / 2 * 60)


def test_reintegration_clamps_at_the_baseline(spark):
    got = signal.reintegrated(trace_of(spark, 4, 1, 4), 0.0, 2.0).first()
    assert got["area"] == pytest.approx(5 * 60) and got["area_above_baseline"] == 0.0


def test_correction_moves_on_by_one_knot(spark):
    points = spark.createDataFrame([(1, float(x)) for x in (0, 5, 10, 15, 20, 25)] + [(2, 3.0)], "file_id long, rt double")
    anchors = spark.createDataFrame([(1, 10.0, 1.0), (1, 20.0, 3.0)], "file_id long, rt double, shift double")
    got = {(r["file_id"], r["rt"]): r["corrected"] for r in signal.rt_corrected(points, anchors).collect()}
    assert [got[1, x] for x in (0, 5, 10, 15, 20, 25)] == pytest.approx([1e-5, 4, 9, 13, 17, 22]) and got[2, 3.0] == 3.0


def test_retention_index_outside_the_ladder_joins_its_ends(spark):
    ladder = spark.createDataFrame([(10, 1.0), (11, 2.0), (12, 4.0)], "carbon int, ladder_rt double")
    points = spark.createDataFrame([(0.5,), (1.5,), (3.0,), (4.0,), (7.0,)], "rt double")
    got = {r["rt"]: r["retention_index"] for r in signal.kovats(points, ladder).collect()}
    slope = 200 / 3
    assert got == pytest.approx({0.5: 1000 - slope / 2, 1.5: 1050, 3.0: 1150, 4.0: 1200, 7.0: 1200 + 3 * slope})


def test_centroids_and_baseline(spark):
    profile = spark.createDataFrame([(1, float(m), float(y)) for m, y in ((1, 0), (2, 4), (3, 8), (4, 4), (5, 0), (6, 2), (7, 2))], "spectrum_id long, mz double, intensity double")
    assert sorted((r["mz"], r["intensity"]) for r in signal.centroids(profile).collect()) == [(3.0, 8.0), (6.5, 2.0)]
    got = [r["intensity"] for r in signal.baseline_corrected(trace_of(spark, 1, 5, 3, 3, 9, 5), 3.0).orderBy("rt").collect()]
    assert got == pytest.approx([0, 5 - 5 / 3, 3 - 7 / 3, 0, 6, 2])


def test_smoothers(spark):
    got = [r["smooth"] for r in signal.gaussian_smoothed(trace_of(spark, 0, 0, 1, 0, 0), 0.3).orderBy("rt").collect()]
    w = math.exp(-0.5 / 0.09)
    assert got == pytest.approx([0, w / (1 + 2 * w), 1 / (1 + 2 * w), w / (1 + 2 * w), 0])
    assert [r["smooth"] for r in signal.time_weighted(trace_of(spark, 0, 3, 0), 2.0).orderBy("rt").collect()] == pytest.approx([1, 1.5, 1])


SAMPLES = [(1, "a", "Blank"), (2, "a", "QC"), (3, "b", "Sample"), (4, "b", "Sample"), (5, "b", "QC")]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(SAMPLES, "file_id long, class string, sample_type string")


def test_files_without_a_peak_count_as_zero(spark, samples):
    values = spark.createDataFrame([(1, 3, 3.0), (1, 4, 6.0), (2, 1, 5.0)], "spot_id long, file_id long, height double")
    got = {(r["spot_id"], r["class"]): (r["n"], r["average"], r["stdev"]) for r in matrix.class_statistics(values, samples).collect()}
    assert got[1, "b"] == pytest.approx((2, 3.0, 3.0)) and got[1, "a"] == (0, 0.0, 0.0)
    assert got[2, "a"] == pytest.approx((1, 2.5, np.std([5, 0], ddof=1))) and got[2, "b"] == (0, 0.0, 0.0)
    assert {r["spot_id"]: r["rsd"] for r in matrix.relative_deviation(values, samples).collect()} == pytest.approx({1: 100.0})
    assert [r["spot_id"] for r in matrix.qc_detected(values, samples).collect()] == []


def test_blank_filter_and_zero_blanks(spark, samples):
    rows = [(1, f, h) for f, h in ((1, 2.0), (3, 3.0), (4, 3.0))] + [(2, f, h) for f, h in ((1, 2.0), (3, 3.0), (4, 2.0))] + [(3, 3, 0.01)]
    rows += [(4, f, 0.0 if f == 1 else 0.5) for f in range(1, 6)] + [(5, f, 0.0 if f == 1 else 0.5 if f < 5 else 0.00005) for f in range(1, 6)]
    values = spark.createDataFrame(rows, "spot_id long, file_id long, height double")
    got = {r["spot_id"]: r["blank_level"] for r in matrix.blank_filter(values, samples, 1.5).collect()}
    # 3: a file without a peak makes the level zero; 4: a measured zero does so too
    assert got == pytest.approx({1: 2.0, 3: 0.0, 4: 0.0, 5: 0.0})
    full = spark.createDataFrame([(1, 3, 0.5), (1, 1, 0.0)], "spot_id long, file_id long, height double")
    assert matrix.blank_filter(full, samples.where("file_id in (3)"), 1.5).count() == 1  # no blank files


def test_relative_amplitude_is_clamped(spark):
    values = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0), (2, 1, 32.0), (3, 1, 2.0)], "spot_id long, file_id long, height double")
    assert {r["spot_id"]: r["amplitude"] for r in matrix.relative_amplitudes(values).collect()} == pytest.approx({1: 0.25, 2: 1.0, 3: 0.0})


def test_squared_cosine_by_hand(spark):
    rows = [([(100.0, 1.0), (200.0, 4.0)], [(100.04, 1.0), (200.0, 4.0), (300.0, 5.0)], 0.05), ([(100.0, 1.0)], [(99.5, 1.0), (100.5, 4.0)], 1.0), ([(1.0, 1.0)], [(5.0, 1.0)], 1.0)]
    expected = [0.5, 0.8, 0.0]  # with equal distances the later peak is taken
    kind = "array<struct<mz:double,intensity:double>>"
    for (a, b, tol), e in zip(rows, expected, strict=True):
        got = spark.createDataFrame([(a, b)], f"a {kind}, b {kind}").select(network.squared_cosine(F.col("a"), F.col("b"), tol).alias("s")).first()["s"]
        assert got == pytest.approx(e)


def test_spectral_edges_with_close_peaks_equal_all_pairs(spark):
    rng = random.Random(4)
    spectra = {k: sorted((round(rng.choice([50.0, 60.0, 70.0, 80.0]) + rng.choice([0, 0.03, 0.06]), 2), float(rng.randint(1, 9))) for _ in range(4)) for k in range(30)}
    spectra = {k: [(m, i) for n, (m, i) in enumerate(s) if n == 0 or s[n - 1][0] != m] for k, s in spectra.items()}
    rows = [(k, m, i) for k, s in spectra.items() for m, i in s]

    def cosine(a, b):
        taken, dot = set(), 0.0
        for m, i in a:
            near = [(abs(n - m), -q, j) for q, (n, j) in enumerate(b) if abs(n - m) <= 0.05 and q not in taken]
            if near:
                _, q, j = min(near)
                taken.add(-q)
                dot += math.sqrt(i * j)
        return dot * dot / (sum(i for _, i in a) * sum(j for _, j in b))

    expected = {(x, y): cosine(spectra[x], spectra[y]) for x in spectra for y in spectra if x < y and min(len(spectra[x]), len(spectra[y])) >= 2}
    got = network.spectral_edges(spark.createDataFrame(rows, "spectrum_id long, mz double, intensity double"), 0.6, 0.05, 2)
    assert {(r["source"], r["target"]): r["similarity"] for r in got.collect()} == pytest.approx({k: v for k, v in expected.items() if v >= 0.6})


@pytest.mark.parametrize("together", [0, 100, 1 << 18])
def test_masters_equal_the_loop(spark, monkeypatch, together):
    """In rounds only, rounds and a rest, in one task."""
    monkeypatch.setattr(leaders, "TOGETHER", together)
    rng = random.Random(9)
    peaks = [(k, rng.randint(1, 4), round(rng.uniform(100, 104), 3), round(rng.uniform(0, 10), 2)) for k in range(300)]
    masters = [p for p in peaks if p[1] == 3]
    for p in sorted((p for p in peaks if p[1] != 3), key=lambda p: (p[1], p[0])):
        if not any(abs(p[2] - m[2]) <= 0.2 and abs(p[3] - m[3]) <= 1.0 for m in masters):
            masters.append(p)
    df = spark.createDataFrame(peaks, "peak_id long, file_id long, mz double, rt double")
    got = {r["id"] for r in leaders.master_list(df, 0.2, 1.0, 3).where("id = leader").collect()}
    assert got == {m[0] for m in masters}


def ion_loop(features, steps, rt_tol, mz_tol, least):
    """Tallest first; features: (id, mz, rt, height, isotope weight, heights)."""

    def relation(f, o):
        up = o[1] - f[1]
        if o[4] > 0 and abs(up - 1.00336 * o[4]) < 2 * mz_tol:
            return "isotope"
        if any(abs(up - s) < mz_tol or abs(-up - s) < mz_tol for s in steps):
            return "adduct"
        if abs(up - (f[1] - leaders.PROTON)) < 2 * mz_tol:
            return "multimer"
        return "in-source" if any(abs(-up - s) < mz_tol for s in leaders.LOSSES.values()) else None

    found = {}
    for f in sorted(features, key=lambda f: (-f[3], f[0])):
        if f[0] in found:
            continue
        found[f[0]] = (f[0], "representative")
        for o in features:
            if o[0] not in found and abs(o[2] - f[2]) <= rt_tol and relation(f, o) and np.std(f[5]) > 0 and np.std(o[5]) > 0 and np.corrcoef(f[5], o[5])[0, 1] >= least:
                found[o[0]] = (f[0], relation(f, o))
    return found


def ion_steps(positive):
    return [*leaders.ADDUCT_STEPS.values(), leaders.SODIUM_FOR_AMMONIUM] if positive else list(leaders.NEGATIVE_STEPS.values())


@pytest.mark.parametrize("positive", [True, False])
def test_ion_groups_equal_the_loop(spark, positive):
    rng = random.Random(12)
    steps = ion_steps(positive)
    features = []
    for k in range(120):
        base = rng.choice([150.0, 200.0])
        features.append((k, base + rng.choice([0, *steps, -18.010565, base - leaders.PROTON, 1.00336]), rng.choice([1.0, 1.03, 2.0]), float(rng.randint(1, 60)), rng.randint(0, 1), [float(rng.randint(1, 9)) for _ in range(4)]))
    expected = ion_loop(features, steps, 0.05, 0.01, 0.3)
    df = spark.createDataFrame(features, "id long, mz double, rt double, height double, isotope_weight int, heights array<double>")
    got = {r["id"]: (r["leader"], r["relation"]) for r in leaders.ion_groups(df, least=0.3, positive=positive).collect()}
    assert got == expected and len({v[1] for v in got.values()}) >= 3


@pytest.mark.parametrize("positive", [True, False])
def test_ion_identity_of_the_tables(spark, positive):
    """The query's own features: profiles are aligned by run."""
    sf = "/root/testdata/sf0.001"
    features = [tuple(r) for r in alignment.ion_features(spark, sf).collect()]
    assert {len(f[5]) for f in features} == {10} and any(0.0 in f[5] for f in features)
    query = alignment.ion_identity if positive else alignment.ion_identity_negative
    got = {r["id"]: (r["leader"], r["relation"]) for r in query(spark, sf).collect()}
    assert got == ion_loop(features, ion_steps(positive), 1.0, 0.5, 0.2) and len(set(got.values())) > 5


def assignment_loop(peaks, masters, mz_tol, rt_tol):
    """Peaks (id, file, mz, rt) in the order of ids; masters (id, mz, rt) by m/z and time."""
    out = {}
    masters = sorted(masters, key=lambda m: (m[1], m[2], m[0]))
    for file in {p[1] for p in peaks}:
        best = {}
        for p in sorted(p for p in peaks if p[1] == file):
            at, own = None, -1.0
            for m, mz, rt in masters:
                if abs(p[2] - mz) <= mz_tol and abs(p[3] - rt) <= rt_tol:
                    factor = round(math.exp(-0.5 * ((p[2] - mz) / mz_tol) ** 2) + math.exp(-0.5 * ((p[3] - rt) / rt_tol) ** 2), 9)
                    if factor > best.get(m, 0.0) and factor > own:
                        at, own = m, factor
                        best[m] = factor
            if at is not None:
                out[at, file] = p[0]
    return out


def test_assignment_equals_the_loop(spark):
    """Dense masses: most peaks find their best master held, and some lose it again."""
    rng = random.Random(5)
    peaks = [(k, k % 3, round(rng.choice([rng.uniform(100, 103), rng.uniform(110, 111)]), 3), round(rng.uniform(0, 6), 2)) for k in range(400)]
    masters = [(1000 + k, round(rng.choice([rng.uniform(100, 103), rng.uniform(110, 111)]), 3), round(rng.uniform(0, 6), 2)) for k in range(120)]
    df = spark.createDataFrame(peaks, "peak_id long, file_id long, mz double, rt double")
    ms = spark.createDataFrame(masters, "peak_id long, mz double, rt double")
    got = {(r["master_id"], r["file_id"]): r["peak_id"] for r in leaders.assigned(df, ms, 0.3, 1.0).collect()}
    assert got == assignment_loop(peaks, masters, 0.3, 1.0) and len(got) > 200


def test_assignment_of_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    peaks = [tuple(r) for r in views.peak(spark, sf).select("peak_id", "file_id", "mz", "rt").collect()]
    found = {r["id"] for r in leaders.master_list(views.peak(spark, sf), 0.5, 3.0, 7).where("id = leader").collect()}
    got = {(r["master_id"], r["file_id"]): r["peak_id"] for r in alignment.peak_assignment(spark, sf).collect()}
    assert got == assignment_loop(peaks, [(p[0], p[2], p[3]) for p in peaks if p[0] in found], 0.5, 3.0)


def test_pairs_and_strongest_edges_equal_loops(spark):
    rng = random.Random(2)
    edges = [(a, b, float(rng.randint(1, 8))) for a in range(25) for b in range(100, 120) if rng.random() < 0.2]
    used, pairs = set(), set()
    for a, b, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if not {a, b} & used:
            used |= {a, b}
            pairs.add((a, b, s))
    df = spark.createDataFrame(edges, "x long, y long, s double")
    assert {tuple(r) for r in leaders.paired(df, "x", "y", "s").collect()} == pairs
    degree, kept = {}, set()
    for a, b, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if degree.get(a, 0) < 3 and degree.get(b, 0) < 3:
            kept.add((a, b, s))
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    assert {tuple(r) for r in leaders.strongest_edges(df.toDF("source", "target", "score"), 3).collect()} == kept


def test_polarity_table_takes_whole_rows(spark):
    schema = "id long, name string, mz double, rt double, height double"
    p = spark.createDataFrame([(1, "A", 10.0, 1.0, 5.0), (2, "B", 20.0, 2.0, 5.0)], schema)
    n = spark.createDataFrame([(1, None, 8.0, 1.1, 9.0), (7, "C", 30.0, 3.0, 1.0)], schema)
    pairs = spark.createDataFrame([(1, 1, 45.0)], "positive_id long, negative_id long, strength double")
    assert sorted(tuple(r) for r in leaders.polarity_table(p, n, pairs).collect()) == [(1, "negative", "A", 8.0, 1.1, 9.0), (2, "positive", "B", 20.0, 2.0, 5.0), (1000007, "negative", "C", 30.0, 3.0, 1.0)]


def test_near_spots_merge_by_priority(spark):
    spots = spark.createDataFrame([(1, 100.0, 5.0, 2, 9.0), (2, 100.01, 5.04, 0, 1.0), (3, 100.02, 5.08, 1, 5.0), (4, 200.0, 5.0, 2, 1.0)], "spot_id long, mz double, rt double, priority int, height double")
    assert sorted(r["spot_id"] for r in leaders.spots_merged(spots, 0.02, 1.0).collect()) == [2, 4]  # 1 and 3 lie within 0.05 min of 2


def test_mass_groups_equal_the_loop(spark):
    rng = random.Random(6)
    rows = [(k, round(rng.uniform(95, 125), 2)) for k in range(400)]
    expected, first = {}, None
    for k, m in sorted(rows, key=lambda r: (r[1], r[0])):
        if first is None or m - first > 0.3:
            first = m
        expected[k] = first
    got = search.mass_groups(spark.createDataFrame(rows, "spot_id long, mz double"), 0.3)
    assert {r["spot_id"]: r["group_mz"] for r in got.collect()} == expected


def test_two_way_f_equals_least_squares(spark):
    rng = np.random.default_rng(3)
    rows = [(1, int(a), int(b), float(2 * a + b + rng.normal())) for a, b in rng.integers(0, 2, (40, 2))]
    got = quantities.two_way(spark.createDataFrame(rows, "spot_id long, one int, two int, height double"), "one", "two").first()
    y, a, b, one = (np.array(c, float) for c in ([r[3] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [1.0] * 40))
    rss = lambda *cols: np.linalg.lstsq(np.column_stack(cols), y, rcond=None)[1][0]
    full = rss(one, a, b)
    assert (got["f_one"], got["f_two"], got["df"]) == pytest.approx(((rss(one, b) - full) / (full / 37), (rss(one, a) - full) / (full / 37), 37))


def test_too_few_controls_change_nothing(spark):
    samples = spark.createDataFrame([(1, "QC", 1, 1), (2, "QC", 2, 1), (3, "Sample", 3, 1)], "file_id long, sample_type string, injection_order int, batch int")
    values = spark.createDataFrame([(1, f, float(f)) for f in (1, 2, 3)], "spot_id long, file_id long, height double")
    assert all(r["value"] == r["corrected"] for r in quantities.drift_corrected(values, samples).collect())


def test_scaled_matches_equal_all_pairs(spark):
    rng = random.Random(8)
    q, r = ([(k, round(rng.uniform(450, 2100), 3)) for k in range(200)] for _ in range(2))
    got = matching.scaled_matches(spark.createDataFrame(q, "query_id long, precursor_mz double"), spark.createDataFrame(r, "ref_id long, ref_mz double"), 0.5)
    expected = {(i, j) for i, m in q for j, n in r if abs(m - n) <= (0.5 if m <= 500 else m * 0.5 / 500)}
    assert {(x["query_id"], x["ref_id"]) for x in got.collect()} == expected and got.count() == len(expected)


def test_names_and_formulas(spark):
    names = ["PC 34:1", "TG 52:2|TG 16:0_18:1_18:1", "SM d18:1/16:0", "AHexCer d(O-14:0)16:1/14:0;O", "low score: PC O-34:1", "PC 15:0/18:1(d7)", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = df.select(chemistry.lipid_class(F.col("name")).alias("c"), chemistry.lipid_sum(F.col("name")).alias("s"), F.array_join(chemistry.lipid_chains(F.col("name")), ",").alias("l"), chemistry.annotation_level(F.col("name")).alias("a"), chemistry.is_standard(F.col("name")).alias("d")).collect()
    assert [(r["c"], r["s"]["carbons"], r["s"]["double_bonds"]) for r in got] == [("PC", 34, 1), ("TG", 52, 2), ("SM", 34, 1), ("AHexCer", 44, 1), ("PC", 34, 1), ("PC", 33, 1), ("", 0, 0)]
    assert [r["l"] for r in got[:3]] == ["34:1", "16:0,18:1,18:1", "18:1,16:0"]
    assert [r["a"] for r in got] == ["confident"] * 4 + ["suggested", "confident", ""] and [r["d"] for r in got] == [False] * 5 + [True, False]
    f = spark.createDataFrame([("C6H12O6",), ("Ca(NO3)2",), ("H2O",), ("Xy",)], "f string").select(chemistry.monoisotopic_mass(F.col("f")).alias("m"), chemistry.flat_formula(F.col("f")).alias("flat"), chemistry.ring_double_bonds(F.col("f")).alias("r")).collect()
    assert f[0]["m"] == pytest.approx(180.0633881, abs=1e-6) and f[0]["r"] == 1.0 and f[1]["m"] is None and f[1]["flat"] == "CaNO3NO3" and f[3]["m"] is None


def test_sources_are_checked(spark):
    scans = spark.createDataFrame([], "ms_level int, parent_mz double, experiment_id int")
    for bad in ("ms3", "gated:x", "channel:", "gated:"):
        with pytest.raises(ValueError, match="source|could not|invalid"):
            search.source_rows(scans, bad)


def test_matrix_lines_by_hand(spark):
    samples = spark.createDataFrame([(2, "two"), (1, "one")], "file_id long, file_name string")
    features = spark.createDataFrame([(7, "PC 34:1", 1.5, 760.5851, "[M+H]+", None), (8, None, 2.0, 100.0, "x", "TG")], "spot_id long, name string, rt double, mz double, adduct string, ontology string")
    values = spark.createDataFrame([(7, 2, 10.5, 99.4)], "spot_id long, file_id long, height double, area double")
    got = {r["spot_id"]: r["line"].split("\t") for r in matrix.matrix_lines(features, values, samples).collect()}
    assert got[7] == ["7", "PC 34:1", "1.500", "760.58510", "[M+H]+", "", "50", "0", "11", "0", "99"]
    assert got[8] == ["8", "", "2.000", "100.00000", "x", "TG", "0", "0", "0", "0", "0"]
    header = matrix.matrix_header(samples).first()["line"].split("\t")
    assert len(header) == len(got[7]) and header[7:] == ["one height", "two height", "one area", "two area"]

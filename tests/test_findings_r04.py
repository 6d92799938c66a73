"""Cases of the fourth round's findings."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ionframe.operators import discriminant, kmeans, leaders, matching, matrix, network, profiles, quantities, scans, statistics, summaries
from ionframe.queries import alignment, chemistry, results


def test_mean_does_not_depend_on_the_order(spark):
    heights = [(1, k, h) for k, h in enumerate((1e16, 1.0, -1e16))] + [(2, 0, math.nan), (2, 1, 1.0), (3, 0, 1e30), (3, 1, 3e30)]
    values = spark.createDataFrame(heights, "spot_id long, file_id long, height double").coalesce(1)
    got = {r["spot_id"]: r["m"] for r in values.groupBy("spot_id").agg(quantities.exact_mean(F.col("height")).alias("m")).collect()}
    assert got[1] == 1 / 3 and math.isnan(got[2]) and got[3] == 2e30


def test_representative_mean_is_rounded_from_the_exact_one(spark):
    values = spark.createDataFrame([(1, k, h) for k, h in enumerate((1e16, 1.0, -1e16))], "spot_id long, file_id long, height double").coalesce(1)
    samples = spark.range(3).select(F.col("id").alias("file_id"))
    assert quantities.representative(values, samples).first()["mean"] == 1 / 3


def silent(spark):
    rows = [(0, 1, 1, 1.0, 50.0, 0.0), (1, 1, 1, 2.0, 60.0, 0.0), (2, 1, 1, 2.0, 70.0, 4.0)]
    return spark.createDataFrame(rows, "scan_id long, file_id long, ms_level long, rt double, mz double, intensity double")


def test_peaks_without_intensity_stay_in_the_average(spark):
    got = scans.average_spectrum(silent(spark), 0.0, 10.0).collect()
    assert sorted(r["intensity"] for r in got) == [0.0, 0.0, 2.0]
    assert sum(math.isnan(r["mz"]) for r in got) == 2 and 70.0 in {r["mz"] for r in got}


def test_background_of_peaks_without_intensity(spark):
    mean = scans.average_spectrum(silent(spark), 0.0, 10.0)
    got = scans.subtracted(mean, mean).collect()
    assert [r["intensity"] for r in got] == [0.0, 0.0] and sum(math.isnan(r["mz"]) for r in got) == 1


def test_masters_of_repeated_places_meet_once(spark, monkeypatch):
    """Places that many peaks share: leaders as a loop gives them, edges only between places."""
    rng, seen = random.Random(3), []
    in_box = leaders.in_box
    monkeypatch.setattr(leaders, "in_box", lambda rows, *a: seen.append(rows.count()) or in_box(rows, *a))
    peaks = [(k, rng.randint(1, 4), float(rng.randint(0, 9)), float(rng.randint(0, 9))) for k in range(400)] + [(500, 1, None, 2.0), (501, 2, None, 2.0), (502, 1, math.nan, 2.0), (503, 2, math.nan, 2.0)]
    masters, expected = [p for p in peaks if p[1] == 3], {}
    for p in sorted((p for p in peaks if p[1] != 3), key=lambda p: (p[1], p[0])):
        near = [m for m in masters if None not in (p[2], m[2]) and abs(p[2] - m[2]) <= 1.0 and abs(p[3] - m[3]) <= 1.0]
        expected[p[0]] = min(near, key=lambda m: (m[1] != 3, m[1], m[0]))[0] if near else p[0]
        masters += [] if near else [p]
    df = spark.createDataFrame(peaks, "peak_id long, file_id long, mz double, rt double")
    got = {r["id"]: r["leader"] for r in leaders.master_list(df, 1.0, 1.0, 3).collect()}
    assert got == {**expected, **{p[0]: p[0] for p in peaks if p[1] == 3}}
    assert seen[0] <= 200


@pytest.mark.parametrize("step", [2.0, 0.0])
def test_components_of_repeated_places(spark, monkeypatch, step):
    """As from the links of all peaks; places meet once."""
    rng, seen = random.Random(5), []
    links = network.ion_links
    peaks = spark.createDataFrame([(k, rng.randint(0, 1), float(rng.randint(0, 60)), float(rng.randint(0, 5))) for k in range(150)] + [(k, 0, 30.0, 1.0) for k in range(150, 170)] + [(171, 0, None, 1.0), (172, 0, None, 1.0)], "peak_id long, file_id long, mz double, rt double")
    steps = spark.createDataFrame([("a", step), ("b", 7.0)], "relation string, difference double")
    every = links(peaks, steps, 0.1, 0.5).select(F.col("light_id").alias("first"), F.col("heavy_id").alias("second"))
    expected = {tuple(r) for r in leaders.components(every).select("id", "group").collect()}
    monkeypatch.setattr(network, "ion_links", lambda rows, *a: seen.append(rows.count()) or links(rows, *a))
    assert {tuple(r) for r in network.linked_components(peaks, steps, 0.1, 0.5).select("id", "group").collect()} == expected
    assert len(expected) > 20 and seen[0] < 155


@pytest.mark.parametrize("entries", [1 << 18, 20])
def test_sparse_correlations_equal_dense_ones(spark, monkeypatch, entries):
    """In one block a cell and in several."""
    monkeypatch.setattr(profiles, "ENTRIES", entries)
    monkeypatch.setattr(profiles, "PRODUCTS", 8)
    rng = random.Random(8)
    spots = {k: (rng.choice([0.2, 0.9, 1.1, 1.9, 5.0]), [rng.choice([0.0, 0.0, 1.0, 4.0, 9.0]) for _ in range(12)]) for k in range(60)}
    features = spark.createDataFrame([(k, t) for k, (t, _) in spots.items()], "id long, rt double")
    values = spark.createDataFrame([(k, f, h) for k, (_, hs) in spots.items() for f, h in enumerate(hs) if h], "id long, file_id long, height double")
    expected = {}
    for a, (t, x) in spots.items():
        for b, (u, y) in spots.items():
            if a < b and abs(t - u) <= 1.0 and np.std(x) > 0 and np.std(y) > 0 and round(np.corrcoef(x, y)[0, 1], 9) >= 0.3:
                expected[a, b] = np.corrcoef(x, y)[0, 1]
    got = {(r["one"], r["two"]): r["correlation"] for r in summaries.abundance_links_sparse(features, values, 12, 1.0, 0.3).collect()}
    assert got == pytest.approx(expected) and len(got) > 20


@pytest.mark.parametrize("positive", [True, False])
def test_ions_need_no_dense_profiles(spark, monkeypatch, positive):
    """The query makes no height for a run without a peak."""
    monkeypatch.setattr(quantities, "filled", None)
    query = alignment.ion_identity if positive else alignment.ion_identity_negative
    assert len(set(r["leader"] for r in query(spark, "/root/testdata/sf0.001").collect())) > 5


def test_runs_with_equal_heights_have_no_correlation(spark):
    """Such a pair stopped the query with a division by zero."""
    rows = [(s, f, h) for s in range(4) for f, h in ((0, 5.0), (1, 1.0 + s), (2, 4.0 - s))]
    got = {(r["file_a"], r["file_b"]): r["pearson"] for r in statistics.run_correlations(spark.createDataFrame(rows, "spot_id long, file_id long, height double")).collect()}
    assert got == {(0, 1): None, (0, 2): None, (1, 2): pytest.approx(-1.0)}


def test_products_of_runs_in_parts(spark, monkeypatch):
    """Blocks of spots, several tasks a block and sums in steps give what all pairs give; runs
    that share the spots of a block are summed before the shuffle."""
    for name, most in (("NEAR_SPOTS", 8), ("TASK_PRODUCTS", 40), ("HELD_PRODUCTS", 5)):
        monkeypatch.setattr(statistics, name, most)
    rng = np.random.default_rng(4)
    z = np.where(rng.random((30, 7)) < 0.6, rng.normal(size=(30, 7)), 0.0)
    rows = [(s, f, float(z[s, f])) for s in range(30) for f in range(7) if z[s, f]]
    gram = statistics.sample_gram(spark.createDataFrame(rows, "spot_id long, file_id long, z double"))
    got = {(r["file_a"], r["file_b"]): r["dot"] for r in gram.collect()}
    assert got == pytest.approx({(a, b): (z.T @ z)[a, b] for a in range(7) for b in range(a, 7)})
    alike = pa.table({"files": [[1, 2, 3]] * 9, "z": [[1.0, 2.0, 3.0]] * 9})
    assert statistics._run_products(alike, ("dot",), lambda x, y: (x * y,), True).num_rows == 6


def test_matrix_line_has_every_run(spark):
    """Runs of zeros are repeated text: gaps before, between and after peaks, a foreign run, none at all."""
    features = spark.createDataFrame([(1, "a", 1.0, 2.0, "x", "y"), (2, "b", 1.0, 2.0, "x", "y")], "spot_id long, name string, rt double, mz double, adduct string, ontology string")
    values = spark.createDataFrame([(1, 20, 3.0, 4.0), (1, 40, 5.5, None), (1, 99, 7.0, 7.0)], "spot_id long, file_id long, height double, area double")
    samples = spark.createDataFrame([(k,) for k in (10, 20, 30, 40, 50)], "file_id long")
    lines = matrix.matrix_lines(features, values, samples)
    got = {r["spot_id"]: r["line"].split("\t") for r in lines.collect()}
    assert got[1][6:] == ["60", *"03060", *"04000"] and got[2][6:] == ["0", *"0" * 10]
    assert "transform(files" not in lines._jdf.queryExecution().optimizedPlan().toString()


def test_isotope_patterns_are_made_once(spark):
    """The join and the filters before an explode do not make them again."""
    made = chemistry.isotope_patterns(spark, "/root/testdata/sf0.001")
    assert "aggregate(" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert made.select("spot_id").distinct().count() == 200


def test_drift_sorts_its_neighbours_once(spark):
    made = results.drift_corrected(spark, "/root/testdata/sf0.001")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("array_sort(") == 1


@pytest.mark.parametrize("keep, first", [(3, True), (100, False)])
def test_hits_within_bins_equal_hits_of_all_pairs(spark, monkeypatch, keep, first):
    """Peaks closer than the tolerance and masses above 500; references in steps; no row a pair."""
    monkeypatch.setattr(matching, "PRODUCTS", 40)
    rng = random.Random(6)
    spectra = [(k, rng.choice([200.0, 800.0, 1300.0]) + rng.randint(0, 9) / 20) for k in range(80)]
    peaks = [(k, m / 10, float(rng.randint(1, 9))) for k in range(80) for m in rng.sample(range(500, 560), rng.randint(1, 12))]
    fragments = spark.createDataFrame(peaks, "spectrum_id long, mz double, intensity double")
    queries, library = (spark.createDataFrame(spectra[a:b], f"{i} long, {m} double") for a, b, i, m in ((0, 30, "query_id", "precursor_mz"), (30, 80, "ref_id", "ref_mz")))
    sides = queries, library, fragments.where("spectrum_id < 30"), fragments.where("spectrum_id >= 30")
    scored = matching.annotated(matching.spectrum_scores(matching.scaled_matches(queries, library, 0.1), *sides[2:], 0.2), matching.gaussian_similarity(F.col("precursor_mz"), F.col("ref_mz"), 0.1), 0.3, 2)
    every = matching.top_hits(scored if first else scored.withColumn("is_matched", F.lit(True)), keep)
    expected = {(r["query_id"], r["ref_id"]): (r["rank"], pytest.approx(r["total"]), pytest.approx(r["mass_score"]), r["matched"]) for r in every.collect()}
    monkeypatch.setattr(matching, "scaled_matches", None)
    got = {(r["query_id"], r["ref_id"]): (r["rank"], r["total"], r["mass_score"], r["matched"]) for r in matching.spectrum_hits(*sides, 0.1, 0.2, 0.3, 2, keep, first).collect()}
    assert got == expected and len(got) > 60


def sparse_and_dense(spark, n, spots, seed):
    """The same profiles in both forms; a flat one and one without a gap among them."""
    rng = random.Random(seed)
    rows = [(k, float(k % 3), sorted(rng.sample(range(n), 0 if k == 0 else n if k == 1 else rng.randint(1, 4)))) for k in range(spots)]
    rows = [(k, base, at, [base + rng.randint(1, 40) / 8 for _ in at]) for k, base, at in rows]
    dense = [(k, [dict(zip(at, x, strict=True)).get(j, base) for j in range(n)]) for k, base, at, x in rows]
    return spark.createDataFrame(rows, "spot_id long, base double, at array<int>, x array<double>"), spark.createDataFrame(dense, "spot_id long, x array<double>")


def test_sparse_clusters_equal_dense_ones(spark):
    one, two = (d.withColumnRenamed("spot_id", "id") for d in sparse_and_dense(spark, 12, 60, 2))
    got, expected = ({r["id"]: (r["cluster"], round(r["within"], 6)) for r in d.collect()} for d in (kmeans.clustered(one, 3, 4, runs=12), kmeans.clustered(two, 3, 4)))
    assert got == expected and len(set(got.values())) == 3


@pytest.mark.parametrize("orthogonal", [1, 2])
def test_s_plot_without_inner_products(spark, orthogonal):
    one, two = sparse_and_dense(spark, 12, 40, 3)
    labels = [k % 2 for k in range(11)] + [1]
    expected = {r["spot_id"]: (r["covariance"], r["correlation"]) for r in discriminant.s_plot(two, discriminant.fits(two, labels, "opls", orthogonal, 0)).collect()}
    got = {r["spot_id"]: (r["covariance"], r["correlation"]) for r in discriminant.s_plot_sparse(one, labels, orthogonal).collect()}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k], abs=1e-9) for k in got)

"""Small cases of frames, records, networks and streams that tables do not cover."""

from __future__ import annotations

import json

import numpy as np
import pytest

from ionframe.operators import network, scans, signal, statistics
from ionframe.sources import records
from ionframe.streaming import inbox

MSP = """NAME: Alpha
PRECURSORMZ: 195.0877
PRECURSORTYPE: [M+H]+
FORMULA: C8H10N4O2
RETENTIONTIME: 1.20
Num Peaks: 2
138.0662\t100
110.0713 35

name: Beta
PRECURSORMZ: none
Num Peaks: 3
50 1; 60 2
70.5:3


NAME: Gamma
Num Peaks: 0
"""


def test_smoothing_renormalises_at_the_ends(spark):
    trace = spark.createDataFrame([(1, float(k), float(k * k)) for k in range(4)], "file_id long, rt double, intensity double")
    got = [r["smooth"] for r in signal.smoothed(trace, (2.0, 1.0)).orderBy("rt").collect()]
    assert got == pytest.approx([1 / 3, 1.5, 4.5, (9 * 2 + 4) / 3])


def test_ladder_size_is_checked(spark):
    points = spark.createDataFrame([(1.0,)], "rt double")
    with pytest.raises(ValueError, match="rungs"):
        signal.kovats(points, spark.createDataFrame([(8, 1.0)], "carbon int, ladder_rt double"))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_msp_source(spark, tmp_path, end):
    (tmp_path / "library.msp").write_bytes(MSP.replace("\n", end).encode())
    rows = {r["name"]: r for r in records.read_msp(spark, str(tmp_path / "library.msp"), end).collect()}
    assert set(rows) == {"Alpha", "Beta", "Gamma"}
    assert (rows["Alpha"]["precursor_mz"], rows["Alpha"]["precursor_type"], rows["Alpha"]["retention_time"]) == (195.0877, "[M+H]+", 1.2)
    assert rows["Beta"]["precursor_mz"] is None
    assert [tuple(p) for p in rows["Beta"]["peaks"]] == [(50.0, 1.0), (60.0, 2.0), (70.5, 3.0)]
    assert rows["Gamma"]["peaks"] == []


@pytest.mark.parametrize("kind", ["msp", "mgf"])
def test_written_records_read_back(spark, tmp_path, kind):
    spectra = spark.createDataFrame([(f"S{k}", 100.5 + k, [(50.0 + j, 1.0 + j) for j in range(k + 1)]) for k in range(20)], "name string, precursor_mz double, peaks array<struct<mz:double,intensity:double>>")
    text, read = (records.msp_text, records.read_msp) if kind == "msp" else (records.mgf_text, records.read_mgf)
    text(spectra).write.text(str(tmp_path / "out"))
    got = read(spark, str(tmp_path / "out")).select("name", "precursor_mz", "peaks")
    assert sorted(got.collect()) == sorted(spectra.collect())
    assert records.summary(got).first()["n_peaks"] == 210


def test_components_match_a_decomposition(spark):
    x = np.random.default_rng(5).normal(size=(40, 6))
    rows = [(s, f, float(x[s, f])) for s in range(40) for f in range(6)]
    got = statistics.principal_components(statistics.sample_gram(spark.createDataFrame(rows, "spot_id long, file_id long, z double")), 2).collect()
    sizes = np.linalg.svd(x, compute_uv=False) ** 2
    for k in (1, 2):
        mine = [r for r in got if r["component"] == k]
        assert sum(r["score"] ** 2 for r in mine) == pytest.approx(sizes[k - 1])
        assert mine[0]["explained"] == pytest.approx(sizes[k - 1] / sizes.sum())


def test_components_of_many_runs(spark):
    """More runs than the Gram matrix could once have on the driver."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(12, 2300)) * np.arange(1, 13)[:, None]
    rows = [(s, f, float(x[s, f])) for s in range(12) for f in range(2300)]
    got = statistics.run_components(spark.createDataFrame(rows, "spot_id long, file_id long, z double"), 3).collect()
    _, sizes, vectors = np.linalg.svd(x, full_matrices=False)
    assert len(got) == 3 * 2300
    for k in range(3):
        mine = np.array([r["score"] for r in sorted((r for r in got if r["component"] == k + 1), key=lambda r: r["file_id"])])
        assert mine == pytest.approx(vectors[k] * np.sign(vectors[k][np.abs(vectors[k]).argmax()]) * sizes[k], abs=1e-4)
        assert got[0]["explained"] == pytest.approx(sizes[0] ** 2 / (sizes**2).sum()) or got[0]["component"] != 1


def test_inbox_answers_and_reports_failures(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, command in enumerate(("count", "unknown")):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"id": f"r{k}", "command": command, "args": {"n": "3"}}))
    query = inbox.serve(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), {"count": lambda args: spark.range(int(args["n"]))})
    assert query.awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out" / "r0")).count() == 3
    failed = spark.read.option("recursiveFileLookup", True).json(str(tmp_path / "out" / "failed")).collect()
    assert [(r["id"], r["command"]) for r in failed] == [("r1", "unknown")]


def test_running_state_over_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"spot_id": 1, "ts": k, "tag": f"t{k}"}))
    stream = spark.readStream.schema("spot_id long, ts long, tag string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = inbox.running_state(stream, "spot_id", "ts", "tag").writeStream.outputMode("complete").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert [tuple(r) for r in spark.table("states").collect()] == [(1, "t2", 3)]


def test_empty_scans_are_points_of_zero(spark):
    """A survey scan without a matching peak ends a peak inside it and enters the noise."""
    scans_ = [(k, 1, 1, float(k), 50.0, y) for k, y in enumerate((2.0, 10.0, 100.0, 40.0))]
    scans_ += [(4, 1, 1, 4.0, 90.0, 7.0), (5, 1, 1, 5.0, 50.0, 60.0), (6, 1, 1, 6.0, 90.0, 7.0), (7, 1, 2, 7.0, 50.0, 9.0)]
    frame = spark.createDataFrame(scans_, "scan_id long, file_id long, ms_level long, rt double, mz double, intensity double")
    trace = scans.xic(frame, 50.0, 0.5)
    assert [(r["rt"], r["intensity"]) for r in trace.orderBy("rt").collect()] == [(0.0, 2.0), (1.0, 10.0), (2.0, 100.0), (3.0, 40.0), (4.0, 0.0), (5.0, 60.0), (6.0, 0.0)]
    got = signal.peak_summary(trace).first()
    assert (got["rt_left"], got["rt_right"], got["n_points"], got["area"]) == (0.0, 4.0, 5, 6 + 55 + 70 + 20)
    # steps 8, 90, 60, 40, 60, 60: centre 60, deviations 52, 30, 0, 20, 0, 0
    assert got["noise"] == pytest.approx(10 * 1.4826 / np.sqrt(2))
    targets = spark.createDataFrame([(1, 50.0), (2, 10.0)], "target_id long, target_mz double")
    assert [tuple(r) for r in scans.batch_xic(frame, targets, 0.5).collect()] == [(1, 1, 7, 5, 212.0, 100.0)]
    named = frame.selectExpr("file_id", "rt", "ms_level + 1 as ms_level", "mz as parent_mz", "intensity as product_mz", "intensity")
    assert sorted(tuple(r) for r in scans.product_ions(named, (49.0, 51.0), (50.0, 200.0)).collect()) == [(1, float(t), y) for t, y in ((0, 0.0), (1, 0.0), (2, 100.0), (3, 0.0), (5, 60.0), (7, 0.0))]

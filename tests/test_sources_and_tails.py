"""Tail probabilities against numerical integration and sums; mzML against its own text."""

import base64
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionframe.functions import distributions as d
from ionframe.sources import mzml


def _integral(f, a, b, n=200_001):
    x = np.linspace(a, b, n)
    y = f(x)
    return float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())


@pytest.mark.parametrize(("a", "b", "x"), [(2.0, 3.0, 0.3), (5.5, 1.5, 0.9), (40.0, 60.0, 0.45), (1.0, 1.0, 0.7)])
def test_incomplete_beta(a, b, x):
    whole = math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
    assert d.incomplete_beta(a, b, x) == pytest.approx(_integral(lambda t: t ** (a - 1) * (1 - t) ** (b - 1), 0, x) / whole, abs=1e-7)


@pytest.mark.parametrize(("a", "x"), [(1.0, 0.5), (2.5, 9.0), (30.0, 25.0)])
def test_upper_gamma(a, x):
    whole = math.gamma(a)
    assert d.upper_gamma(a, x) == pytest.approx(1 - _integral(lambda t: t ** (a - 1) * np.exp(-t), 0, x) / whole, abs=1e-7)


def test_tails_as_columns(spark):
    rows = [(2.0, 10.0), (0.0, 5.0), (-2.0, 10.0), (1.0, 0.0), (None, 3.0), (float("nan"), 3.0)]
    got = [r["p"] for r in spark.createDataFrame(rows, "t double, df double").select(d.student_p(F.col("t"), F.col("df")).alias("p")).collect()]
    assert got[0] == got[2] == pytest.approx(0.0733880, abs=1e-6) and got[1] == 1.0 and got[3:] == [None, None, None]
    one = spark.createDataFrame([(3, 5, 4, 10, 4.0, 1.959964)], "x int, n int, m int, t int, c double, z double").select(
        d.enrichment_p(F.col("x"), F.col("n"), F.col("m"), F.col("t")).alias("e"), d.chi_square_p(F.col("c"), F.lit(2)).alias("c"),
        d.normal_p(F.col("z")).alias("z"), d.fisher_p(F.col("c"), F.lit(1), F.lit(10)).alias("f"), d.student_p(F.lit(2.0), F.lit(10)).alias("s")).first()
    assert one["e"] == pytest.approx((math.comb(4, 3) * math.comb(6, 2) + math.comb(4, 4) * math.comb(6, 1)) / math.comb(10, 5))
    assert one["c"] == pytest.approx(math.exp(-2)) and one["z"] == pytest.approx(0.05, abs=1e-6)
    assert one["f"] == pytest.approx(one["s"])  # F(1, n) is t(n) squared


def test_decoding_of_arrays():
    x = np.array([1.5, -2.25, 1e6])
    for name, kind in mzml.NUMBERS.items():
        raw = x.astype(kind).tobytes()
        want = x.astype(kind).astype(float).tolist()
        assert mzml.decode(raw, name, False).tolist() == want
        assert mzml.decode(zlib.compress(raw), name, True).tolist() == want
        assert mzml.decode(zlib.compress(raw)[2:-4], name, True).tolist() == want  # no header
    assert mzml.decode(x.astype("<f4").tobytes() + b"x", "other", False).tolist() == x.tolist()
    assert mzml.decode(None, None, True).tolist() == []


def test_mzml_round_trip(spark, tmp_path):
    p = "struct<mz:double,target:double,lower:double,upper:double>"
    rows = [(k, f"scan={k} <&\">", 1 + k % 2, "+" if k % 3 else "-", k / 10, (100.0 + k if k % 2 else 0.0, None, None, None), [(50.0 + j, j + 0.5) for j in range(k)]) for k in range(9)]
    runs = spark.createDataFrame(rows, f"scan_idx long, id string, ms_level int, polarity string, rt double, precursor {p}, peaks array<struct<mz:double,intensity:double>>")
    body = "\n".join(r["value"] for r in mzml.spectra_text(runs).collect())
    (tmp_path / "run.mzML").write_text(f'<?xml version="1.0"?><mzML><run><spectrumList count="9">{body}</spectrumList></run></mzML>')
    back = mzml.read_mzml(spark, str(tmp_path / "run.mzML"))
    assert sorted(tuple(r) for r in back.select(*runs.columns).collect()) == sorted(tuple(r) for r in runs.collect())
    assert mzml.exploded(back).count() == sum(range(9))
    assert [r["scan_idx"] for r in mzml.in_window(back, 103.0, 0.1).collect()] == [3]


def test_mzml_seconds_floats_and_windows(spark, tmp_path):
    term, blob = mzml.TERM, lambda v, kind: base64.b64encode(np.asarray(v, kind).tobytes()).decode()
    param = lambda t, v="", u="": f'<cvParam accession="{term[t]}" name="{t}" value="{v}" unitName="{u}"/>'
    text = f'''<mzML><spectrumList><spectrum index="0" id="a" defaultArrayLength="2">{param("ms level", 0)}
        <scanList><scan>{param("start time", 90, "second")}</scan></scanList>
        <binaryDataArrayList><binaryDataArray>{param("float32")}{param("mz array")}<binary>{blob([100.5, 200.5], "<f4")}</binary></binaryDataArray>
        <binaryDataArray>{param("int32")}{param("intensity array")}<binary>{blob([7, 8], "<i4")}</binary></binaryDataArray></binaryDataArrayList></spectrum>
        <spectrum index="1" id="b" defaultArrayLength="0">{param("ms level", 2)}<precursorList><precursor><isolationWindow>{param("target", 500)}{param("lower", 10)}{param("upper", 5)}</isolationWindow></precursor></precursorList></spectrum>
        </spectrumList></mzML>'''
    (tmp_path / "run.mzML").write_text(text)
    back = mzml.read_mzml(spark, str(tmp_path / "run.mzML"))
    first, second = back.orderBy("scan_idx").collect()
    assert (first["ms_level"], first["rt"], [tuple(q) for q in first["peaks"]]) == (1, 1.5, [(100.5, 7.0), (200.5, 8.0)])
    assert (second["precursor"]["mz"], second["rt"], second["peaks"]) == (500.0, None, [])
    assert [mzml.in_window(back, mz, 0.0).count() for mz in (490.0, 505.0, 489.0, 506.0)] == [1, 1, 0, 0]

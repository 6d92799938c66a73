"""Isotope patterns, formula candidates and packed arrays against loops and literals."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionframe.functions import isotopes
from ionframe.functions.chemistry import MASS
from ionframe.operators import formulas
from ionframe.sources import mzml, numpress


def merged(peaks, tol):
    out = []
    for m, a in sorted(peaks):
        if out and m - out[-1][0] <= tol:
            total = out[-1][1] + a
            out[-1] = ((out[-1][0] * out[-1][1] + m * a) / total, total)
        else:
            out.append((m, a))
    return out


def pattern(counts, least=0.001, most=12, tol=0.01):
    convolved = lambda a, b: merged([(m + n, x * y) for m, x in a for n, y in b if x * y >= least * 1e-3], tol / 4)
    whole = [(0.0, 1.0)]
    for element, own in isotopes.ISOTOPES.items():
        n, total = counts.get(element, 0), sum(s for _, s in own)
        if n and len(own) == 1:
            whole = [(m + own[0][0] * n, a) for m, a in whole]
        elif n:
            square, done = [(m, s / total) for m, s in own], [(0.0, 1.0)]
            while n:
                if n & 1:
                    done = convolved(done, square)
                n >>= 1
                if n:
                    square = convolved(square, square)
            whole = convolved(whole, done)
    peaks = merged(whole, tol)
    top = max(a for _, a in peaks)
    return [(m, a / top) for m, a in peaks if a / top >= least][:most]


@pytest.mark.parametrize("counts", [{"C": 6, "H": 12, "O": 6}, {"C": 60, "H": 100, "N": 16, "O": 20, "S": 4}, {"C": 2, "H": 1, "Cl": 4, "Br": 3}, {"C": 600, "H": 1000}, {"I": 3, "Na": 1}])
def test_isotope_patterns_equal_the_loop(spark, counts):
    text = "".join(f"{e}{n}" for e, n in counts.items())
    got = spark.createDataFrame([(text,)], "f string").select(isotopes.isotope_pattern(F.col("f")).alias("p")).first()["p"]
    expected = pattern(counts)
    assert [p["mass"] for p in got] == pytest.approx([m for m, _ in expected]) and [p["share"] for p in got] == pytest.approx([a for _, a in expected])


def test_isotopes_by_hand(spark):
    """Glucose: M+1 is six carbons' share and little else; two bromines are 1 : 2 : 1."""
    rows = {r["f"]: r["p"] for r in spark.createDataFrame([("C6H12O6",), ("CBr2",), (None,)], "f string").select("f", isotopes.isotope_pattern(F.col("f")).alias("p")).collect()}
    assert rows["C6H12O6"][0]["mass"] == pytest.approx(180.063388, abs=1e-5) and rows["C6H12O6"][1]["share"] == pytest.approx(6 * 0.0107 / 0.9893 + 12 * 0.000115 + 6 * 0.00038, rel=0.01)
    assert [round(p["share"], 2) for p in rows["CBr2"] if p["share"] > 0.1] == [0.51, 1.0, 0.49] and rows[None] is None


def brute(mass, tol, b):
    out = set()
    for c in range(1, int(mass / 12) + 1):
        for n in range(min(b.n, int(c * b.ratio_n)) + 1):
            for o in range(min(b.o, int(c * b.ratio_o)) + 1):
                for p in range(min(b.p, int(c * b.ratio_p)) + 1):
                    for s in range(min(b.s, int(c * b.ratio_s)) + 1):
                        rest = mass - (c * MASS["C"] + n * MASS["N"] + o * MASS["O"] + p * MASS["P"] + s * MASS["S"])
                        for h in {int(rest / MASS["H"]) + d for d in (-1, 0, 1)}:
                            twice = 2 * c + 2 + n + p - h
                            if 0 <= h <= c * b.ratio_h and abs(rest - h * MASS["H"]) <= tol and twice >= 0 and twice % 2 == 0:
                                out.add((c, h, n, o, p, s))
    return out


def test_candidates_equal_all_compositions(spark):
    """Glucose, a phosphate, a mass near 500 and one without a formula."""
    masses = {1: 180.063388, 2: 259.022, 3: 499.2954, 4: 12.5, 5: 26.01565}
    got = formulas.candidates(spark.createDataFrame(list(masses.items()), "target_id long, mass double"), 0.002).collect()
    for k, mass in masses.items():
        assert {tuple(r[e] for e in "chnops") for r in got if r["target_id"] == k} == brute(mass, 0.002, formulas.Bounds())
    glucose = next(r for r in got if r["formula"] == "C6H12O6")
    assert glucose["rdbe"] == 1 and abs(glucose["error"]) < 1e-5 and glucose["score"] == pytest.approx(1.0, abs=1e-4)
    assert {r["formula"] for r in got if r["target_id"] == 5} == {"C2H2"}
    assert formulas.candidates(spark.createDataFrame([], "target_id long, mass double"), 0.002).count() == 0


def test_packed_numbers_come_back():
    data = [100.0001, 100.0023, 100.0050, 250.12345, 250.12346, 999.99999, 1000.0]
    assert numpress.decode_linear(numpress.encode_linear(data, 100000.0)) == pytest.approx(data, abs=1e-5)
    for short in ([], [42.5], [42.5, 43.25]):
        assert numpress.decode_linear(numpress.encode_linear(short, 1000.0)).tolist() == short
    whole = [0.0, 1.0, 15.0, 16.0, 255.0, 4096.0, 1e6, 123456789.0]
    assert numpress.decode_pic(numpress.encode_pic(whole)).tolist() == whole
    for tail in ([0.0], [0.0, 0.0], [5.0, 0.0], [5.0, 0.0, 0.0], []):
        assert numpress.decode_pic(numpress.encode_pic(tail)).tolist() == tail
    logs = [1.0, 10.0, 100.0, 1000.0, 12345.678, 5e6]
    assert numpress.decode_slof(numpress.encode_slof(logs, 65535 / np.log(5e6 + 1))) == pytest.approx(logs, rel=1e-3)
    rng = np.random.default_rng(1)
    for _ in range(20):
        y = np.sort(rng.uniform(50, 2000, rng.integers(0, 60)))
        assert numpress.decode_linear(numpress.encode_linear(y, 10000.0)) == pytest.approx(y, abs=1e-4)


def test_half_bytes_by_hand():
    """Heads: leading zeros up to 8, leading fifteens above; digits lowest first."""
    assert numpress._whole_numbers(bytes([0x71, 0x88])).tolist() == [1, 0]
    assert numpress._whole_numbers(bytes([0xFF, 0x63, 0x18])).tolist() == [-1, 0x13]
    with pytest.raises(ValueError, match="filling"):
        numpress._whole_numbers(bytes([0x75]) + bytes([0x85]))
    with pytest.raises(ValueError, match="fixed point"):
        numpress.decode_slof(b"abc")


@pytest.mark.parametrize("packed", [False, True])
def test_packed_arrays_in_a_run(spark, tmp_path, packed):
    mz, y = [100.1, 250.25, 945.995], [10.0, 500.0, 20.0]
    raw = [numpress.encode_linear(mz, 100000.0), numpress.encode_pic(y)]
    texts = [base64.b64encode(zlib.compress(r) if packed else r).decode() for r in raw]
    terms = [("MS:1000514", "MS:1002312"), ("MS:1000515", "MS:1002313")]
    arrays = "".join(f'<binaryDataArray>{"".join(f"<cvParam accession=\"{t}\" name=\"x\" value=\"\"/>" for t in (*own, *(("MS:1000574",) if packed else ())))}<binary>{text}</binary></binaryDataArray>' for own, text in zip(terms, texts, strict=True))
    (tmp_path / "run.mzML").write_text(f'<mzML><run><spectrumList><spectrum index="0" id="scan=1" defaultArrayLength="3"><cvParam accession="MS:1000511" name="ms level" value="1"/><binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum></spectrumList></run></mzML>')
    got = mzml.read_mzml(spark, str(tmp_path / "run.mzML")).first()["peaks"]
    assert [p["mz"] for p in got] == pytest.approx(mz, abs=1e-5) and [p["intensity"] for p in got] == y

"""mzML runs: scans from the XML reader, binary arrays decoded in Arrow batches.

The reader splits a file at its spectrum elements, so one large run is read by many
tasks. Only base64, inflation and the number format need Python; everything else is
columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ionframe.sources.numpress import DECODERS

_PARAM = "array<struct<_accession:string,_name:string,_value:string,_unitName:string>>"
_ARRAY = f"struct<cvParam:{_PARAM},binary:string>"
_ION = f"struct<cvParam:{_PARAM}>"
SPECTRUM = (
    f"_index long, _id string, _defaultArrayLength long, cvParam {_PARAM}, "
    f"scanList struct<scan:array<struct<cvParam:{_PARAM}>>>, "
    f"precursorList struct<precursor:array<struct<isolationWindow:{_ION},selectedIonList:struct<selectedIon:array<{_ION}>>,activation:{_ION}>>>, "
    f"binaryDataArrayList struct<binaryDataArray:array<{_ARRAY}>>")

#: Terms of the public controlled vocabulary (fixed values).
TERM = {
    "ms level": "MS:1000511", "negative": "MS:1000129", "positive": "MS:1000130", "total current": "MS:1000285",
    "start time": "MS:1000016", "selected ion": "MS:1000744", "target": "MS:1000827", "lower": "MS:1000828", "upper": "MS:1000829",
    "collision energy": "MS:1000045", "mz array": "MS:1000514", "intensity array": "MS:1000515", "zlib": "MS:1000574",
    "linear": "MS:1002312", "pic": "MS:1002313", "slof": "MS:1002314",
    "float32": "MS:1000521", "float64": "MS:1000523", "int32": "MS:1000519", "int64": "MS:1000522",
}
NUMBERS = {"float32": "<f4", "float64": "<f8", "int32": "<i4", "int64": "<i8"}


def inflated(data: bytes) -> bytes:
    """With a zlib header or without one."""
    try:
        return zlib.decompress(data)
    except zlib.error:
        return zlib.decompress(data, -15)


def decode(data: bytes | None, precision: str | None, packed: bool) -> np.ndarray:
    """Numbers of one array; an unknown precision is read as 32-bit float, and bytes
    that do not fill a last number are left out. A codec's name may stand for the precision."""
    raw = inflated(data) if packed and data else data or b""
    if precision in DECODERS:
        return DECODERS[precision](raw) if raw else np.zeros(0)
    kind = np.dtype(NUMBERS.get(precision or "", "<f4"))
    return np.frombuffer(raw[:len(raw) // kind.itemsize * kind.itemsize], kind).astype(float)


@F.pandas_udf(ArrayType(DoubleType()))
def _decoded(data: pd.Series, precision: pd.Series, packed: pd.Series) -> pd.Series:
    return pd.Series([decode(d, p, bool(z)) for d, p, z in zip(data, precision, packed, strict=True)])


def decoded(text: Column, precision: Column, packed: Column) -> Column:
    """Numbers of a base64 text; ``packed``: compressed."""
    return _decoded(F.unbase64(F.regexp_replace(text, r"\s", "")), precision, packed)


def _has(params: Column, term: str) -> Column:
    return F.coalesce(F.exists(params, lambda p: p["_accession"] == TERM[term]), F.lit(False))


def _value(params: Column, term: str) -> Column:
    return F.try_element_at(F.filter(params, lambda p: p["_accession"] == TERM[term]), F.lit(1))["_value"].try_cast("double")


def _array(arrays: Column, term: str) -> Column:
    a = F.try_element_at(F.filter(arrays, lambda x: _has(x["cvParam"], term)), F.lit(1))
    precision = F.coalesce(*[F.when(_has(a["cvParam"], n), n) for n in (*DECODERS, *NUMBERS)], F.lit("float32"))
    return F.coalesce(decoded(a["binary"], precision, _has(a["cvParam"], "zlib")), F.array().cast("array<double>"))


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """``file, scan_idx, id, ms_level, polarity, rt (minutes), ce, tic, precursor, peaks``.

    MS level 0 or none is 1; the parent is the selected ion, else the isolation target,
    else 0; scans without arrays have no peaks.
    """
    raw = spark.read.format("xml").option("rowTag", "spectrum").schema(SPECTRUM).load(path).select("*", "_metadata.file_path")
    scan = F.try_element_at(F.col("scanList.scan"), F.lit(1))["cvParam"]
    start = F.try_element_at(F.filter(scan, lambda p: p["_accession"] == TERM["start time"]), F.lit(1))
    time = start["_value"].try_cast("double")
    parent = F.try_element_at(F.col("precursorList.precursor"), F.lit(1))
    ion, window = F.try_element_at(parent["selectedIonList"]["selectedIon"], F.lit(1))["cvParam"], parent["isolationWindow"]["cvParam"]
    params, arrays = F.col("cvParam"), F.col("binaryDataArrayList.binaryDataArray")
    level = F.coalesce(_value(params, "ms level"), F.lit(0.0)).cast("int")
    return raw.select(
        F.col("file_path").alias("file"), F.col("_index").alias("scan_idx"), F.col("_id").alias("id"),
        F.when(level == 0, 1).otherwise(level).alias("ms_level"),
        F.when(_has(params, "negative"), "-").when(_has(params, "positive"), "+").alias("polarity"),
        F.when(start["_unitName"] == "second", time / 60).otherwise(time).alias("rt"),
        _value(parent["activation"]["cvParam"], "collision energy").alias("ce"), _value(params, "total current").alias("tic"),
        F.struct(
            F.coalesce(_value(ion, "selected ion"), _value(window, "target"), F.lit(0.0)).alias("mz"), _value(window, "target").alias("target"),
            _value(window, "lower").alias("lower"), _value(window, "upper").alias("upper")).alias("precursor"),
        _array(arrays, "mz array").alias("mzs"), _array(arrays, "intensity array").alias("intensities"),
    ).select("*", F.arrays_zip(F.col("mzs").alias("mz"), F.col("intensities").alias("intensity")).alias("peaks")).drop("mzs", "intensities")


def exploded(runs: DataFrame) -> DataFrame:
    """One peak a row: the input of the scan operators."""
    peaks = runs.select("file", F.col("scan_idx").alias("scan_id"), "ms_level", "rt", F.explode("peaks").alias("p"))
    return peaks.select(F.col("file").alias("file_id"), "scan_id", "ms_level", "rt", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"))


def in_window(runs: DataFrame, mz: float, tol: float) -> DataFrame:
    """MSn scans whose isolation window (where it has offsets), else whose parent, holds mz +- tol."""
    p = F.col("precursor")
    wide = F.coalesce(p["lower"], F.lit(0.0)) + F.coalesce(p["upper"], F.lit(0.0)) > 0
    inside = (F.lit(mz) >= p["target"] - F.coalesce(p["lower"], F.lit(0.0)) - tol) & (F.lit(mz) <= p["target"] + F.coalesce(p["upper"], F.lit(0.0)) + tol)
    return runs.where((F.col("ms_level") > 1) & F.when(wide, inside).otherwise(F.abs(p["mz"] - mz) <= tol))


def spectra_text(rows: DataFrame) -> DataFrame:
    """One spectrum element a row (``value``), 64-bit and compressed, from read_mzml's
    columns; the parent of every MSn scan is kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"value": [_element(r) for r in b.to_dict("records")]})

    return rows.select("scan_idx", "id", "ms_level", "polarity", "rt", F.col("precursor.mz").alias("parent"), F.col("peaks.mz").alias("mz"), F.col("peaks.intensity").alias("intensity")).mapInPandas(run, "value string")


def file_text(rows: DataFrame) -> DataFrame:
    """Lines of whole files, one a partition (write them with ``write.text``): a run whose
    spectra are the partition's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ['<?xml version="1.0" encoding="utf-8"?>', '<mzML xmlns="http://psi.hupo.org/ms/mzml" version="1.1.0"><run id="run"><spectrumList>']})
        yield from batches
        yield pd.DataFrame({"value": ["</spectrumList></run></mzML>"]})

    return spectra_text(rows).mapInPandas(run, "value string")


def _element(r: dict) -> str:
    from base64 import b64encode
    from xml.sax.saxutils import quoteattr

    param = lambda term, value="", unit="": f'<cvParam accession="{TERM[term]}" name="{term}" value="{value}"' + (f' unitName="{unit}"/>' if unit else "/>")
    array = lambda term, values: f'<binaryDataArray>{param("float64")}{param("zlib")}{param(term)}<binary>{b64encode(zlib.compress(np.asarray(values, "<f8").tobytes())).decode()}</binary></binaryDataArray>'
    sign = {"+": param("positive"), "-": param("negative")}.get(r["polarity"], "")
    parent = f'<precursorList><precursor><selectedIonList><selectedIon>{param("selected ion", repr(float(r["parent"])))}</selectedIon></selectedIonList></precursor></precursorList>' if r["ms_level"] > 1 and r["parent"] else ""
    return (f'<spectrum index="{r["scan_idx"]}" id={quoteattr(r["id"] or "")} defaultArrayLength="{len(r["mz"])}">{param("ms level", r["ms_level"])}{sign}'
            f'<scanList><scan>{param("start time", repr(float(r["rt"])), "minute")}</scan></scanList>{parent}'
            f'<binaryDataArrayList>{array("mz array", r["mz"])}{array("intensity array", r["intensity"])}</binaryDataArrayList></spectrum>')

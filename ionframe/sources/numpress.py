"""The three numeric codecs of packed mzML arrays, as functions of bytes and as columns.

Linear: a fixed point, two whole numbers, then what each next one differs from the straight
line through the two before it. Pic: whole numbers. Slof: logarithms in 16 bits. Differences
and pic numbers are runs of half bytes: a head that says how many leading half bytes are 0
(up to 8) or 15 (above 8), then the others, the lowest first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType

#: Half bytes that fill the last byte: what is written, and what is read as such.
FILL, FILLS = 8, (0, 8)


def _whole_numbers(data: bytes) -> np.ndarray:
    """Numbers of a run of half bytes."""
    raw = np.frombuffer(data, np.uint8)
    half = np.stack((raw >> 4, raw & 15), axis=1).ravel().astype(np.int64)
    skipped = np.where(half > 8, half - 8, half)
    after = (np.arange(len(half)) + 9 - skipped).tolist()
    at, starts = 0, []
    while at < len(half):
        if at == len(half) - 1:
            if half[at] not in FILLS:
                raise ValueError("the last half byte is no filling")
            break
        starts.append(at)
        at = after[at]
    if at > len(half):
        raise ValueError("the last number is cut off")
    starts = np.array(starts, int)
    kept, padded = 8 - skipped[starts], np.concatenate((half, np.zeros(9, np.int64)))
    value = np.zeros(len(starts), np.int64)
    for k in range(8):
        value += np.where(k < kept, padded[starts + 1 + k] << (4 * k), 0)
    ones = (half[starts] > 8) * (0xFFFFFFFF - ((1 << (4 * kept)) - 1))
    return (value + ones).astype(np.uint32).view(np.int32).astype(np.int64)


def _half_bytes(values: np.ndarray) -> bytes:
    out: list[int] = []
    for v in values.tolist():
        digits = [(v & 0xFFFFFFFF) >> (4 * k) & 15 for k in range(8)]
        lead = 15 if v < 0 else 0
        kept = 8
        while kept > (1 if lead else 0) and digits[kept - 1] == lead:
            kept -= 1
        out += [8 - kept + (8 if lead and kept < 8 else 0), *digits[:kept]]
    if out and len(out) % 2 == 0 and len(values) and values[-1] == 0:
        out[-1:] = [7, 0]  # a lone 8 in the last place would be read as filling
    if len(out) % 2:
        out.append(FILL)
    pairs = np.array(out, np.uint8).reshape(-1, 2)
    return (pairs[:, 0] << 4 | pairs[:, 1]).astype(np.uint8).tobytes()


def _fixed_point(data: bytes) -> float:
    if len(data) < 8:
        raise ValueError("no fixed point")
    return float(np.frombuffer(data[:8], ">f8")[0])


def decode_linear(data: bytes) -> np.ndarray:
    point = _fixed_point(data)
    if len(data) not in (8, 12) and len(data) < 16:
        raise ValueError("a first number is cut off")
    first = np.frombuffer(data[8:16], "<i4").astype(np.int64)
    if len(data) <= 16:
        return first / point
    step = np.cumsum(np.concatenate(([first[1] - first[0]], _whole_numbers(data[16:]))))
    return np.concatenate((first[:1], first[0] + np.cumsum(step))) / point


def encode_linear(values: np.ndarray, point: float) -> bytes:
    whole = np.floor(np.asarray(values, float) * point + 0.5).astype(np.int64)
    out = np.array([point], ">f8").tobytes() + whole[:2].astype("<i4").tobytes()
    return out + _half_bytes(np.diff(whole, 2)) if len(whole) > 2 else out


def decode_pic(data: bytes) -> np.ndarray:
    return _whole_numbers(data).astype(float)


def encode_pic(values: np.ndarray) -> bytes:
    return _half_bytes(np.floor(np.asarray(values, float) + 0.5).astype(np.int64))


def decode_slof(data: bytes) -> np.ndarray:
    point, n = _fixed_point(data), (len(data) - 8) // 2
    return np.exp(np.frombuffer(data[8 : 8 + 2 * n], "<u2") / point) - 1


def encode_slof(values: np.ndarray, point: float) -> bytes:
    logs = np.floor(np.log1p(np.asarray(values, float)) * point + 0.5)
    return np.array([point], ">f8").tobytes() + logs.astype("<u2").tobytes()


DECODERS = {"linear": decode_linear, "pic": decode_pic, "slof": decode_slof}


@F.pandas_udf(BinaryType())
def _packed(values: pd.Series, kind: pd.Series) -> pd.Series:
    def one(v: np.ndarray, k: str) -> bytes:
        v = np.asarray(v, float)
        if k == "pic":
            return encode_pic(v)
        top = max(float(np.abs(v).max()) if len(v) else 0.0, 1.0)
        # as fine as 31 and 16 bits allow; differences of neighbours need a bit more
        return encode_linear(v, np.floor(0x1FFFFFFF / top)) if k == "linear" else encode_slof(v, np.floor(0xFFFF / np.log1p(top)))

    return pd.Series([None if v is None else one(v, k) for v, k in zip(values, kind, strict=True)])


def packed(values: Column, kind: str) -> Column:
    """Bytes of an array of numbers (``linear``, ``pic`` or ``slof``); null stays null."""
    return _packed(values, F.lit(kind))


@F.pandas_udf(ArrayType(DoubleType()))
def _unpacked(data: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else DECODERS[k](d) for d, k in zip(data, kind, strict=True)])


def unpacked(data: Column, kind: str) -> Column:
    """Numbers of packed bytes; null stays null."""
    return _unpacked(data, F.lit(kind))

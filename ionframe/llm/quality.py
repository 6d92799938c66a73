"""Quality classifier by compression with zstandard dictionaries.

Two dictionaries are trained, one on good and one on bad labelled text. A text
is compressed in blocks under both; the size difference, normalised by bytes
and by compressed size, goes through a logistic calibration fitted on labelled
texts that no dictionary has seen, weighted to the classes' true shares.

Only the model is fitted on a bounded sample: ``SAMPLE`` documents a class,
chosen by a hash of the id among labelled documents outside the held-out fold
(crc32 of the id as text, mod 5, is 0) of at most ``LONGEST`` characters. All
texts are scored whole. Neither labels nor lang, source or doc_id enter a score.

Edge cases: null text is empty; an empty text gets the calibrated score of no
difference; null labels and ids with conflicting labels are not learnt from; with
fewer than ``LEAST`` usable documents in a class every score is the share of good
labels (1 without labels); long texts are read whole, block by block; repeated rows
repeat; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionframe.llm.shared import release, rows_made, small_batches, text_or_empty

SAMPLE = 2500
LONGEST = 20_000
LEAST = 20
BLOCK = 1024
DICTIONARY = 256 * 1024
LEVEL = 3
THRESHOLD = 0.3
HELD_OUT = 5


@dataclass(frozen=True)
class Model:
    """Dictionaries (bad, good) and calibration weights; without dictionaries a constant."""

    dictionaries: tuple[bytes, bytes] | None
    weights: tuple[float, ...]


class Sizer:
    """Compressed sizes of whole texts under both dictionaries."""

    def __init__(self, dictionaries: tuple[bytes, bytes]):
        self._with = []
        for raw in dictionaries:
            told = zstandard.ZstdCompressionDict(raw)
            told.precompute_compress(level=LEVEL)
            made = zstandard.ZstdCompressor(level=LEVEL, dict_data=told, write_content_size=False, write_checksum=False, write_dict_id=False)
            self._with.append((made.compress, len(made.compress(b""))))

    def sizes(self, text: str) -> tuple[int, int, int]:
        """Bytes under the bad and the good dictionary (frames' own bytes left out) and in all."""
        data = text.encode()
        blocks = [data[k:k + BLOCK] for k in range(0, len(data), BLOCK)]
        bad, good = (sum(len(compress(b)) for b in blocks) - empty * len(blocks) for compress, empty in self._with)
        return bad, good, len(data)


def features(sizes: np.ndarray) -> np.ndarray:
    bad, good, n = sizes.astype(float).T
    return np.column_stack([np.ones(len(n)), (bad - good) / (n + 20), (bad - good) / (bad + good + 20), (bad + good) / (n + 20)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = sigmoid(x @ w)
        slope = x.T @ (weight * (y - p)) - ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits the model on the learning fold of ``labels``."""
    small_batches(docs.sparkSession)
    told = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold() != 0))
    told = told.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("top")).where("quality = top").drop("top")
    share = {r["quality"]: r["n"] for r in told.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    rate = share.get(1, 0) / sum(share.values()) if share else 1.0
    constant = Model(None, (rate,))
    if min(share.get(0, 0), share.get(1, 0)) < LEAST:
        return constant
    # at most two times ``sample`` ids: a bound that does not follow the table
    order = F.xxhash64("doc_id", F.lit("quality"))
    chosen = None
    for q in (0, 1):
        part = told.where(F.col("quality") == q).orderBy(order, "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", text_or_empty().alias("text")).where(F.length("text") <= LONGEST).join(F.broadcast(chosen), "doc_id")
    rows = texts.dropDuplicates(["doc_id"]).withColumn("turn", order).toPandas().sort_values(["turn", "doc_id"])
    # text seen by a dictionary compresses too well to calibrate on
    learn, check = {}, []
    for q in (0, 1):
        own = rows[rows["quality"] == q]
        cut = len(own) * 6 // 10
        learn[q] = own["text"].iloc[:cut]
        check.append(own.iloc[cut:])
    check = pd.concat(check)
    if min(len(learn[0]), len(learn[1])) < LEAST // 2 or check["quality"].nunique() < 2:
        return constant
    try:
        dictionaries = tuple(_dictionary(learn[q]) for q in (0, 1))
    except zstandard.ZstdError:  # too little text to find anything in common
        return constant
    sizer = Sizer(dictionaries)
    x = features(np.array([sizer.sizes(t) for t in check["text"]]))
    y = check["quality"].to_numpy(float)
    per = {q: share[q] / max(1, (y == q).sum()) for q in (0, 1)}
    weight = np.where(y == 1, per[1], per[0])
    return Model(dictionaries, tuple(logistic(x, y, weight * len(y) / weight.sum()).tolist()))


def _dictionary(texts: pd.Series) -> bytes:
    blocks = [d[k:k + BLOCK] for d in (t.encode() for t in texts) for k in range(0, len(d), BLOCK)]
    blocks = [b for b in blocks if len(b) >= 8]
    size = max(1024, min(DICTIONARY, sum(map(len, blocks)) // 4))
    return zstandard.train_dictionary(size, blocks, level=LEVEL).as_bytes()


def scorer(model: Model) -> Callable[[list], np.ndarray]:
    """Scores of whole texts (None: empty) under a model."""
    sizer = Sizer(model.dictionaries) if model.dictionaries else None

    def run(texts: list) -> np.ndarray:
        if sizer is None:
            return np.full(len(texts), model.weights[0])
        sizes = np.array([sizer.sizes(t or "") for t in texts]).reshape(-1, 3)
        return sigmoid(features(sizes) @ np.array(model.weights))

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text."""

    def start() -> Callable:
        run = scorer(model)
        return lambda batch: (None, {"score": run(batch.column("text").to_pylist())})

    scored = rows_made(docs.select("doc_id", text_or_empty().alias("text")), ["doc_id"], {"score": "double"}, start)
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that the classifier rejects (all columns kept)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column("text").to_pylist()) >= THRESHOLD))
        release()

    return docs.mapInArrow(run, docs.schema)

"""Quality by compression: which of two zstandard dictionaries, of good or of bad text, makes a text smaller."""

from __future__ import annotations

import dataclasses
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.labelled import labelled_sample

#: Bytes that are compressed on their own, so that the dictionary and not the text before decides their size.
PIECE = 256
#: Bytes of a dictionary, and the level of compression.
DICTIONARY, LEVEL = 112_640, 3
#: Most labelled documents of each class that the model learns from, and most pieces of each class in a dictionary.
PER_CLASS, PIECES = 6000, 6000


@functools.lru_cache(maxsize=8)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor | None:
    if not dictionary:
        return None
    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def train_dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary; of few pieces, their bytes themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY:]


def size_difference(text: bytes, good: bytes, bad: bytes) -> float:
    """(bad size - good size) / (bad size + good size) over all pieces; 0 for an empty text or a missing dictionary."""
    a, b = _compressor(good), _compressor(bad)
    if not text or a is None or b is None:
        return 0.0
    with_good = with_bad = 0
    for i in range(0, len(text), PIECE):
        piece = text[i : i + PIECE]
        with_good += len(a.compress(piece))
        with_bad += len(b.compress(piece))
    return (with_bad - with_good) / (with_bad + with_good)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of P(y = 1), by Newton's method; with one class only, the smoothed rate of that class."""
    rate = (y.sum() + 1) / (len(y) + 2)
    if len(np.unique(y)) < 2:
        return 0.0, math.log(rate / (1 - rate))
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        slope = a.T @ (p - y) + ridge * w
        curve = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 20 / max(np.abs(step).max(), 1e-9))
    return float(w[0]), float(w[1])


@dataclasses.dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float

    def score(self, text: str | None) -> float:
        x = self.slope * size_difference((text or "").encode(), self.good, self.bad) + self.offset
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def fit_quality(
    docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", per_class: int = PER_CLASS
) -> QualityModel:
    """Dictionaries from one half of a bounded labelled sample, the calibration from the other half.

    per_class bounds the documents of each class. Of each class at most PIECES pieces come to the driver, drawn by a hash
    of document and place from all pieces of its whole texts, so that every place has the same chance; and of the other
    half one number for each document. The classes keep their true shares in calibration.
    """
    sample = labelled_sample(docs, labels, label, learn, (per_class, per_class)).withColumn(
        "half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    )
    shares = {r["label"]: r["n"] for r in labels.filter(learn).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).collect() if r["label"] in (0, 1)}
    teach = sample.filter("half = 0").select(F.col("label").cast("int"), F.xxhash64("doc_id", F.lit("piece")).alias("seed"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, seed, text in zip(*(batch.column(i) for i in range(3))):
                data = text.as_py().encode()
                starts = [i for i in range(0, len(data), PIECE) if len(data) - i >= 8]
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([kind.as_py()] * n, pa.int32()),
                        pa.array([seed.as_py()] * n, pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array([data[i : i + PIECE] for i in starts], pa.binary()),
                    ],
                    ["label", "seed", "at", "piece"],
                )

    found = teach.mapInArrow(cut, "label int, seed long, at long, piece binary")
    drawn = lambda c: found.filter(F.col("label") == c).orderBy(F.xxhash64("seed", "at"), "seed", "at").limit(PIECES)
    pieces = {c: [bytes(r.piece) for r in drawn(c).select("piece").collect()] for c in (0, 1)}
    good, bad = (train_dictionary(pieces[c]) for c in (1, 0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [size_difference(t.encode(), good, bad) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64())], ["label", "x"])

    rows = sample.filter("half = 1").select(F.col("label").cast("int"), "text").mapInArrow(measure, "label int, x double").collect()
    # A class of which the sample holds a part only counts with the weight of the whole.
    held = {c: sum(r.label == c for r in rows) for c in (0, 1)}
    repeat = {c: max(1, round(shares.get(c, 0) / max(sum(shares.values()), 1) * len(rows) / max(held[c], 1))) for c in (0, 1)}
    x, y = np.array([r.x for r in rows]), np.array([r.label for r in rows], float)
    many = np.array([repeat[int(c)] for c in y], int)
    slope, offset = fit_logistic(np.repeat(x, many), np.repeat(y, many))
    return QualityModel(good, bad, slope, offset)


def score_quality(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every document, 0 to 1, over its whole text; null and empty texts get the score of no evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], [key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("_pw_text")).mapInArrow(run, f"`{key}` {kind}, score double")

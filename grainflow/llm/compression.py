"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are trained on bounded samples of labelled text. A text is cut into short windows, and each is
compressed with both dictionaries; the difference of the total sizes, divided by their sum, says which
kind it resembles. A second sample, kept apart from the dictionaries' one, calibrates that difference, together with the
ratio of the smaller compressed size to the plain size, into a probability by logistic regression; class
weights restore the true share of good labels. Scoring is a map over rows: no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import DoubleType

from grainflow.llm.common import as_schema, by_size, crc_bucket, short_batches, table

#: Labelled rows of a class that are used at most, each with its whole text.
SAMPLE = 1500
DICTIONARY, WINDOW, LEVEL = 65536, 1024, 3
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


@lru_cache(maxsize=2)
def _compressors(good: bytes, bad: bytes):
    import zstandard

    out = []
    for raw in (good, bad):
        trained = zstandard.ZstdCompressionDict(raw)
        trained.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=trained, write_content_size=False, write_dict_id=False))
    return out


def features(good: bytes, bad: bytes, text: str | None) -> tuple[float, float, float]:
    """(normalised size difference, compression ratio, 1 if there is text)."""
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return 0.0, 0.0, 0.0
    a, b = _compressors(good, bad)
    x = y = 0
    for at in range(0, len(data), WINDOW):
        piece = data[at : at + WINDOW]
        x += len(a.compress(piece))
        y += len(b.compress(piece))
    return (y - x) / (x + y), min(x, y) / len(data), 1.0


def _design(f: np.ndarray) -> np.ndarray:
    d, r, some = f[:, 0] * 10, np.minimum(f[:, 1], 1.5), f[:, 2]
    return np.column_stack([np.ones(len(f)), d, r, r * r, d * r, 1 - some])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with a ridge; a few dozen steps, deterministic."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _dictionary(samples: list[str]) -> bytes:
    """A dictionary trained on the texts' windows, which are shorter and whose dictionary is smaller where there is
    little text; empty if there is too little for the trainer (some kilobytes)."""
    import zstandard

    texts = [t.encode("utf-8", "replace") for t in samples]
    total = sum(map(len, texts))
    window = min(WINDOW, max(16, total // 64))
    pieces = [t[i : i + window] for t in texts for i in range(0, len(t), window)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, total // 4)), pieces, k=64, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def fit(sample: list[tuple[int, str]], share: float) -> Model:
    """From (label, text) rows of both classes and the share of label 1 among all labels; every other row of a class teaches the dictionaries, the
    rest the calibration. Where a class has too little text for either, the score of every text is that share."""
    half: dict[int, list[str]] = {0: [], 1: []}
    rest: dict[int, list[str]] = {0: [], 1: []}
    for label, text in sample:
        (half if len(half[label]) < len(rest[label]) else rest)[label].append(text)
    good, bad = _dictionary(half[1]), _dictionary(half[0])
    if not rest[0] or not rest[1] or not good or not bad:
        base = min(max(share, 1e-3), 1 - 1e-3)
        return Model(b"", b"", (float(np.log(base / (1 - base))), 0.0, 0.0, 0.0, 0.0, 0.0))
    x = _design(np.array([features(good, bad, t) for k in (0, 1) for t in rest[k]]))
    y = np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    weight = np.where(y == 1, share / len(rest[1]), (1 - share) / len(rest[0])) * len(y)
    return Model(good, bad, tuple(_logistic(x, y, weight)))


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    f = np.array([features(model.good, model.bad, t) if model.good else (0.0, 0.0, 0.0) for t in texts]).reshape(-1, 3)
    return 1 / (1 + np.exp(-np.clip(_design(f) @ np.array(model.weights), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled rows of each class, those first in the order of a hash of the key.

    Rows with a null key, a label other than 0 and 1, or no document don't count; of documents that repeat a key, the one with the least
    text does. Class shares are over all labels.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias("label")).distinct()
    share = known.agg(F.avg(F.col("label").cast("double"))).first()[0]
    first = [r for v in (0, 1) for r in known.where(F.col("label") == v).orderBy(F.xxhash64(key), key).limit(sample).collect()]
    chosen = docs.sparkSession.createDataFrame(first, known.schema)  # at most 2 * sample rows
    rows = docs.where(F.col(text).isNotNull()).select(key, text).join(F.broadcast(chosen), key).groupBy("label", key).agg(F.min(text).alias("whole"))
    got = sorted(rows.collect(), key=lambda r: (r["label"], r[key]))  # at most 2 * sample texts
    return fit([(r["label"], r["whole"]) for r in got], 0.5 if share is None else share)


def _kernel(model, columns: list[str], text: str, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, text, 8_000_000):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(scores(model.value, part.column(text).to_pylist()))], schema=schema)

    return run


def score(docs: DataFrame, model: Model, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """(key, score, predicted) of every row, keys of any type; null and empty texts are scored as empty."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out, schema = as_schema((key, docs.schema[key].dataType), ("score", DoubleType()))
    return docs.select(key, text).mapInArrow(_kernel(shared, [key], text, schema), out).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(crc_bucket("doc_id", 5) != 0), "doc_id", "text", "quality")
    held_out = F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False))
    return score(docs, model, "doc_id", "text").select("doc_id", held_out.alias("held_out"), "score", "predicted")

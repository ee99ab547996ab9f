"""Quality by compression: which of two trained dictionaries shortens a text more.

One Zstandard dictionary is trained on text labelled good, one on text labelled
bad.  A text is compressed with both, in pieces short enough that a dictionary
matters to the end of a long text; the difference of the two total sizes over
their sum is the document's measure, and a logistic curve fitted to labelled
rows that trained neither dictionary turns it into a probability.

Defined results: a null or empty text has measure 0 and the score that the
curve gives it; repeated rows get equal rows; an empty table gives an empty
one; further columns are not read.  Where one class has no labelled row to
learn from, the score of every text is the share of label 1 (1 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textarrays as T
from .common import fold, labelled

PIECE_BYTES = 1024
DICTIONARY_BYTES = 112_640
LEVEL = 3


def dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or, of too little text to train one, the text itself."""
    pieces = [t[i : i + PIECE_BYTES] for t in texts for i in range(0, len(t), PIECE_BYTES)]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, pieces)) // 8)), pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[:size]


def compressor(data: bytes) -> zstandard.ZstdCompressor:
    trained = zstandard.ZstdCompressionDict(data) if data else None
    if trained:
        trained.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=False)


def measures(buffer: np.ndarray, offsets: np.ndarray, good, bad) -> np.ndarray:
    """(bytes with the bad dictionary - bytes with the good one) / their sum, for every document."""
    out, data = np.zeros(len(offsets) - 1), memoryview(np.ascontiguousarray(buffer))
    for i, (start, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        g = b = 0
        for at in range(start, end, PIECE_BYTES):
            piece = data[at : min(end, at + PIECE_BYTES)]
            g += len(good.compress(piece))
            b += len(bad.compress(piece))
        out[i] = (b - g) / max(1, b + g)
    return out


def measured(rows: DataFrame, dictionaries: tuple[bytes, bytes], keep: tuple[str, ...]) -> DataFrame:
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", measure double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = map(compressor, dictionaries)
        for part, buffer, offsets in T.chunks(batches):
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), pa.array(measures(buffer, offsets, good, bad))], [*keep, "measure"])

    return rows.select(*dict.fromkeys((*keep, "text"))).mapInArrow(run, schema)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept by weighted Newton steps, with a slight pull of the slope to 0."""
    a = b = 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        v = weight * p * (1 - p) + 1e-9
        pull = 1e-6 * weight.sum()
        g = np.array([(weight * (y - p) * x).sum() - pull * a, (weight * (y - p)).sum()])
        h = np.array([[(v * x * x).sum() + pull, (v * x).sum()], [(v * x).sum(), v.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1200, train_bytes: int = 6 << 20):
    """(good dictionary, bad dictionary, slope, intercept).

    The sample is at most ``per_class`` rows of each class: those of the even
    turns train the dictionaries (on the driver) with their whole texts, as many,
    in the order of their turn, as have ``train_bytes`` bytes a class in all, a
    longer one left out; whole texts of the odd ones calibrate, of which only the
    measures reach the driver.
    """
    rows = labelled(documents, labels, label, per_class)
    size = F.octet_length("text").cast("long")
    train = rows.where((F.col("turn") % 2 == 0) & (size <= train_bytes))
    upto = Window.partitionBy("label").orderBy("turn", "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)  # over the sample's rows
    texts = train.withColumn("upto", F.sum(size).over(upto)).where(F.col("upto") <= train_bytes).select("label", "text", "turn", "doc_id").toPandas().sort_values(["turn", "doc_id", "text"])
    good, bad = (dictionary([t.encode() for t in texts["text"][texts["label"] == y]]) for y in (1, 0))
    shares = {r["label"]: r["count"] for r in labels.where((fold() != 0) & F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("label")).count().collect()}
    share = shares.get(1, 0) / sum(shares.values()) if shares else 1.0
    held = measured(rows.where("turn % 2 != 0"), (good, bad), ("label",)).toPandas().sort_values(["label", "measure"])
    y = held["label"].to_numpy(float)
    if 0 < y.sum() < len(y):
        weight = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1)) * len(y)
        return good, bad, *logistic(held["measure"].to_numpy(), y, weight)
    return good, bad, 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))


def quality_classifier(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, **settings) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, measure."""
    good, bad, slope, intercept = fit(documents, labels, **settings)
    score = 1 / (1 + F.exp(-(F.lit(slope) * F.col("measure") + F.lit(intercept))))
    rows = measured(documents, (good, bad), ("doc_id",)).withColumn("score", score)
    return rows.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "measure")

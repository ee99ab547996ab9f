"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of hashed words, word pairs and pairs with one word
between, in a table of ``2 ** bits`` coordinates.  Training visits a bounded
sample of labelled documents with per-coordinate rates; the L1 term leaves few
weights, which go to the workers as two short arrays.

Defined results: a null or empty text has no features and scores by the bias;
repeated rows get equal rows; an empty table gives an empty one; further
columns are not read.  Without labelled rows all weights are 0 and the score is
0.5; with one class only, the bias alone learns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as T
from .common import fold, labelled

BITS = 20

#: Bytes that end a word: all of ASCII but letters and digits.
BREAK = np.zeros(256, bool)
BREAK[[b for b in range(128) if not chr(b).isalnum()]] = True


def features(buffer: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document, coordinate) of every n-gram and skip-gram, repeats included."""
    buffer = T.LOWER[buffer]
    starts, ends, doc = T.words(buffer, offsets, BREAK)
    word = T.span_hashes(T.prefix_hashes(buffer), starts, ends)
    docs, hashes = [doc], [word]
    for gap in (1, 2):
        if len(word) > gap:
            both = doc[gap:] == doc[:-gap]
            docs.append(doc[gap:][both])
            hashes.append(T.pair_hashes(word[:-gap][both] + np.uint64(gap), word[gap:][both]))
    return np.concatenate(docs), (np.concatenate(hashes) >> np.uint64(64 - bits)).astype(np.int32)


class FTRL:
    """Follow the regularised leader, proximal: one step a document."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 25.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias, without L1

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, y: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
        rate = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - rate * w
        self.n[at] += g * g


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 5000, epochs: int = 12, bits: int = BITS, **rates) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias), learnt in one task from at most 2 * ``per_class`` documents, of which it holds the distinct coordinates."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buffer, offsets in T.chunks(batches):
            doc, at = features(buffer, offsets, bits)
            key = np.unique(doc.astype(np.int64) << bits | at)
            cuts = np.searchsorted(key >> bits, np.arange(len(offsets)))
            coordinates = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array((key & ((1 << bits) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("turn")), part.column(part.schema.get_field_index("label")), coordinates], ["turn", "label", "at"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t, y, np.asarray(a.values, np.int64)) for b in batches for t, y, a in zip(*(b.column(i).to_pylist() if i < 2 else b.column(i) for i in range(3)))]
        rows.sort(key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes()))
        model = FTRL(1 << bits, **rates)
        for _ in range(epochs):
            for _, y, at in rows:
                model.learn(at, y)
        w = model.weights(np.arange(len(model.z)))
        found = np.append(np.flatnonzero(w[:-1]), len(w) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(w[found])], ["at", "weight"])

    rows = labelled(documents, labels, label, per_class)
    model = rows.mapInArrow(prepare, "turn long, label int, at array<int>").repartition(1).mapInArrow(train, "at long, weight double").toPandas().sort_values("at")
    shares = {r["label"]: r["count"] for r in labels.where((fold() != 0) & F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("label")).count().collect()}
    # The sample holds the classes in other shares than the labels do; the bias takes the difference.
    taken = {y: min(per_class, shares.get(y, 0)) for y in (0, 1)}
    shift = np.log(shares[1] / shares[0]) - np.log(taken[1] / taken[0]) if all(taken.values()) else 0.0
    bias = float(model["weight"].iloc[-1]) if len(model) else 0.0
    return model["at"].to_numpy()[:-1].astype(np.int32), model["weight"].to_numpy()[:-1], bias + float(shift)


def scores(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS) -> DataFrame:
    """doc_id and score of every document."""
    at, weight, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits)
        table[at] = weight
        for part, buffer, offsets in T.chunks(batches):
            doc, hit = features(buffer, offsets, bits)
            found = np.flatnonzero(table[hit])
            key = np.unique(doc[found].astype(np.int64) << bits | hit[found])
            total = np.bincount(key >> bits, table[key & ((1 << bits) - 1)], len(offsets) - 1) + bias
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(1 / (1 + np.exp(-np.clip(total, -500, 500))))], ["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, **settings) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    rows = scores(documents, fit(documents, labels, **settings))
    return rows.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

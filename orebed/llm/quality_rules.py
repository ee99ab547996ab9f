"""Quality rules: an isolation forest over rule statistics.

Each document gets the statistics that hand-written quality rules look at
(word counts, symbol and punctuation rates, repeated lines, words and windows,
capitals).  An isolation forest, whose trees each draw their rows from all
labelled documents, gives its mean path length over random splits; a document that is
isolated after few splits is an anomaly.  The score above which a document is
rejected is calibrated on all labelled rows, by exact quantiles.  Two plain rules hold besides.

Defined results: a null or empty text has no words and fails the base rules;
one word or line repeats nothing; repeated rows get equal rows; an empty table
gives an empty one; further columns are not read; the verdict is a function of
the two tables, not of their order or partitions.  With no labelled rows of both
classes there is nothing to calibrate, and the base rules decide alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import running
from ..operators.stored import written
from . import textarrays as T
from .common import fold, label_ids

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbol_rate", "punctuation_rate", "capital_rate", "word_length", "repeat_rate", "duplicate_line_rate", "echo_rate", "variety")
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[list(b"!\"'(),-./:;?")] = True


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key how often it occurs, and whether this is its first place."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    group = np.cumsum(new) - 1
    times, first = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
    times[order] = np.bincount(group)[group] if len(keys) else 0
    first[order] = new
    return times, first


def statistics(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS and FEATURES of every document, one row each."""
    n = len(offsets) - 1
    starts, ends, doc = T.words(buffer, offsets)
    prefix = T.prefix_hashes(buffer)
    word = T.span_hashes(prefix, starts, ends)
    n_words = np.bincount(doc, minlength=n)
    letters = ((buffer & 0xC0) != 0x80) & ~T.SPACE[buffer]
    word_chars, n_symbols = T.per_document(letters, offsets), T.per_document(SYMBOL[buffer], offsets)

    a, b, at = T.lines(buffer, offsets)
    begun = np.zeros(len(buffer) + 1, np.int64)
    begun[starts + 1] = 1
    begun = np.cumsum(begun)
    kept = begun[b] > begun[a]  # the line has a word
    a, b, at = a[kept], b[kept], at[kept]
    _, first = _counted(T.pair_hashes(T.span_hashes(prefix, a, b), at.astype(np.uint64)))
    n_lines = np.bincount(at, minlength=n)
    n_dup_lines = n_lines - np.bincount(at[first], minlength=n)

    repeated = np.zeros(len(word), bool)
    if len(word) >= 3:
        inside = doc[2:] == doc[:-2]
        window = T.pair_hashes(T.pair_hashes(word[:-2], word[1:-1]), T.pair_hashes(word[2:], doc[2:].astype(np.uint64)))
        at3 = np.flatnonzero(inside)
        again = at3[_counted(window[at3])[0] > 1]
        for k in range(3):
            repeated[again + k] = True
    n_repeat_words = np.bincount(doc[repeated], minlength=n)

    echo = np.zeros(n, np.int64)
    if len(word) >= 2:
        echo = np.bincount(doc[1:][(word[1:] == word[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    distinct = np.bincount(doc[_counted(T.pair_hashes(word, doc.astype(np.uint64)))[1]], minlength=n)
    counts = np.column_stack([n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words])
    per_word = 1 / np.maximum(n_words, 1)
    features = np.column_stack(
        [
            n_symbols * per_word,
            T.per_document(PUNCTUATION[buffer], offsets) * per_word,
            T.per_document((buffer >= 65) & (buffer <= 90), offsets) / np.maximum(word_chars, 1),
            word_chars * per_word,
            n_repeat_words * per_word,
            n_dup_lines / np.maximum(n_lines, 1),
            echo * per_word,
            distinct / np.maximum(n_words, 1) ** 0.85,
        ]
    )
    return counts, features


class IsolationForest:
    """Trees of random splits, kept as arrays of complete binary trees."""

    def __init__(self, rows: np.ndarray, trees: int, sample: int, seed: int):
        rng = np.random.default_rng(seed)
        self.depth = max(1, int(np.ceil(np.log2(max(2, min(sample, len(rows)))))))
        nodes = 2 ** (self.depth + 1) - 1
        self.feature, self.split = np.zeros((trees, nodes), np.int8), np.full((trees, nodes), np.inf)
        self.path = np.zeros((trees, nodes))
        for t in range(trees):
            self._grow(t, 0, rows[rng.choice(len(rows), min(sample, len(rows)), replace=False)], 0, rng)
        self.usual = self._expected(min(sample, len(rows)))

    @classmethod
    def joined(cls, trees: list, sample: int) -> "IsolationForest":
        """The forest of trees (feature, split, path) that were each grown on ``sample`` rows."""
        forest = cls.__new__(cls)
        forest.depth, forest.usual = max(1, int(np.ceil(np.log2(max(2, sample))))), cls._expected(sample)
        forest.feature, forest.split, forest.path = np.array([t[0] for t in trees], np.int8), np.array([t[1] for t in trees], float), np.array([t[2] for t in trees], float)
        return forest

    @staticmethod
    def _expected(n: int) -> float:
        """Mean path length of an unsuccessful search among n rows."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, t: int, node: int, rows: np.ndarray, depth: int, rng) -> None:
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
        open_ = np.flatnonzero(high > low)
        if depth == self.depth or len(rows) < 2 or not len(open_):
            todo = [node]
            while todo:  # the whole subtree ends here
                i = todo.pop()
                self.path[t, i] = depth + self._expected(len(rows))
                if 2 * i + 2 < self.path.shape[1]:
                    todo += [2 * i + 1, 2 * i + 2]
            return
        f = int(rng.choice(open_))
        at = rng.uniform(low[f], high[f])
        self.feature[t, node], self.split[t, node] = f, at
        right = rows[:, f] > at
        self._grow(t, 2 * node + 1, rows[~right], depth + 1, rng)
        self._grow(t, 2 * node + 2, rows[right], depth + 1, rng)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; the shorter the mean path, the nearer to 1."""
        total, index = np.zeros(len(rows)), np.arange(len(rows))
        for feature, split, path in zip(self.feature, self.split, self.path):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[index, feature[node]] > split[node])
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / max(self.usual, 1e-9))


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])


def threshold(scores: DataFrame, n_good: int, good_lost: float) -> float:
    """The lowest score cut that rejects at most ``good_lost`` of the good rows (label 1), moved to the middle of the gap above it when the bad rows leave one; both by exact ranks over all rows."""
    rank = math.ceil((n_good - 1) * (1 - good_lost)) + 1
    cut = running.ranked(scores.where("label = 1"), ["score"]).where(F.col("rank") == rank).first()["score"]
    above = running.quantiles(scores.where((F.col("label") == 0) & (F.col("score") > cut)), "score", {"low": 0.02}).first()
    return cut if above is None or above["low"] is None else (cut + above["low"]) / 2


def measured(documents: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, label, turn, n_words and features of all labelled ids outside fold 0, written.

    Texts are measured where they are and only the numbers are shuffled.  Of rows
    that share an id the one of the smallest text hash counts, one without a text last.
    """
    texts = documents.where(F.col("doc_id").isNotNull() & (fold() != 0)).select("doc_id", F.isnull("text").alias("none"), F.xxhash64("text").alias("hash"), "text")
    rows = _measured(texts, ("doc_id", "none", "hash")).join(label_ids(labels, label), "doc_id")
    one = F.min_by(F.struct("n_words", "features"), F.struct("none", "hash")).alias("_one")
    return written(rows.groupBy("doc_id", "label", "turn").agg(one).select("doc_id", "label", "turn", "_one.*"), "measured")


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", trees: int = 300, sample: int = 256, good_lost: float = 0.002, seed: int = 8):
    """(forest, cut) or None, from all labelled documents; the trees and a few numbers reach the driver.

    Even turns grow the forest, odd ones set the cut.  The forest is grown on
    rows labelled 1, so that a frequent kind of junk cannot pass for usual.
    Each tree draws ``sample`` of all these rows, as an isolation forest does,
    and is grown in a task of its own.
    """
    rows = measured(documents, labels, label).where(F.col("n_words") >= MIN_WORDS)
    even = F.pmod("turn", F.lit(2)) == 0
    grow, good, bad = (F.col("label") == 1) & even, (F.col("label") == 1) & ~even, F.col("label") == 0
    size = len(FEATURES)
    ends = [f(F.col("features")[i]).alias(f"{n}{i}") for i in range(size) for n, f in (("low", F.min), ("high", F.max))]
    box = rows.agg(*(F.count_if(c).alias(n) for n, c in (("grow", grow), ("good", good), ("bad", bad))), *ends).first()
    if box["grow"] < 2 or not box["good"] or not box["bad"]:
        return None
    values = rows.where(grow).select(F.posexplode("features").alias("f", "value"))
    middle = np.zeros(size)
    for r in running.quantiles(values, "value", {"middle": 0.5}, ["f"]).collect():
        middle[r["f"]] = r["middle"]
    low, high = (np.array([box[f"{n}{i}"] for i in range(size)], float) for n in ("low", "high"))
    n_grow, steps = box["grow"], max(2, box["grow"] // 100)
    total = n_grow + size * steps
    drawn = min(sample, total)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch["tree"]:
                yield pd.DataFrame({"tree": t, "number": np.random.default_rng([seed, int(t)]).choice(total, drawn, replace=False)})

    def tree(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("number")
        held = part[part["number"] < n_grow]
        own = np.array(held["features"].tolist(), float).reshape(-1, size)
        frame = _frame(part["number"].to_numpy()[len(held) :] - n_grow, steps, middle, low, high)
        one = IsolationForest(np.concatenate([own, frame]), 1, drawn, [seed, int(key[0]), 1])
        return pd.DataFrame({"tree": [key[0]], "feature": [one.feature[0].astype(int)], "split": [one.split[0]], "path": [one.path[0]]})

    draws = documents.sparkSession.range(trees).withColumnRenamed("id", "tree").mapInPandas(draw, "tree long, number long")  # trees times sample rows, however many are labelled
    numbered = running.ranked(rows.where(grow), ["turn", "doc_id"], "number").select((F.col("number") - 1).alias("number"), "features")
    found = numbered.join(F.broadcast(draws), "number").select("tree", "number", "features")
    found = found.unionByName(draws.where(F.col("number") >= n_grow).withColumn("features", F.lit(None).cast("array<double>")))
    made = found.groupBy("tree").applyInPandas(tree, "tree long, feature array<int>, split array<double>, path array<double>").orderBy("tree").collect()
    forest = IsolationForest.joined([(r["feature"], r["split"], r["path"]) for r in made], drawn)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["features"].tolist(), float).reshape(-1, size)
            yield pd.DataFrame({"label": batch["label"], "score": forest.score(x)})

    scores = written(rows.where(good | bad).select("label", "features").mapInPandas(scored, "label int, score double"), "scores")
    return forest, threshold(scores, box["good"], good_lost)


def _frame(numbers: np.ndarray, steps: int, middle: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows of the usual median with one feature spread over its whole range in ``steps`` steps, so that splits also fall outside the usual range; a number for each feature and step."""
    out = np.tile(middle, (len(numbers), 1))
    f, step = np.divmod(numbers, steps)
    out[np.arange(len(numbers)), f] = low[f] + (high[f] - low[f]) * (step / (steps - 1))
    return out


def _measured(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep) + ", n_words long, features array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buffer, offsets in T.chunks(batches):
            counts, features = statistics(buffer, offsets)
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), pa.array(counts[:, 0]), pa.array(features.tolist(), pa.list_(pa.float64()))], [*keep, "n_words", "features"])

    return rows.select(*keep, "text").mapInArrow(run, schema)


def judge(documents: DataFrame, model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every document, its COUNTS, base_failed, score and kept."""
    fields = {c: documents.schema[c].dataType.simpleString() for c in keep}
    schema = ", ".join([*(f"`{c}` {t}" for c, t in fields.items()), *(f"{c} long" for c in COUNTS), "base_failed boolean", "kept boolean", "anomaly double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buffer, offsets in T.chunks(batches):
            counts, features = statistics(buffer, offsets)
            failed = base_failed(counts)
            score = model[0].score(features) if model else np.zeros(len(failed))
            kept = ~failed & (score <= model[1] if model else True)
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), *(pa.array(c) for c in counts.T.astype(np.int64)), pa.array(failed), pa.array(kept), pa.array(score)], [*keep, *COUNTS, "base_failed", "kept", "anomaly"])

    columns = dict.fromkeys((*keep, "text"))
    return documents.select(*columns).mapInArrow(run, schema)


def quality_rules(documents: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Per document: doc_id, COUNTS, base_failed, kept, anomaly."""
    return judge(documents, fit(documents, labels, **settings))


def kept_documents(documents: DataFrame, model) -> DataFrame:
    """The documents' rows that pass, all their columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buffer, offsets in T.chunks(batches):
            counts, features = statistics(buffer, offsets)
            kept = ~base_failed(counts)
            if model:
                kept &= model[0].score(features) <= model[1]
            yield part.filter(pa.array(kept))

    return documents.mapInArrow(run, documents.schema)


SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
lists AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS l FROM texts),
words AS (SELECT doc_id, unnest(l) AS w, unnest(range(len(l))) AS k FROM lists),
windows AS (SELECT doc_id, k, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
found AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows WHERE g IS NOT NULL),
again AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS k FROM found WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM texts),
twice AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(l)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(twice.n, 0)::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words
  FROM texts JOIN lists USING (doc_id) LEFT JOIN twice USING (doc_id) LEFT JOIN again USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
"""

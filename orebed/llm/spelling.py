"""Spelling variant grouping by two-dimensional range reporting.

A word that differs from another by one code point at position i shares with it
what stands before i and what stands after.  Sorted forwards, the words with a
given beginning are an interval; sorted backwards, so are those with a given
ending; the near words for position i are the points of a rectangle of forward
rank and backward rank.  A wavelet tree over the backward ranks in forward order
reports the points of many rectangles at once, at a cost of the tree's depth for
each point and without looking at others.  Words of each length have a tree of
their own, so every point of a rectangle differs by exactly that edit.

To be spread over tasks, words of length n and n + 1 meet twice: by their first
n // 2 code points, for edits behind those, and by what follows in the shorter,
for edits before; each pair is found at its first differing position, once.  A
group of more than ``tile`` words is dealt to pairs of tiles, so no task holds a
group, and only a row a word and work unit leaves a task: how many near words and
the commonest.

Defined results: a null or empty text has no words; a null id counts as an empty
text in the hash; repeated rows count as often as they stand there; words of any
length are compared; a deletion may leave a word too short or join the
occurrences of another; equal counts fall to the word that is first in code-point
order; an empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stored import written
from . import tiles
from .common import crc32_sql

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, RATIO, EVERY, TILE = 6, 5, 5, 199, 1 << 15
#: Entries after which a task hands on what it has counted.
HELD = 200_000
#: A root is followed over this many doublings: counts grow by RATIO a step, and 5 ^ 32 does not fit a long.
DOUBLINGS = 5

_LOWER = {c: c + 32 for c in range(65, 91)}


def _noisy(run: str, state: int, every: int = EVERY) -> str:
    """The run, less a code point where the hash of `<doc_id>:<run>` says so; ``state`` is the crc32 of `<doc_id>:`."""
    h = zlib.crc32(run.encode(), state)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """word and n (occurrences overall) of the words that are long and common enough; counted in the tasks first."""
    pattern = re.compile(RUN)

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            ids, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text"))
            for i, text in zip(ids, texts):
                found = Counter(pattern.findall(text.as_py() or ""))
                state = zlib.crc32(f"{'' if i.as_py() is None else i.as_py()}:".encode())
                for word, n in found.items():
                    if len(word) >= least_length:  # a deletion only shortens
                        counts[_noisy(word.lower() if word.isascii() else word.translate(_LOWER), state, every)] += n
                if len(counts) > HELD:
                    yield out(counts)
                    counts = Counter()
        yield out(counts)

    rows = documents.select("doc_id", "text").mapInArrow(run, "word string, n long").where(F.char_length("word") >= least_length)
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class WaveletTree:
    """The values of a sequence bit by bit, the highest first, each level ordered by the bits above; reports the positions whose value lies in a range."""

    def __init__(self, values: np.ndarray):
        self.n, self.depth = len(values), max(1, int(len(values) - 1).bit_length())
        self.ones, self.zeros, self.place = [], [], np.arange(self.n)
        order = np.asarray(values)
        for level in range(self.depth - 1, -1, -1):
            bit = (order >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(int(self.n - bit.sum()))
            turn = np.argsort(bit, kind="stable")
            order, self.place = order[turn], self.place[turn]

    def report(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, beyond: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, position) of all positions in [low, high) with a value in [least, beyond), of every query."""
        query = np.flatnonzero((low < high) & (least < beyond))
        low, high, least, beyond, value = low[query], high[query], least[query], beyond[query], np.zeros(len(query), np.int64)
        for level, ones, zeros in zip(range(self.depth - 1, -1, -1), self.ones, self.zeros):
            a, b = ones[low], ones[high]
            half = value + (1 << level)
            # Values below half go on among the zeros, the others among the ones; empty ranges and values outside end here.
            left = (low - a < high - b) & (least < half)
            right = (a < b) & (beyond > half) & (least < half + (1 << level))
            left &= beyond > value
            low, high = np.concatenate([(low - a)[left], zeros + a[right]]), np.concatenate([(high - b)[left], zeros + b[right]])
            value = np.concatenate([value[left], half[right]])
            query, least, beyond = (np.concatenate([x[left], x[right]]) for x in (query, least, beyond))
        times = high - low
        first = np.repeat(low - (np.cumsum(times) - times), times)
        return np.repeat(query, times), self.place[first + np.arange(times.sum())]


def _sorted_runs(unit: np.ndarray, letters: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by unit and letters, and how many letters each row of the order shares with the one before (-1: another unit)."""
    order = np.lexsort([*letters.T[::-1], unit])
    a, b = letters[order[:-1]], letters[order[1:]]
    differ = a != b
    shared = np.where(differ.any(1), differ.argmax(1), letters.shape[1]) if len(a) and letters.shape[1] else np.zeros(len(a), np.int64)
    shared = np.minimum(shared, np.minimum(length[order[:-1]], length[order[1:]]))
    shared[unit[order[:-1]] != unit[order[1:]]] = -1
    return order, np.concatenate([[-1], shared])


def _interval(shared: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """For every row of an order the interval of rows that share its first ``count`` letters."""
    new = shared < count
    starts = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    return starts[which], np.append(starts, len(shared))[which + 1]


def near_pairs(unit: np.ndarray, words: list[str], shorter: np.ndarray, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of words of one unit, j one edit from i and not shorter, i not the longer of its unit's two lengths; substitutions stand in both directions.

    ``shorter`` is the lesser word length of a row's unit, ``front`` says that
    the unit shares its beginning (edits lie behind), else its ending.
    """
    length = np.fromiter(map(len, words), np.int64, len(words))
    width = int(length.max())
    letters = np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width)
    backward = np.array([w[::-1] for w in words], f"U{width}").view(np.uint32).reshape(len(words), width)
    order, ahead = _sorted_runs(unit, letters, length)
    redro, behind = _sorted_runs(unit, backward, length)
    rank, knar = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
    rank[order], knar[redro] = np.arange(len(words)), np.arange(len(words))
    # Of each kind of word (as long as its unit's shorter ones, or one longer): how many stand before a rank, and the tree over them.
    small = length == shorter
    kinds = []
    for kind in (small, ~small):
        before, erofeb = (np.concatenate([[0], np.cumsum(kind[o])]) for o in (order, redro))
        rows = order[kind[order]]
        kinds.append((before, erofeb, rows, WaveletTree(erofeb[knar[rows]]) if len(rows) else None))
    found = []
    asking = np.flatnonzero(small)
    for i in range(int(shorter[asking].max()) + 1 if len(asking) else 0):
        half = shorter[asking] // 2
        here = asking[(i <= length[asking]) & np.where(front[asking], i >= half, i < half)]
        if not len(here):
            continue
        low, high = (x[rank[here]] for x in _interval(ahead, i))
        for longer, (before, erofeb, rows, tree) in enumerate(kinds):
            if tree is None:
                continue
            ending = length[here] - i - (not longer)  # a replaced letter is passed over, an inserted one stands between
            ask = (high - low > 1) & (ending >= 0)
            q = np.flatnonzero(ask)
            if not len(q):
                continue
            least, beyond = np.empty(len(q), np.int64), np.empty(len(q), np.int64)
            for e in np.unique(ending[q]):
                at = ending[q] == e
                x, y = _interval(behind, int(e))
                own = knar[here[q[at]]]
                least[at], beyond[at] = x[own], y[own]
            hit, place = tree.report(before[low[q]], before[high[q]], erofeb[least], erofeb[beyond])
            a, b = here[q[hit]], rows[place]
            # The first difference is at i, so no pair is met at two positions.
            new = (letters[a, i] != letters[b, i]) if i < width and not longer else np.where(i < length[a], letters[a, np.minimum(i, width - 1)] != letters[b, np.minimum(i, width - 1)], True)
            found.append((a[new], b[new]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(map(np.concatenate, zip(*found)))


#: Letters of the matrix that a task holds for one call.
CELLS = 1 << 22


def _calls(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.Table]:
    """Runs of whole units whose letters, padded to the longest, stay under CELLS (a unit alone may be larger)."""
    longest = np.maximum.reduceat(table.column("p").to_numpy(), cuts[:-1]) if len(cuts) > 1 else np.zeros(0, np.int64)
    at = 0
    while at < len(longest):
        to, width = at + 1, longest[at]
        while to < len(longest) and max(width, longest[to]) * (cuts[to + 1] - cuts[at]) <= CELLS:
            width = max(width, longest[to])
            to += 1
        yield table.slice(cuts[at], cuts[to] - cuts[at])
        at = to


def near(words: DataFrame, tile: int = TILE) -> DataFrame:
    """word, n_near, form, form_n (the commonest near word) of every word with a near one, from word and n."""
    length = F.char_length("word")
    # The groups of a word: as the shorter and as the longer of two lengths, by its beginning and by its ending.
    keys = []
    for less in (0, 1):
        short = length - less
        half = F.floor(short / 2).cast("int")
        for front in (True, False):
            part = F.substring("word", F.lit(1), half) if front else F.substring("word", length - (short - half) + 1, short - half)
            keys.append(F.struct(short.cast("int").alias("short"), F.lit(front).alias("front"), part.alias("part")))
    rows = words.select("word", "n", length.cast("int").alias("p"), F.explode(F.array(*keys)).alias("key"))
    rows = rows.select(F.xxhash64("key.short", "key.front", "key.part").alias("g"), "p", F.xxhash64("word").alias("id"), "word", "n", "key.short", "key.front", "key.part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, cuts in tiles.whole_units(batches):
            for table in _calls(whole, cuts):
                keys = [table.column(c).to_pylist() for c in ("g", "lo", "hi", "short", "front", "part")]
                names: dict = {}
                unit = np.fromiter((names.setdefault(k, len(names)) for k in zip(*keys)), np.int64, table.num_rows)  # two groups of one hash stay apart
                if table.num_rows == len(names):
                    continue
                word, n = table.column("word").to_pylist(), table.column("n").to_numpy()
                a, b = near_pairs(unit, word, table.column("short").to_numpy().astype(np.int64), table.column("front").to_numpy(zero_copy_only=False))
                side, single = table.column("side").to_numpy(zero_copy_only=False), table.column("lo").to_numpy() == table.column("hi").to_numpy()
                across = single[a] | (side[a] != side[b])
                a, b = a[across], b[across]
                size = np.fromiter(map(len, word), np.int64, len(word))
                back = size[a] < size[b]  # a word of equal length is asked for itself
                a, b = np.concatenate([a, b[back]]), np.concatenate([b, a[back]])
                if not len(a):
                    continue
                turn = np.empty(len(word), np.int64)
                turn[sorted(range(len(word)), key=word.__getitem__)] = np.arange(len(word))
                order = np.lexsort([turn[b], -n[b], a])
                a, b = a[order], b[order]
                first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([word[k] for k in a[first]], pa.string()), pa.array(np.diff(np.append(first, len(a)))), pa.array([word[k] for k in b[first]], pa.string()), pa.array(n[b[first]])],
                    ["word", "n_near", "form", "form_n"],
                )

    found = tiles.dealt(rows, radius=1, tile=tile).mapInArrow(run, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root (the last form reached) from word and form (null: none), by pointer doubling."""
    at = forms.select("word", F.coalesce("form", "word").alias("root"))
    for _ in range(DOUBLINGS):
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(step, "root").select("word", F.col("next").alias("root")), "roots")
    return at


def variants(words: DataFrame, ratio: int = RATIO, tile: int = TILE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word, from word and n."""
    found = words.join(near(words, tile), "word", "left")
    enough = F.col("form_n") >= ratio * F.col("n")
    rows = written(found.select("word", F.when(enough, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("form_n")).alias("form_n")), "forms")
    return rows.join(roots(rows), "word").select("word", "form", "root", "n", "n_near", "form_n")


def spelling_variants(documents: DataFrame, **settings) -> DataFrame:
    """Per word of the documents: word, form, root, n, n_near, form_n."""
    return variants(written(word_counts(documents), "words"), **settings)


SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{RUN}')) AS run FROM documents),
hashed AS (
  SELECT run, c, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY ALL)),
noisy AS (
  SELECT CASE WHEN h % {EVERY} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c FROM hashed),
words AS (
  SELECT word, sum(c)::BIGINT AS n FROM noisy WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
cut AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, range(1, (SELECT max(length(word)) FROM words) + 1) t(i) WHERE i <= length(word)),
pairs AS (
  SELECT DISTINCT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.rest),
best AS (
  SELECT p.word, count(*) AS n_near, arg_min(other, row(-o.n, encode(other))) AS form, max(o.n) AS form_n FROM pairs p JOIN words o ON o.word = p.other GROUP BY p.word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {RATIO} * n THEN form END AS form, CASE WHEN form_n >= {RATIO} * n THEN form_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""

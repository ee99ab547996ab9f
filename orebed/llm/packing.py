"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens; a full piece is a
sequence of its own, so at most one piece of a document is left to be packed.
These are dealt to shards by a hash; a shard is packed by several islands, each
with a population of packings of the shard's lengths.  The chromosome's genes
are bins: crossover injects whole well-filled bins of one parent into another,
removes the bins that hold their items twice over, and refits the displaced
items best-fit, longest first.  After each epoch an island's elite migrates to
the next island of its shard; the best packing of any island is the shard's.
The emptiest bin of every shard, the only place where a shard can waste what
another could use, is opened again, and its pieces are packed as a level of
their own, level by level until one shard is left.

Defined results: a null or empty text is the end id alone, one piece; longer
documents only are cut; equal and repeated rows, and equal or null ids, are
documents of their own; an empty table gives an empty one; further columns are
not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stored import shards, written
from . import textarrays as T
from . import tokens

CAPACITY, SHARD_DOCUMENTS = 2048, 2500
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 3, 2, 4, 4
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and place (a hash of its document's ids and, for equal or null ids, of its turn in the chunk) to deal it by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer, end_id)
        for rows, _, _ in T.chunks(batches, limit=1 << 19):
            names = rows.column("doc_id")
            ids, begin = encoder.encode(rows.column("text").to_pylist())
            data, turns = memoryview(ids.astype("<u4")).cast("B"), Counter()
            n = -(-np.diff(begin) // capacity)
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(begin[1:][doc] - begin[doc] - start, capacity)
            at = 4 * (begin[doc] + start)
            sums = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
            place = []
            for name, a, b in zip(names.to_pylist(), (4 * begin[:-1]).tolist(), (4 * begin[1:]).tolist()):
                place.append(zlib.crc32(data[a:b]) << 31 | turns[name])
                turns[name] += 1
            yield pa.RecordBatch.from_arrays([names.take(pa.array(doc)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, sums, np.array(place)[doc]))], ["doc_id", "piece", "start", "length", "ids_crc32", "place"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"{_PIECE}, place long")


class Bins:
    """A packing while it is made: bins of items, and the open bins by what they can still take."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.room: list[tuple[int, int]] = []  # (left, bin), sorted

    def add(self, items: list[int]) -> None:
        left = self.capacity - sum(self.lengths[i] for i in items)
        self.bins.append(items)
        if left:
            insort(self.room, (left, len(self.bins) - 1))

    def best_fit(self, items: list[int]) -> None:
        """Each item, longest first, into the fullest bin that can take it."""
        for i in sorted(items, key=lambda i: -self.lengths[i]):
            at = bisect_left(self.room, (self.lengths[i], -1))
            if at == len(self.room):
                self.add([i])
                continue
            left, b = self.room.pop(at)
            self.bins[b].append(i)
            if left > self.lengths[i]:
                insort(self.room, (left - self.lengths[i], b))


def fill(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; of as many, those with fuller and emptier bins."""
    return -len(bins), sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(one: list[list[int]], two: list[list[int]], lengths: list[int], capacity: int, rng) -> list[list[int]]:
    """Whole well-filled bins of ``two`` in ``one``; what they displace is refitted."""
    full = np.array([sum(lengths[i] for i in b) for b in two])
    best = np.argsort(-full + rng.random(len(two)) * capacity / 16)
    injected = [two[k] for k in best[: max(1, int(len(two) * rng.uniform(0.2, 0.5)))].tolist()]
    taken = {i for b in injected for i in b}
    child, displaced = Bins(lengths, capacity), []
    for b in injected:
        child.add(list(b))
    for b in one:
        if taken.isdisjoint(b):
            child.add(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    child.best_fit(displaced)
    return child.bins


def mutated(bins: list[list[int]], lengths: list[int], capacity: int, rng) -> list[list[int]]:
    """Without some bins, the emptiest and a few others, whose items are refitted."""
    full = np.array([sum(lengths[i] for i in b) for b in bins])
    order = np.argsort(full + rng.random(len(bins)) * capacity / 8)
    gone = set(order[: max(2, len(bins) // 20)].tolist())
    child = Bins(lengths, capacity)
    for k, b in enumerate(bins):
        if k not in gone:
            child.add(list(b))
    child.best_fit([i for k in sorted(gone) for i in bins[k]])
    return child.bins


def first_packing(lengths: list[int], capacity: int, rng, spread: float) -> list[list[int]]:
    """Best fit decreasing, of lengths blurred by ``spread``."""
    made, order = Bins(lengths, capacity), np.array(lengths) * (1 + spread * rng.random(len(lengths)))
    for i in np.argsort(-order, kind="stable").tolist():
        made.best_fit([i])
    return made.bins


def evolve(population: list[list[list[int]]], lengths: list[int], capacity: int, generations: int, size: int, rng) -> list[list[list[int]]]:
    """Generations of crossover and mutation; the best ``size`` packings survive. Ends when no packing could use fewer bins."""
    least = -(-sum(lengths) // capacity)
    score = lambda b: fill(b, lengths, capacity)
    population = sorted(population, key=score, reverse=True)[:size]
    for _ in range(generations):
        if len(population[0]) <= least or len(population) < 2:
            break
        a, b = rng.choice(len(population), 2, replace=False)
        child = crossover(population[min(a, b)], population[max(a, b)], lengths, capacity, rng)
        population = sorted([*population, child, mutated(population[0], lengths, capacity, rng)], key=score, reverse=True)[:size]
    return population


def _as_labels(bins: list[list[int]], n: int) -> bytes:
    label = np.empty(n, "<i4")
    for k, b in enumerate(bins):
        label[b] = k
    return label.tobytes()


def _as_bins(labels: bytes) -> list[list[int]]:
    label = np.frombuffer(labels, "<i4")
    order = np.argsort(label, kind="stable")
    return [b.tolist() for b in np.split(order, np.flatnonzero(np.diff(label[order])) + 1)] if len(label) else []


_ISLAND = "shard long, island int, lengths binary, packing binary"


def _epoch(islands: DataFrame, last: bool, capacity: int, settings: dict) -> DataFrame:
    """Each island evolves its packings (first ones are made where it has none) and sends its elite on: to itself and the next island, or, at the end, to one place a shard."""
    count, epoch = settings["islands"], settings["epoch"]

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(key[0]), int(key[1])
        rng = np.random.default_rng([9, epoch, shard & 0xFFFFFFFF, island])
        lengths = np.frombuffer(rows["lengths"].iloc[0], "<i4").tolist()
        population = [_as_bins(p) for p in sorted(p for p in rows["packing"] if p is not None)]
        while len(population) < settings["population"]:
            population.append(first_packing(lengths, capacity, rng, 0.0 if not population and island == 0 else 0.15 * (island + len(population))))
        population = evolve(population, lengths, capacity, settings["generations"], settings["population"], rng)
        if last:
            sent = [(0, population[0])]
        else:
            sent = [(island, p) for p in population[: settings["population"] - 1]] + [((island + 1) % count, population[0])]
        blob = rows["lengths"].iloc[0]
        return pd.DataFrame({"shard": shard, "island": [i for i, _ in sent], "lengths": [blob] * len(sent), "packing": [_as_labels(p, len(lengths)) for _, p in sent]})

    spread = islands.repartition(shards(islands.sparkSession), "shard", "island")  # small rows, long work: not to be coalesced
    return spread.groupBy("shard", "island").applyInPandas(run, _ISLAND)


def pack(rows: DataFrame, n_rows: int, capacity: int = CAPACITY, shard_documents: int = SHARD_DOCUMENTS, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION, level: int = 0) -> DataFrame:
    """The rows of :func:`pieces` that are shorter than the capacity (a table that can be read again, of about ``n_rows`` rows) with sequence_id and offset."""
    n_shards = max(1, -(-n_rows // shard_documents))
    order = ["length", "doc_id", "piece", "ids_crc32"]
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("place", "doc_id", F.lit(level)), F.lit(n_shards)))
    settings = {"islands": islands, "generations": generations, "population": population}

    def start(key, part: pd.DataFrame) -> pd.DataFrame:
        lengths = np.sort(part["length"].to_numpy())[::-1].astype("<i4").tobytes()
        return pd.DataFrame({"shard": int(key[0]), "island": np.arange(islands, dtype=np.int32), "lengths": [lengths] * islands, "packing": [None] * islands})

    state = rows.select("shard", "length").groupBy("shard").applyInPandas(start, _ISLAND)
    for epoch in range(epochs):
        state = _epoch(state, epoch == epochs - 1, capacity, settings | {"epoch": epoch})

    def finish(key, part: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, ascending=[False, True, True, True], kind="stable", ignore_index=True)
        lengths = np.frombuffer(best["lengths"].iloc[0], "<i4").tolist()
        chosen = max((_as_bins(p) for p in sorted(best["packing"])), key=lambda b: fill(b, lengths, capacity))
        label, offset = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        for k, b in enumerate(chosen):
            label[b] = k
            offset[b] = np.concatenate([[0], np.cumsum(part["length"].to_numpy()[b])[:-1]])
        part["loose"] = label == int(np.argmin([sum(lengths[i] for i in b) for b in chosen]))
        part["sequence_id"], part["offset"] = (level << 56) + (int(key[0]) << 24) + label, offset
        return part[["doc_id", "piece", "start", "length", "ids_crc32", "place", "sequence_id", "offset", "loose"]]

    packed = rows.groupBy("shard").cogroup(state.groupBy("shard")).applyInPandas(finish, f"{_PIECE}, place long, sequence_id long, offset long, loose boolean")
    result = [c.split()[0] for c in _PIECE.split(", ")] + ["sequence_id", "offset"]
    if n_shards == 1:
        return packed.select(result)
    packed = written(packed, "packed")
    opened = packed.where("loose").drop("sequence_id", "offset", "loose")
    return packed.where("not loose").select(result).unionByName(pack(opened, opened.count(), capacity, shard_documents, islands, epochs, generations, population, level + 1))


def best_fit_packing(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, **settings) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = written(pieces(documents, tokenizer, capacity), "pieces")
    short, full = rows.where(F.col("length") < capacity), rows.where(F.col("length") == capacity)
    alone = full.drop("place").withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return pack(short, short.count(), capacity, **settings).unionByName(alone)

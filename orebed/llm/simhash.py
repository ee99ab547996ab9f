"""SimHash near-duplicates: tiled exact comparison of fingerprints.

A text's fingerprint has the bits that are set in over half of the XXH64 hashes
(seed 42) of its word shingles.  Fingerprints that differ in at most ``radius``
bits agree wholly in two of radius + 2 blocks of bits, so only fingerprints that
share a pair of blocks (25 or 26 bits, for a radius of 3) are compared: in tiles
sorted by population count, by numpy's exclusive-or and bit counts, tile pairs
whose population counts differ by more than the radius being skipped.  The result
is exact; a pair's value that many fingerprints share is split into tile pairs.
Texts of equal fingerprint are one row there, and a tile reports a spanning
forest of its links.

Defined results: a null or empty text has fingerprint 0 and links like any
other; a text of fewer words than a shingle is one shingle; repeated rows and
ids are kept, each with its row; a null id never names a component unless all
ids of the component are null; an empty table gives an empty one; further
columns are not read by :func:`near_duplicates` and are kept by :func:`one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components, forest
from ..operators.stored import written
from . import textarrays as T
from . import tiles

RADIUS, WORDS, SEED = 3, 3, 42
_LOWER = bytes(T.LOWER)


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased words; bytes.split() cuts at the separators of the word pattern."""
    found = text.translate(_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[k:] for k in range(words))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, th (a hash of the text) and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buffer, offsets in T.chunks(batches):
            data = buffer.tobytes()
            found = [fingerprint(shingle_hashes(data[a:b], words)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in ("doc_id", "th")), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "th", "fp"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, fp long")


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = 2048) -> DataFrame:
    """Edges u - v that join all rows of fp and id whose fp differ in at most ``radius`` bits: a forest of each tile pair's links."""
    ends = [64 * k // (radius + 2) for k in range(radius + 3)]
    block = lambda k: F.shiftrightunsigned("fp", ends[k]).bitwiseAND((1 << (ends[k + 1] - ends[k])) - 1)
    both = list(combinations(range(radius + 2), 2))
    keys = F.array(*((F.shiftleft(block(i), ends[j + 1] - ends[j]).bitwiseOR(block(j)) * len(both) + n).alias("g") for n, (i, j) in enumerate(both)))
    rows = distinct.select(F.explode(keys).alias("g"), F.bit_count("fp").alias("p"), "id", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in tiles.whole_units(batches):
            fp = table.column("fp").to_numpy().view(np.uint64)
            side, single = table.column("side").to_numpy(), table.column("lo").to_numpy() == table.column("hi").to_numpy()
            ids = table.column("id").to_numpy()
            a, b = [], []
            for i, j in tiles.pairs(cuts, side, single, table.column("p").to_numpy(), radius, lambda i, j: np.bitwise_count(fp[i] ^ fp[j]) <= radius):
                a.append(i)
                b.append(j)
                if sum(map(len, a)) > 1 << 20:  # keep a forest of what was found so far
                    root = forest(len(fp), np.concatenate(a), np.concatenate(b))
                    a, b = [np.arange(len(fp))], [root]
            if a:
                root = forest(len(fp), np.concatenate(a), np.concatenate(b))
                u, v = ids, ids[root]
                yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"])

    return tiles.dealt(rows, radius, tile).select(*tiles.UNIT, "side", "p", "id", "fp").mapInArrow(compare, "u long, v long")


def _grouped(rows: DataFrame, radius: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """(fp and root, the fingerprint that names its component, for every fp; per root: component_id and the first row's doc_id and th)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")  # null ids last
    distinct = rows.groupBy("fp").agg(first)
    found = components(written(links(distinct.select("fp", F.col("fp").alias("id")), radius, tile), "links"))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("root"), "first")
    rooted = written(rooted, "roots")
    return rooted.select("fp", "root"), rooted.groupBy("root").agg(F.min("first").alias("first")).select("root", F.col("first.doc_id").alias("component_id"), F.col("first.th").alias("th"))


def near_duplicates(documents: DataFrame, radius: int = RADIUS, words: int = WORDS, tile: int = 2048) -> DataFrame:
    """Per row: doc_id, fp, component_id (the least id reachable over links, its own included)."""
    rows = written(fingerprints(documents, words), "fingerprints")
    rooted, named = _grouped(rows, radius, tile)
    return rows.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def simhash(documents: DataFrame, **settings) -> DataFrame:
    """Per row: doc_id, fingerprint (16 lowercase hex digits), component_id."""
    rows = near_duplicates(documents, **settings)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """The documents' rows without those that are near-duplicates of a kept one: of each component of fingerprints the row of the least id stays, null ids last.

    Of rows of that id in the component that of the least text hash stays; rows
    equal in both are told apart by a hash of their columns; of equal rows one stays.
    """
    named = _grouped(written(fingerprints(documents, words), "fingerprints"), radius, 2048)[1]
    stay = named.select(F.col("component_id").alias("stay_id"), F.col("th").alias("stay_th"))
    rows = documents.select(F.struct(*documents.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"), F.xxhash64(*documents.columns).alias("hash"))
    rows = rows.join(stay, (F.col("th") == F.col("stay_th")) & F.col("id").eqNullSafe(F.col("stay_id")), "left_semi")
    turn = Window.partitionBy("id", "th").orderBy("hash")
    return rows.withColumn("turn", F.row_number().over(turn)).where("turn = 1").select("row.*")

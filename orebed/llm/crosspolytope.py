"""Embedding near-duplicates by cross-polytope hashing.

A table rotates a vector by fast Hadamard transforms after random sign flips,
``HASHES`` times independently; the nearest axes of the rotations (the largest
coordinate and its sign) make the bucket, and the next nearest axes make the
buckets probed besides.  What goes to the buckets is a vector's number and a
sketch, the signs of ``SIGNS`` rotated coordinates; rows of a bucket whose
sketches differ in too many signs for the threshold (by six deviations) are told
apart there, in tiles of bounded size (a hot bucket becomes tile pairs).  Only
the rows that are left get their vectors, and are compared exactly, in double
precision, in the same tiles, so no pair below the threshold is linked.  Equal
vectors are one row with a count.

A pair may meet in many buckets; it is counted in the first bucket, by table and
key, that both vectors have, so links are counted without listing pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, a vector of another length only with its like;
repeated rows and ids are kept, equal vectors link with each other; a null id is
kept and names a component only where all its ids are null; an empty table gives
an empty one; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components, forest
from ..operators.stored import shards, written
from . import textarrays as T
from . import tiles

COSINE = 0.9
HASHES, TABLES, PROBES, AXES, SEED = 3, 12, 6, 3, 5
SIGNS, SALTS = 128, 8


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the rows (of a power of two columns), in log2 passes."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def buckets(x: np.ndarray, tables: int = TABLES, probes: int = PROBES, hashes: int = HASHES, seed: int = SEED) -> np.ndarray:
    """rows x tables x probes bucket keys of unit vectors; a key holds its table."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    rng = np.random.default_rng([seed, x.shape[1]])
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    axes = min(AXES, d)
    out = np.empty((len(x), tables, probes), np.int64)
    for t in range(tables):
        names, losses = [], []
        for _ in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d)) / np.sqrt(d)
            top = np.argpartition(-np.abs(y), axes - 1, axis=1)[:, :axes]
            size = np.take_along_axis(y, top, 1)
            order = np.argsort(-np.abs(size), axis=1, kind="stable")
            top, size = np.take_along_axis(top, order, 1), np.take_along_axis(size, order, 1)
            names.append(2 * top + (size < 0))
            losses.append((np.abs(size[:, :1]) - np.abs(size)) ** 2)
        name, loss = names[0], losses[0]
        for more, cost in zip(names[1:], losses[1:]):
            name = (name[:, :, None] * (2 * d) + more[:, None, :]).reshape(len(x), -1)
            loss = (loss[:, :, None] + cost[:, None, :]).reshape(len(x), -1)
        best = np.argsort(loss, axis=1, kind="stable")[:, np.arange(probes) % loss.shape[1]]
        out[:, t] = np.sort(np.take_along_axis(name, best, 1) + t * (2 * d) ** hashes, axis=1)
    return out


def _keys(x: np.ndarray, tables: int, probes: int) -> np.ndarray:
    """Buckets that tell vectors of different lengths apart."""
    return buckets(x, tables, probes) ^ T.mix(np.array([x.shape[1]], np.uint64)).view(np.int64)


def sketches(x: np.ndarray, seed: int = SEED) -> np.ndarray:
    """rows x 2 words of 64 signs each, of coordinates of rotated vectors."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    rng = np.random.default_rng([seed + 1, x.shape[1]])
    signs: list[np.ndarray] = []
    while sum(s.shape[1] for s in signs) < SIGNS:
        y = np.pad(x, ((0, 0), (0, d - x.shape[1])))
        for _ in range(3):
            y = hadamard(y * rng.choice([-1.0, 1.0], d)) / np.sqrt(d)
        signs.append(y[:, :64] > 0)
    return np.packbits(np.concatenate(signs, axis=1)[:, :SIGNS], axis=1).view(np.uint64)


def most_apart(cosine: float) -> int:
    """Signs in which sketches of vectors at the threshold differ at most: their expected number and six deviations."""
    p = float(np.arccos(np.clip(cosine, -1, 1)) / np.pi)
    return int(np.ceil(SIGNS * p + 6 * np.sqrt(SIGNS * p * (1 - p))))


def _by_length(column: pa.Array, block: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors of norm 1 as rows) of the vectors of each length, a block at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    starts = np.asarray(column.offsets).astype(np.int64)
    values, sizes = np.asarray(column.values, np.float64), np.diff(starts)
    for size in np.unique(sizes).tolist():
        same = np.flatnonzero(sizes == size)
        for at in range(0, len(same), block):
            some = same[at : at + block]
            x = values[starts[some][:, None] + np.arange(size)]
            yield some, x / np.linalg.norm(x, axis=1, keepdims=True)


def _dealt(distinct: DataFrame, tables: int, probes: int) -> DataFrame:
    """g (a bucket), id and the sketch (s0, s1) of every distinct vector and bucket of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(batch.schema.get_field_index("id")))
            for some, x in _by_length(batch.column(batch.schema.get_field_index("embedding"))):
                keys = _keys(x, tables, probes).reshape(-1, probes)
                new = np.column_stack([np.ones(len(keys), bool), np.diff(keys, axis=1) != 0])
                at, sketch = np.nonzero(new)[0] // tables, sketches(x).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[new]), pa.array(ids[some][at]), pa.array(sketch[at, 0]), pa.array(sketch[at, 1])], ["g", "id", "s0", "s1"])

    return distinct.select("id", "embedding").mapInArrow(run, "g long, id long, s0 long, s1 long")


def _likely(rows: DataFrame, cosine: float, tile: int) -> DataFrame:
    """Of the rows of :func:`_dealt`, dealt to work units, those that have another one in their unit whose sketch is near."""
    limit = most_apart(cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in tiles.whole_units(batches):
            s = np.column_stack([table.column(c).to_numpy() for c in ("s0", "s1")]).view(np.uint64)
            side, single = table.column("side").to_numpy(), table.column("lo").to_numpy() == table.column("hi").to_numpy()
            hit = np.zeros(len(s), bool)
            near = lambda i, j: np.bitwise_count(s[i] ^ s[j]).sum(-1, dtype=np.int64) <= limit  # noqa: E731, B023
            for i, j in tiles.pairs(cuts, side, single, np.zeros(len(s), np.int32), 0, near):
                hit[i] = hit[j] = True
            yield from table.select([*tiles.UNIT, "side", "id"]).filter(pa.array(hit)).to_batches()

    kinds = "g long, lo long, hi long, side boolean, id long"
    return tiles.dealt(rows.withColumn("p", F.lit(0)), 0, tile).select(*tiles.UNIT, "side", "id", "s0", "s1").mapInArrow(run, kinds)


def links(distinct: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, tile: int = 2048) -> DataFrame:
    """u, v, links: for every vector u that a work unit links, a vector v it is linked to (a forest of the unit's links) and how many rows' links are counted there."""
    dealt = written(_dealt(distinct, tables, probes), "buckets")
    likely = written(_likely(dealt, cosine, tile), "likely")
    rows = likely.join(distinct.select("id", "n", "embedding"), "id")
    rows = rows.repartition(shards(distinct.sparkSession), *tiles.UNIT).sortWithinPartitions(*tiles.UNIT, "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in tiles.whole_units(batches):
            side, single = table.column("side").to_numpy(), table.column("lo").to_numpy() == table.column("hi").to_numpy()
            g, ids, n = (table.column(c).to_numpy() for c in ("g", "id", "n"))
            vectors = table.column("embedding").combine_chunks()
            lengths = np.diff(np.asarray(vectors.offsets))
            x = np.zeros((len(ids), lengths.max(initial=1)))  # padded with zeros, which leaves products as they are
            for some, unit in _by_length(vectors):
                x[some, : unit.shape[1]] = unit
            keys = _Keys(ids, lengths, x, tables, probes)

            def near(i, j):
                if i.ndim == 2:
                    return x[i[:, 0]] @ x[j[0]].T >= cosine  # noqa: B023
                return np.einsum("ij,ij->i", x[i], x[j]) >= cosine  # noqa: B023

            total, a, b = np.zeros(len(ids), np.int64), [], []
            for i, j in tiles.pairs(cuts, side, single, np.zeros(len(ids), np.int32), 0, near):
                a.append(i)
                b.append(j)
                first = keys.first(i, j, g)
                np.add.at(total, i[first], n[j[first]])
                np.add.at(total, j[first], n[i[first]])
                if sum(map(len, a)) > 1 << 20:
                    root = forest(len(ids), np.concatenate(a), np.concatenate(b))
                    a, b = [np.arange(len(ids))], [root]
            if a:
                root = forest(len(ids), np.concatenate(a), np.concatenate(b))
                some = (root != np.arange(len(ids))) | (total > 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(total[some])], ["u", "v", "links"])

    return rows.select(*tiles.UNIT, "side", "id", "n", "embedding").mapInArrow(compare, "u long, v long, links long")


class _Keys:
    """The buckets of a batch's vectors, found once for each vector that has a link."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, x: np.ndarray, tables: int, probes: int):
        _, self.row, self.of = np.unique(ids, return_index=True, return_inverse=True)
        self.lengths, self.x, self.tables, self.probes = lengths, x, tables, probes
        self.known = np.zeros(len(self.row), bool)
        self.keys = np.zeros((len(self.row), tables, probes), np.int64)

    def _learn(self, some: np.ndarray) -> None:
        some = some[~self.known[some]]
        size = self.lengths[self.row[some]]
        for length in np.unique(size).tolist():
            same = some[size == length]
            for at in range(0, len(same), 2048):
                part = same[at : at + 2048]
                self.keys[part] = _keys(self.x[self.row[part], :length], self.tables, self.probes)
        self.known[some] = True

    def first(self, i: np.ndarray, j: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Which pairs, met in bucket g[i], have no earlier bucket in common."""
        a, b = self.of[i], self.of[j]
        self._learn(np.unique(np.concatenate([a, b])))
        first = np.zeros(len(i), bool)
        for at in range(0, len(i), 1 << 14):
            left = np.arange(at, min(at + (1 << 14), len(i)))
            for t in range(self.tables):
                if not len(left):
                    break
                one, two = self.keys[a[left], t], self.keys[b[left], t]
                same = (one[:, :, None] == two[:, None, :]).any(2)
                met = same.any(1)
                least = np.where(same, one, np.iinfo(np.int64).max).min(1)
                first[left[met & (least == g[i[left]])]] = True
                left = left[~met]
        return first


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, tile: int = 2048) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    kind = embeddings.schema["embedding"].dataType.simpleString()
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("embedding"))
    fine = F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("fine", fine)
    first = F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id")).alias("first")  # null ids last
    distinct = rows.where("fine").groupBy("embedding").agg(first, F.count(F.lit(1)).alias("n"))
    distinct = written(distinct.withColumn("id", F.monotonically_increasing_id()), "vectors")  # the number is stored, so it stays
    found = written(links(distinct, cosine, tables, probes, tile), "links")
    counts = found.groupBy(F.col("u").alias("id")).agg(F.sum("links").alias("links"))
    grouped = components(found.select("u", "v")).withColumnRenamed("node", "id")
    named = distinct.select("id", "first", "n").join(grouped, "id", "left").withColumn("component", F.coalesce("component", "id"))
    # A great component's vectors are dealt to several tasks; its name goes to each.
    least = named.groupBy("component").agg(F.min("first").alias("least")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = named.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    per = named.join(least, ["component", "salt"]).join(counts, "id", "left").select("id", F.col("least.vec_id").alias("component_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    per = per.join(distinct.select("id", "embedding"), "id").drop("id")
    linked = rows.where("fine").join(per, "embedding", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id")
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


SQL = """
WITH RECURSIVE vectors AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reached AS (SELECT vec_id AS u, vec_id AS w FROM vectors UNION SELECT reached.u, links.w FROM reached JOIN links ON links.u = reached.w),
least AS (SELECT u, min(w) AS component_id FROM reached GROUP BY u),
counted AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT l.u AS vec_id, coalesce(n, 0) AS n_links, component_id, l.u = component_id AS kept FROM least l LEFT JOIN counted USING (u)
"""

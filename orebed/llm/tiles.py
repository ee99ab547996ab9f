"""Comparing all rows of each group with each other, in tiles of bounded size.

A group of up to ``tile`` rows is one tile.  The rows of a larger group are
dealt to tiles by their order value and a hash of their id; each pair of tiles
whose order values may lie within the radius is a work unit of its own, keyed by
group and tile pair, so no task ever holds more than two tiles of a group, and
rows, not pairs of rows, are what is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stored import shards

UNIT = ("g", "lo", "hi")


def units(rows: DataFrame, radius: int, tile: int) -> DataFrame:
    """Rows of g (group), p (order value) and id, dealt to the work units (g, lo, hi); side tells the two tiles of a unit apart. A row alone in its group has nothing to be compared with and goes."""
    parts = rows.groupBy("g", "p").agg(F.count(F.lit(1)).alias("n"))
    groups = parts.groupBy("g").agg(F.sum("n").alias("n"), F.collect_list(F.struct("p", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))).alias("parts")).where("n > 1")
    rows = rows.join(groups.select("g", F.when(F.col("n") > tile, F.col("parts")).alias("parts")), "g")
    name = lambda p, s: p.cast("long") * (1 << 32) + s
    own = F.filter("parts", lambda x: x["p"] == F.col("p"))[0]["tiles"]
    rows = rows.withColumn("own", F.when(F.col("parts").isNotNull(), name(F.col("p"), F.pmod(F.xxhash64("id", F.lit(7)), own))))
    near = F.filter("parts", lambda x: F.abs(x["p"] - F.col("p")) <= radius)
    others = F.flatten(F.transform(near, lambda x: F.transform(F.sequence(F.lit(0), x["tiles"] - 1), lambda s: name(x["p"], s))))
    rows = rows.withColumn("other", F.explode(F.coalesce(others, F.array(F.lit(None).cast("long")))))
    rows = rows.withColumn("lo", F.coalesce(F.least("own", "other"), F.lit(-1))).withColumn("hi", F.coalesce(F.greatest("own", "other"), F.lit(-1)))
    return rows.withColumn("side", (F.col("own") == F.col("hi")) & (F.col("lo") != F.col("hi"))).withColumn("side", F.coalesce("side", F.lit(False))).drop("parts", "own", "other")


def dealt(rows: DataFrame, radius: int = 0, tile: int = 2048) -> DataFrame:
    """The work units, each whole in one partition and sorted."""
    return units(rows, radius, tile).repartition(shards(rows.sparkSession), *UNIT).sortWithinPartitions(*UNIT, "p", "id")


def whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole units, and where the units begin (the end last)."""
    held: list[pa.RecordBatch] = []
    last = None

    def out(table: pa.Table):
        keys = np.column_stack([table.column(k).to_numpy() for k in UNIT])
        return table, np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(batch.schema.get_field_index(k)).to_numpy() for k in UNIT])
        new = np.concatenate([[last is not None and not np.array_equal(last, keys[0])], (keys[1:] != keys[:-1]).any(1)])
        cuts = np.flatnonzero(new)
        if len(cuts):
            table = pa.Table.from_batches([*held, batch.slice(0, cuts[-1])])
            if table.num_rows:
                yield out(table.combine_chunks())
            held = [batch.slice(cuts[-1])]
        else:
            held.append(batch)
        last = keys[-1]
    if held:
        yield out(pa.Table.from_batches(held).combine_chunks())


def pairs(cuts: np.ndarray, side: np.ndarray, single: np.ndarray, p: np.ndarray, radius: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray], block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of one unit that ``near`` accepts, many at a time.

    Rows of a unit are sorted by p.  Small units are compared along their
    diagonals, all at once; large ones block by block, blocks whose p differ by
    more than the radius being skipped.  Where a unit has two tiles (not
    ``single``), only pairs across them count.
    """
    size = np.diff(cuts)
    unit = np.repeat(np.arange(len(size)), size)
    end = cuts[1:][unit]
    i = np.flatnonzero((size[unit] > 1) & (size[unit] <= 64))
    step = 1
    while len(i):
        i = i[i + step < end[i]]
        i = i[p[i + step] - p[i] <= radius]
        own = i[single[i] | (side[i] != side[i + step])]
        if len(own):
            hit = own[near(own, own + step)]
            if len(hit):
                yield hit, hit + step
        step += 1
    for u in np.flatnonzero(size > 64):
        for a in range(cuts[u], cuts[u + 1], block):
            one = np.arange(a, min(a + block, cuts[u + 1]))
            for b in range(a, cuts[u + 1], block):
                if p[b] - p[one[-1]] > radius:
                    break
                two = np.arange(b, min(b + block, cuts[u + 1]))
                hits = near(one[:, None], two[None, :])
                if not single[a]:
                    hits = hits & (side[one][:, None] != side[two][None, :])
                x, y = np.nonzero(hits)
                x, y = one[x], two[y]
                keep = x < y
                if keep.any():
                    yield x[keep], y[keep]

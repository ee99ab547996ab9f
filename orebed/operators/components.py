"""Connected components by alternating large-star and small-star rounds.

The edges are contracted piece by piece first, so that what lies together in
the table is linked before anything is shuffled.  Every round is a few shuffles
of the remaining edges, written to the shared folder, so neither a component nor the edges ever meet in one task or the
driver; only two numbers a round, which tell whether anything changed, do.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .stored import written

#: Edges of a node from which on its least neighbour is broadcast; there are at most twice the edges by this many such nodes.
HUB = 4096
#: Edges that a task contracts at once.
PIECE = 1 << 19


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger neighbours (large) or its smaller ones and itself (small) to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    # A hub's edges stay where they are and its least neighbour goes to them; all others meet theirs by a shuffle.
    hubs = least.where(F.col("n") > HUB).select("u", F.col("m").alias("hub"))
    marked = both.join(F.broadcast(hubs), "u", "left")
    met = marked.where("hub is null").select("u", "v").join(least.where(F.col("n") <= HUB).select("u", "m"), "u")
    joined = met.unionByName(marked.where("hub is not null").select("u", "v", F.col("hub").alias("m")))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges that reach the same nodes: of every piece of the table a link from each node to the least one that the piece's edges let it reach.  Ids other than whole numbers stay as they are."""
    if any(not isinstance(f.dataType, IntegralType) for f in edges.schema.fields):
        return edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
            if held and (batch is None or sum(b.num_rows for b in held) >= PIECE):
                piece = pa.Table.from_batches(held)
                u, v = (piece.column(c).to_numpy() for c in ("u", "v"))
                held = []
                names, places = np.unique(np.concatenate([u, v]), return_inverse=True)
                label = forest(len(names), places[: len(u)], places[len(u) :])
                moved = np.flatnonzero(label != np.arange(len(names)))
                yield pa.RecordBatch.from_arrays([pa.array(names[moved], piece.schema.field("u").type), pa.array(names[label[moved]], piece.schema.field("v").type)], ["u", "v"])

    return edges.select("u", "v").mapInArrow(run, edges.select("u", "v").schema)


def _told(edges: DataFrame):
    """Two numbers that change when the edges do."""
    return edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that can be reached) of every node with an edge, from u, v; order and repeats of edges do not matter."""
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = written(_contracted(edges).distinct(), "edges")
    before = _told(edges)
    while True:
        edges = written(_star(_star(edges, large=True), large=False), "edges")
        now = _told(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index each of n indices can reach over the links a - b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label

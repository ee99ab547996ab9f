"""Centroid clustering with Elkan's bounds, in exact integers.

Each vector carries, from round to round, its cluster, an upper bound of the
distance to its centroid and a lower bound for every centroid.  A centroid is
looked at only if neither its lower bound nor half the distance between the two
centroids rules it out.  Bounds are rounded to the safe side (lower ones down,
to single precision; upper ones up) and rule out only what lies strictly
beyond, so a centroid at equal distance is always compared, in integers, and
the smaller number wins: the result is that of the plain algorithm.

A round is one pass over the written rows and one aggregation of a row a
cluster; only the centroids (``k`` times ``dims`` numbers) reach the driver and
go to the tasks.  The rows of the round before are removed once the next are
written.

Defined results: vectors of another length, null ones and those with a null or
non-finite component are left out; so are those with an integer of over 2^25 in
size, whose squared distances 64-bit integers do not hold; a null id hashes as an
empty text; repeated ids and vectors are rows of their own, and of equal ids the
smaller vector starts first; with fewer vectors than ``k`` there are as many
centroids; sums that overflow a long are null; an empty table gives an empty
one; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stored import removed, written

DIMS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, "2"
WIDEST = 1 << 25
#: Relative margin of the bounds; an ulp of a double is 2.2e-16.
MARGIN = 1e-15

STATE = "vec_id long, v array<int>, cluster int, upper double, lower array<float>, distance long, looked long"


def integers(embeddings: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components as floor(scale * x), of the vectors that can be compared."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.select("vec_id", F.when((F.size(x) == dims) & finite, F.transform(x, lambda c: F.floor(c.cast("double") * scale))).alias("v"))
    return rows.where(F.forall("v", lambda c: F.abs(c) <= WIDEST)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<int>").alias("v"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: str = SEED) -> np.ndarray:
    """The k vectors of smallest hash."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in vectors.orderBy(place, "v").limit(k).collect()], np.int64)


def _down(x: np.ndarray) -> np.ndarray:
    return x * (1 - MARGIN)


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + MARGIN)


def _single(x: np.ndarray) -> np.ndarray:
    """Single precision, rounded down; never below 0, which is always a lower bound."""
    x = np.maximum(x, 0)
    out = x.astype(np.float32)
    return np.where(out > x, np.nextafter(out, np.float32(0)), out)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def assign(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, upper and lower bounds, exact squared distance and the number of distances worked out, of every row.

    The bounds given must hold for these centroids.
    """
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    distance, looked = np.full(len(v), -1, np.int64), np.zeros(len(v), np.int64)
    half = _down(np.sqrt(squared(centroids[:, None], centroids[None]).astype(np.float64)) / 2)

    def own(rows: np.ndarray) -> None:
        rows = rows[distance[rows] < 0]
        if len(rows):
            c = cluster[rows]
            distance[rows] = squared(v[rows], centroids[c])
            looked[rows] += 1
            root = np.sqrt(distance[rows].astype(np.float64))
            upper[rows], lower[rows, c] = _up(root), _single(_down(root))

    def open_to(j: int, rows: np.ndarray) -> np.ndarray:
        c = cluster[rows]
        return rows[(c != j) & (upper[rows] >= lower[rows, j]) & (upper[rows] >= half[c, j])]

    everyone = np.arange(len(v))
    for j in range(len(centroids)):
        rows = open_to(j, everyone)
        own(rows)
        rows = open_to(j, rows)  # the upper bound is tight now
        if not len(rows):
            continue
        d = squared(v[rows], centroids[j])
        looked[rows] += 1
        root = np.sqrt(d.astype(np.float64))
        lower[rows, j] = _single(_down(root))
        won = (d < distance[rows]) | ((d == distance[rows]) & (j < cluster[rows]))
        rows, d, root = rows[won], d[won], root[won]
        cluster[rows], distance[rows], upper[rows] = j, d, _up(root)
    own(everyone)
    return cluster, upper, lower, distance, looked


def _round(rows: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """The rows assigned to the centroids; their bounds hold for those ``before``, if there were any."""
    k, dims = centroids.shape
    moved = None if before is None else _up(np.sqrt(squared(centroids, before).astype(np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            flat = column("v").flatten()
            v = flat.to_numpy().reshape(n, dims).astype(np.int64)
            if moved is None:
                cluster, lower = np.zeros(n, np.int64), np.zeros((n, k), np.float32)
                upper = np.full(n, np.inf)
            else:
                cluster = column("cluster").to_numpy().astype(np.int64)
                upper = _up(column("upper").to_numpy() + moved[cluster])
                # One subtraction in doubles is off by half an ulp of its result, less than the margin.
                lower = _single(_down(column("lower").flatten().to_numpy().reshape(n, k).astype(np.float64) - moved))
            cluster, upper, lower, distance, looked = assign(v, cluster, upper, lower, centroids)
            bounds = pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(lower.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([column("vec_id"), column("v"), pa.array(cluster, pa.int32()), pa.array(upper), bounds, pa.array(distance), pa.array(looked)], ["vec_id", "v", "cluster", "upper", "lower", "distance", "looked"])

    return rows.mapInArrow(run, STATE)


def _means(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of the mean of each cluster's vectors; an empty cluster's centroid stays."""
    dims = centroids.shape[1]
    sums = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(dims)))
    out = centroids.copy()
    for r in sums.collect():  # a row a centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return out


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, list[np.ndarray]]:
    """The rows of vec_id and v with their cluster, bounds, squared distance and the distances looked at in the last pass; the centroids of every pass."""
    rows = written(vectors, "vectors")
    seen = [first_centroids(rows, k, seed)]
    if not len(seen[0]):
        none = [F.lit(None).cast(t).alias(c) for c, t in (f.split(" ") for f in STATE.split(", ")[2:])]
        return rows.select("vec_id", "v", *none).limit(0), seen
    for turn in range(rounds + 1):
        after = written(_round(rows, seen[-1], seen[-2] if turn else None), "assigned")
        removed(rows)
        rows = after
        if turn < rounds:
            seen.append(_means(rows, seen[-1]))
    return rows, seen


def elkan_clusters(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows, seen = clustered(integers(embeddings), k, rounds, seed)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in seen[-1].tolist()]
    per = rows.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))  # at most a row a centroid
    whole = per.agg(F.try_sum("cluster_inertia").alias("inertia"))
    digest = F.element_at(F.array(*map(F.lit, digests)), F.col("cluster") + 1) if digests else F.lit(None).cast("string")
    totals = per.crossJoin(F.broadcast(whole)).select("cluster", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))
    return rows.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    steps = [
        f"""
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS j, v AS c
  FROM kept QUALIFY j < {k})"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS (
  SELECT rid, min(row(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, j)) AS best
  FROM kept, c{r} GROUP BY rid)"""
        )
        if r < rounds:
            steps.append(
                f"""m{r} AS (
  SELECT best[2] AS j, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS x
  FROM a{r} JOIN kept USING (rid), range(1, {DIMS + 1}) t(i) GROUP BY ALL),
c{r + 1} AS (
  SELECT j, coalesce(any_value(n.c), any_value(c{r}.c)) AS c
  FROM c{r} LEFT JOIN (SELECT j, list(x ORDER BY i) AS c FROM m{r} GROUP BY j) n USING (j) GROUP BY j)"""
            )
    return (
        ",\n".join(steps)
        + f"""
SELECT vec_id, best[2]::INT AS cluster, best[1] AS distance, sum(best[1]) OVER (PARTITION BY best[2])::BIGINT AS cluster_inertia,
  sum(best[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (rid) JOIN c{rounds} ON c{rounds}.j = best[2]
"""
    )


SQL = _sql()

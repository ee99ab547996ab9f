"""Neighbour searches without a tree: points are bucketed in grid cells.

A radius search looks into the cells around a target, joined on the cell, which
is exact.  A k-nearest search brings the targets of a cube of cells together with
the points of the cube and of the cells around it, and looks through the cells
there with numpy, many targets at a time; the cube is as large as it takes for a
group to have some thousand targets.  It widens the radius for the targets that
have not found k points within it yet, so the k-th neighbour is proven, and each
widening works on the remaining targets only.  A cube's targets are dealt to
groups of bounded size; a cube with very many points around it is taken cell by
cell, and such a cell is joined instead, row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import shards, written

AXES = ("x", "y", "z")


def _cells(df: DataFrame, size: float, axes=AXES) -> DataFrame:
    return df.withColumns({f"_{a}": F.floor(F.col(a) / size).cast("long") for a in axes})


def _around(df: DataFrame, size: float, axes=AXES) -> DataFrame:
    out = _cells(df, size, axes)
    for a in axes:
        out = out.withColumn(f"_{a}", F.explode(F.array(*(F.col(f"_{a}") + k for k in (-1, 0, 1)))))
    return out


def within(targets: DataFrame, points: DataFrame, radius: float, target_id: str, point_id: str, values: list[str] = (), axes=AXES, spread: str = "targets") -> DataFrame:
    """target, point, distance (and the point's values) of all pairs within ``radius``.

    ``spread`` says which side is copied to the cells around its own: the one
    with fewer rows should be.
    """
    left, right = targets.select(F.col(target_id).alias("target"), *axes), points.select(F.col(point_id).alias("point"), *axes, *values)
    left, right = (_around(left, radius, axes), _cells(right, radius, axes)) if spread == "targets" else (_cells(left, radius, axes), _around(right, radius, axes))
    left = left.withColumnsRenamed({a: f"t_{a}" for a in axes})
    distance = F.sqrt(reduce(lambda p, q: p + q, ((F.col(f"t_{a}") - F.col(a)) * (F.col(f"t_{a}") - F.col(a)) for a in axes)))
    return left.join(right, [f"_{a}" for a in axes]).withColumn("distance", distance).where(F.col("distance") <= radius).select("target", "point", "distance", *values)


def pairs(points: DataFrame, radius: float, point_id: str, values: list[str] = (), axes=AXES) -> DataFrame:
    """i, j (i < j), the components d_<axis> and the values v_i, v_j of all pairs within ``radius``.

    A point meets those of its own cell and of the cells on one side of it, so
    each pair of cells is joined once.
    """
    ahead = [o for o in product((-1, 0, 1), repeat=len(axes)) if o >= (0,) * len(axes)]
    own = _cells(points.select(F.col(point_id).alias("_id"), *axes, *values), radius, axes)
    offsets = F.array(*(F.struct(*(F.lit(d).alias(a) for a, d in zip(axes, o)), F.lit(not any(o)).alias("same")) for o in ahead))
    left = own.withColumn("_o", F.explode(offsets)).withColumns({f"_{a}": F.col(f"_{a}") + F.col(f"_o.{a}") for a in axes}).withColumn("_same", F.col("_o.same")).drop("_o")
    left = left.withColumnsRenamed({c: f"{c}_p" for c in ("_id", *axes, *values)})
    both = left.join(own.withColumnsRenamed({c: f"{c}_q" for c in ("_id", *axes, *values)}), [f"_{a}" for a in axes])
    both = both.where((F.col("_id_p") < F.col("_id_q")) | (~F.col("_same") & (F.col("_id_p") != F.col("_id_q"))))
    first = F.col("_id_p") < F.col("_id_q")
    both = both.withColumns({f"d_{a}": F.when(first, F.col(f"{a}_q") - F.col(f"{a}_p")).otherwise(F.col(f"{a}_p") - F.col(f"{a}_q")) for a in axes})
    distance = F.sqrt(reduce(lambda p, q: p + q, (F.col(f"d_{a}") * F.col(f"d_{a}") for a in axes)))
    ends = [F.when(first, F.col(f"{c}_p")).otherwise(F.col(f"{c}_q")).alias(f"{n}i") for c, n in (("_id", ""), *((v, f"{v}_") for v in values))]
    ends += [F.when(first, F.col(f"{c}_q")).otherwise(F.col(f"{c}_p")).alias(f"{n}j") for c, n in (("_id", ""), *((v, f"{v}_") for v in values))]
    return both.withColumn("distance", distance).where(F.col("distance") <= radius).select(*ends, *(f"d_{a}" for a in axes), "distance")


#: Rows of either side in a group of :func:`met`, on average at most, and pairs that are looked at at once.
MEETING, BLOCK = 16_384, 1 << 15


def finite(df: DataFrame, axes=AXES) -> DataFrame:
    """The rows whose coordinates are all known and finite; others are within no distance."""
    return df.where(reduce(lambda p, q: p & q, (F.abs(F.col(a).cast("double")) < float("inf") for a in axes)))


def met(left: DataFrame, right: DataFrame, keys: list[str], meet: Callable, schema: str) -> DataFrame:
    """The rows that ``meet(left, right)`` makes of the rows that agree in ``keys``, as two data frames of bounded size.

    The rows of a key are dealt to parts on both sides, and each part of one side
    meets each part of the other, so ``meet`` has to give what can be added up.
    """
    sizes = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")).join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys)
    parts = written(sizes.select(*keys, F.ceil(F.col("_m") / MEETING).alias("_lefts"), F.ceil(F.col("_n") / MEETING).alias("_rights")), "meetings")

    def dealt(df: DataFrame, own: str, others: str, at: str, other: str) -> DataFrame:
        rows = df.join(parts, keys).withColumn(at, F.pmod(F.xxhash64(*df.columns), F.col(own)))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1))).drop("_lefts", "_rights")

    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # its own columns, if both sides come from one table
    group = [*keys, "_l", "_r"]
    names = [c.split()[0] for c in schema.split(", ")]

    def together(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return meet(a, b) if len(a) and len(b) else pd.DataFrame(columns=names)

    return dealt(left, "_lefts", "_rights", "_l", "_r").groupBy(*group).cogroup(dealt(right, "_rights", "_lefts", "_r", "_l").groupBy(*group)).applyInPandas(together, schema)


def near_pairs(a: np.ndarray, b: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``a`` (ascending), in ``b`` (ascending for each) and distances of the pairs within ``radius``, about a block of candidates at a time."""
    n, step = len(b), max(1, BLOCK // len(b))
    others = [np.ascontiguousarray(b[:, k]) for k in range(b.shape[1])]
    square, off = np.empty((step, n)), np.empty((step, n))
    for at in range(0, len(a), step):
        some = a[at : at + step]
        total, part = square[: len(some)], off[: len(some)]
        np.subtract.outer(some[:, 0], others[0], out=total)
        total *= total
        for k in range(1, len(others)):
            np.subtract.outer(some[:, k], others[k], out=part)
            part *= part
            total += part
        flat = np.flatnonzero(total.ravel() <= radius * radius * (1 + 1e-12))
        distance = np.sqrt(total.ravel()[flat])
        inside = distance <= radius
        i, j = np.divmod(flat if inside.all() else flat[inside], n)
        yield i + at, j, distance[inside]


def _placed(df: DataFrame, axes, *more) -> DataFrame:
    return finite(df, axes).select(*(F.col(a).cast("double").alias(a) for a in axes), *more)


def _beside(left: DataFrame, places: DataFrame, axes=AXES) -> DataFrame:
    """The rows of ``left`` with what was found for their place, null where nothing was."""
    found = places.withColumnsRenamed({a: f"_p{a}" for a in axes})
    return left.join(found, [F.col(a).cast("double") == F.col(f"_p{a}") for a in axes], "left").drop(*(f"_p{a}" for a in axes))


def kernel(targets: DataFrame, events: DataFrame, radius: float, weight: str, power: float, by: str | None = None, axes=AXES) -> DataFrame:
    """axes, by, _v: the sum of weight / (distance + 1e-6) ** power over the events in reach of each place that has a target (and each value of ``by``, not null).

    Targets at one place are one row.  The places are copied to the cells
    around theirs and meet a cell's events there as matrices; what leaves a group
    is a sum a place and value, however many the events are.
    """
    places = _around(_placed(targets, axes).distinct(), radius, axes)
    rows = _cells(_placed(events, axes, F.col(weight).cast("double").alias("_w"), *([by] if by else [])).where("_w is not null"), radius, axes)
    schema = ", ".join([*(f"{a} double" for a in axes), *([f"{by} {events.schema[by].dataType.simpleString()}"] if by else []), "_v double"])

    def meet(part: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(near[by]) if by else (np.zeros(len(near), np.int64), [None])
        w, n = near["_w"].to_numpy(float), len(names)
        made = []
        for i, j, d in near_pairs(part[list(axes)].to_numpy(float), near[list(axes)].to_numpy(float), radius):
            if len(i):
                at = (i - i[0]) * n + codes[j]
                some = np.flatnonzero(np.bincount(at))
                out = part[list(axes)].iloc[i[0] + some // n].reset_index(drop=True)
                if by:
                    out[by] = np.asarray(names)[some % n]
                made.append(out.assign(_v=np.bincount(at, w[j] / (d + 1e-6) ** power)[some]))
        return pd.concat(made, ignore_index=True) if made else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

    return met(places, rows, [f"_{a}" for a in axes], meet, schema).groupBy(*axes, *([by] if by else [])).agg(F.sum("_v").alias("_v"))


def tallied(points: DataFrame, radius: float, point_id: str, values: list[str], tally: Callable, columns: list[str], axes=AXES) -> DataFrame:
    """lag and sums of ``columns`` over all pairs of points within ``radius``; no pair is ever a row.

    ``tally(first, second, off, distance, copies)`` gets the values (one array a
    column), components and distances of many pairs and how many pairs of points
    each stands for, and returns arrays of a row a column and an entry a lag, from
    lag 0 on.  Rows alike in place and values are one row with a number from here
    on; all their pairs count.  A point does not pair with rows of its own id.
    """
    known = points.where(F.col(point_id).isNotNull())
    again = known.groupBy(point_id).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n").withColumn("_again", F.monotonically_increasing_id())
    again = written(again, "again")
    rows = known if again.isEmpty() else known.join(again, point_id, "left")
    rows = _placed(rows, axes, *(F.col(v).cast("double").alias(v) for v in values), (F.lit(None).cast("long") if rows is known else F.col("_again")).alias("_again"))
    rows = rows.groupBy(*axes, *values, "_again").agg(F.count(F.lit(1)).cast("double").alias("_c"))
    own = _cells(written(rows.select(*axes, *values, "_c", F.coalesce("_again", F.lit(-1)).alias("_again"), F.monotonically_increasing_id().alias("_id")), "places"), radius, axes)
    ahead = [o for o in product((-1, 0, 1), repeat=len(axes)) if o >= (0,) * len(axes)]
    offsets = F.array(*(F.struct(*(F.lit(d).alias(a) for a, d in zip(axes, o)), F.lit(not any(o)).alias("same")) for o in ahead))
    left = own.withColumn("_o", F.explode(offsets)).withColumns({f"_{a}": F.col(f"_{a}") + F.col(f"_o.{a}") for a in axes}).withColumn("_same", F.col("_o.same")).drop("_o")

    def meet(part: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        p, q = part[list(axes)].to_numpy(float), near[list(axes)].to_numpy(float)
        u, v = ([side[c].to_numpy(float) for c in values] for side in (part, near))
        (c, ids, again_), (e, jds, bgain) = ([side[n].to_numpy() for n in ("_c", "_id", "_again")] for side in (part, near))
        same, sums = part["_same"].to_numpy(bool), 0.0
        for i, j, d in near_pairs(p, q, radius):
            keep = np.flatnonzero(~same[i] | (ids[i] <= jds[j]))
            i, j, d = i[keep], j[keep], d[keep]
            alike = same[i] & (ids[i] == jds[j])
            copies = np.where(alike, c[i] * (c[i] - 1) / 2, c[i] * e[j])
            copies[(again_[i] >= 0) & (again_[i] == bgain[j])] = 0.0
            sums = sums + tally([x[i] for x in u], [x[j] for x in v], [q[j, k] - p[i, k] for k in range(len(axes))], d, copies)
        some = np.flatnonzero(sums[0])
        return pd.DataFrame({"lag": some, **{n: row[some] for n, row in zip(columns, sums)}})

    return met(left, own, [f"_{a}" for a in axes], meet, ", ".join(["lag long", *(f"{n} double" for n in columns)])).groupBy("lag").agg(*(F.sum(n).alias(n) for n in columns))


def reach_of(box: tuple, k: int) -> float:
    """A radius that holds about 2 k of the rows where they are spread evenly over their box (their number, then its sides)."""
    sides = [v for v in box[1:] if v]
    if not box[0] or not sides:
        return 1.0
    volume = reduce(lambda p, q: p * q, sides)
    unit_ball = {1: 2.0, 2: 3.14159, 3: 4.18879}[len(sides)]
    return max((2 * k * volume / box[0] / unit_ball) ** (1 / len(sides)), 1e-6)


#: Targets that a group should have, points around it from which on it is taken cell by cell (and a cell row by row), and cells of a group along an axis at most.
GROUP_TARGETS, DENSE, WIDEST = 4096, 50_000, 1024


def k_smallest(targets: np.ndarray, points: np.ndarray, k: int, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each target the places of its k nearest points in order (of equally near ones the first), their distances, and how many lie within the radius (k at most)."""
    m, take = len(targets), min(k, len(points))
    at, far, found = np.zeros((m, take), np.int64), np.full((m, take), np.inf), np.zeros(m, np.int64)
    if not take:
        return at, far, found
    for a in range(0, m, max(1, (1 << 21) // len(points))):
        some = slice(a, min(m, a + max(1, (1 << 21) // len(points))))
        off = targets[some, None, :] - points[None]
        distance = np.sqrt(np.einsum("ijk,ijk->ij", off, off))
        distance[~(distance <= radius)] = np.inf
        if take < len(points):
            pick = np.sort(np.argpartition(distance, take - 1, axis=1)[:, :take], axis=1)
            last = np.take_along_axis(distance, pick, 1).max(1, keepdims=True)
            tied = np.flatnonzero((distance <= last).sum(1) > take)  # the choice among equals is by place
            if len(tied):
                pick[tied] = np.argsort(distance[tied], axis=1, kind="stable")[:, :take]
        else:
            pick = np.broadcast_to(np.arange(take), distance.shape)
        near = np.take_along_axis(distance, pick, 1)
        order = np.lexsort((pick, near), axis=1)
        at[some], far[some] = np.take_along_axis(pick, order, 1), np.take_along_axis(near, order, 1)
        found[some] = np.isfinite(far[some]).sum(1)
    return at, far, found


def k_nearest(targets: np.ndarray, target_cells: np.ndarray, points: np.ndarray, point_cells: np.ndarray, k: int, radius: float, pairs: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`k_smallest`, looking only into the cells (of side ``radius``) around each target; about ``pairs`` candidates at a time."""
    m, take = len(targets), min(k, len(points))
    at, far, found = np.zeros((m, take), np.int64), np.full((m, take), np.inf), np.zeros(m, np.int64)
    if not take or not m:
        return at, far, found
    base = np.minimum(target_cells.min(0), point_cells.min(0)) - 1
    spans = np.maximum(target_cells.max(0), point_cells.max(0)) - base + 2
    name = lambda cells: np.ravel_multi_index(tuple((cells - base).T), spans)
    keys = name(point_cells)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    # Cells that differ in the last axis only are neighbours in the order: a target's cells are a few runs.
    d = target_cells.shape[1]
    aside = np.array(list(product((-1, 0, 1), repeat=d - 1)), np.int64).reshape(3 ** (d - 1), d - 1)
    beside = np.concatenate([aside, np.zeros((len(aside), 1), np.int64)], 1)
    middle = name((target_cells[:, None] + beside[None]).reshape(-1, d)).reshape(m, -1)
    low, high = np.searchsorted(keys, middle - 1), np.searchsorted(keys, middle + 1, side="right")
    # Where many targets share a cell its points are gathered once, else a target's candidates are listed one by one.
    home = np.argsort(middle[:, 0], kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(middle[home, 0]) != 0]))
    many = np.diff(np.append(starts, m)) >= SHARING
    for s, e in zip(starts[many], np.append(starts, m)[1:][many]):
        some = home[s:e]
        place = np.sort(np.concatenate([order[x:y] for x, y in zip(low[some[0]], high[some[0]])]))
        pick, far_, found[some] = k_smallest(targets[some], points[place], k, radius)
        if pick.shape[1]:
            at[some, : pick.shape[1]], far[some, : pick.shape[1]] = place[pick], far_
    alone = np.sort(np.concatenate([home[s:e] for s, e in zip(starts[~many], np.append(starts, m)[1:][~many])])) if (~many).any() else home[:0]
    at[alone], far[alone], found[alone] = _listed(targets[alone], points, order, low[alone], high[alone], take, radius, pairs)
    return at, far, found


#: Targets of a cell from which on its candidates are compared as one matrix.
SHARING = 24


def _listed(targets: np.ndarray, points: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, take: int, radius: float, pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`k_smallest`, of candidates order[low:high] of each target (several runs a target)."""
    m = len(targets)
    at, far, found = np.zeros((m, take), np.int64), np.full((m, take), np.inf), np.zeros(m, np.int64)
    upto = np.cumsum((high - low).sum(1))
    a = 0
    while a < m:
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + pairs, side="right")))
        n = (high[a:b] - low[a:b]).ravel()
        place = order[np.repeat(low[a:b].ravel() - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        who = np.repeat(np.repeat(np.arange(b - a), low.shape[1]), n)
        off = targets[a:b][who] - points[place]
        distance = np.sqrt(np.einsum("ij,ij->i", off, off))
        near = np.flatnonzero(distance <= radius)
        near = near[np.lexsort((place[near], distance[near], who[near]))]
        who = who[near]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        first = rank < take
        near, who, rank = near[first], who[first], rank[first]
        at[a + who, rank], far[a + who, rank] = place[near], distance[near]
        found[a:b] = np.bincount(who, minlength=b - a)
        a = b
    return at, far, found


def least_at_places(points: DataFrame, k: int, point_id: str, axes=AXES) -> DataFrame:
    """The ``k`` rows of the least ids of each place, which are all that a search of k neighbours can find there; rows without a place are left out."""
    order = Window.partitionBy(*(F.col(a).cast("double") for a in axes)).orderBy(point_id)
    return finite(points, axes).withColumn("_copy", F.row_number().over(order)).where(F.col("_copy") <= k).drop("_copy")


def searched(targets: DataFrame, points: DataFrame, k: int, start_radius: float | None, target_id: str, point_id: str, values: list[str], emit: Callable, schema: str, max_radius: float | None = None, rounds: int = 12, axes=AXES) -> DataFrame:
    """The rows that ``emit`` makes of targets and their k nearest points.

    ``emit(targets, points, at, distance, found)`` gets a data frame of targets
    (target and axes), one of points (point, axes, values), the places of each
    target's neighbours, their distances and their number, and returns a data
    frame that has ``schema``.  Targets with fewer than k points within
    ``max_radius`` come with those they have; without it all come with k points
    where the table has that many.  The radius doubles for the targets that are
    left, and after ``rounds`` rounds grows eightfold, until it is ``max_radius``
    or the joint extent of targets and points.  A round's targets are written, so
    that no round runs twice and plans stay short.  Of the points at one place
    only the k of the least ids are searched, so that copies of a place do not make
    a group dense.
    """
    left = targets.select(F.col(target_id).alias("target"), *(F.col(a).cast("double").alias(a) for a in axes))
    own = points.select(F.col(point_id).alias("point"), *(F.col(a).cast("double").alias(a) for a in axes), *values)
    own = written(least_at_places(own, k, "point", axes), "points")
    box = _Box.of(own, axes)
    radius, limit, step, out = start_radius or reach_of(box, k), max_radius, 0, []
    while True:
        radius = radius if limit is None else min(radius, limit)
        last = limit is not None and radius >= limit
        side = _side(_Box.of(left, axes), box, radius, shards(left.sparkSession))
        hits = _gathered(left, own, k, radius, values, emit, schema, last, axes, side)
        if last:
            out.append(hits.where("not _open").drop("_open", "_target"))
            break
        hits = written(hits, "hits")
        out.append(hits.where("not _open").drop("_open", "_target"))
        left = written(left.join(hits.where("_open").select(F.col("_target").alias("target")), "target", "left_semi"), "left")
        if left.isEmpty():
            break
        if limit is None:
            limit = max(_extent(targets, points, axes), radius)
        step += 1
        radius *= 2 if step < rounds else 8
    return reduce(DataFrame.unionByName, out)


class _Box(tuple):
    """Number of rows and sides of the box around the finite ones."""

    @classmethod
    def of(cls, rows: DataFrame, axes) -> "_Box":
        finite = [F.when(F.abs(F.col(a)) < float("inf"), F.col(a)) for a in axes]
        n, *sides = rows.agg(F.count(F.lit(1)), *(F.max(a) - F.min(a) for a in finite)).first()
        return cls((n, *(float(v or 0) for v in sides)))

    def a_cell(self, size: float) -> float:
        """Rows of a cell of the size, on average over the box."""
        return self[0] / reduce(lambda p, q: p * q, (v / size + 1 for v in self[1:]))


def _side(targets: _Box, points: _Box, radius: float, n: int) -> int:
    """Cells along a group's axis, for groups of some thousand targets, as far as the points around them stay few on average."""
    axes = len(targets) - 1
    aim = min(GROUP_TARGETS, max(1024, targets[0] // (2 * n)))
    wanted = (aim / max(targets.a_cell(radius), 1e-9)) ** (1 / axes)
    most = (DENSE / 4 / max(points.a_cell(radius), 1e-9)) ** (1 / axes) - 2
    return int(max(1, min(wanted, most, WIDEST)))


def _gathered(left: DataFrame, points: DataFrame, k: int, radius: float, values: list[str], emit: Callable, schema: str, last: bool, axes, side: int) -> DataFrame:
    """The rows that ``emit`` makes of the targets that have k points within ``radius`` (all targets in the last round), and a row with _open and _target for each other target.

    Targets are grouped by cubes of ``side`` cells of the radius, which bring
    their points and those of the cells around them once; a cube of too many
    targets is dealt to several groups, one with too many points is taken apart.
    """
    cells, cubes = [f"_{a}" for a in axes], [f"_c{a}" for a in axes]
    rows, own = _cells(left, radius, axes), _cells(points, radius, axes)
    rows = rows.withColumns({c: F.floor(F.col(a) / side).cast("long") for c, a in zip(cubes, cells)})
    around = own
    for c, a in zip(cubes, cells):
        around = around.withColumn(c, F.explode(F.array_distinct(F.array(*(F.floor((F.col(a) + i) / side).cast("long") for i in (-1, 0, 1))))))
    sizes = rows.groupBy(*cubes).agg(F.count(F.lit(1)).alias("_m")).join(around.groupBy(*cubes).agg(F.count(F.lit(1)).alias("_s")), cubes, "left")
    parts = written(sizes.select(*cubes, F.ceil(F.col("_m") / GROUP_TARGETS).cast("int").alias("_parts"), (F.coalesce("_s", F.lit(0)) > DENSE).alias("_dense")), "parts")
    rows = rows.join(parts, cubes)
    dense, rows = rows.where("_dense"), rows.where("not _dense").withColumn("_part", F.pmod(F.xxhash64("target"), F.col("_parts")).cast("int"))
    around = around.join(parts.where("not _dense").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts", "_dense"), cubes)
    kind = left.schema["target"].dataType.simpleString()
    names = [c.split()[0] for c in schema.split(", ")]

    def answer(part: pd.DataFrame, near: pd.DataFrame, at: np.ndarray, far: np.ndarray, found: np.ndarray) -> pd.DataFrame:
        ready = np.ones(len(part), bool) if last else found == k
        done = emit(part[ready], near, at[ready], far[ready], found[ready])
        done = done.assign(_open=False, _target=None)
        wait = pd.DataFrame({"_open": True, "_target": part["target"][~ready]})
        return pd.concat([done, wait.reindex(columns=done.columns)] if len(wait) else [done], ignore_index=True)[[*names, "_open", "_target"]]

    def together(key, part: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame(columns=[*names, "_open", "_target"])
        near = near.sort_values("point", ignore_index=True)
        return answer(part, near, *k_nearest(part[list(axes)].to_numpy(float), part[cells].to_numpy(np.int64), near[list(axes)].to_numpy(float), near[cells].to_numpy(np.int64), k, radius))

    wide = f"{schema}, _open boolean, _target {kind}"
    out = rows.select("target", *axes, *cells, *cubes, "_part").groupBy(*cubes, "_part").cogroup(around.select("point", *axes, *values, *cells, *cubes, "_part").groupBy(*cubes, "_part")).applyInPandas(together, wide)
    if parts.where("_dense").isEmpty():
        return out
    if side > 1:
        return out.unionByName(_gathered(dense.select("target", *axes), points, k, radius, values, emit, schema, last, axes, 1))
    # So many points around a cell: the k nearest by a join and a window, then each target by itself.
    order = Window.partitionBy("target").orderBy("distance", "point")
    wanted = dense.select("target", *axes)
    hits = within(wanted, points, radius, "target", "point", [*values, *axes], axes).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    item = F.struct("distance", "point", *axes, *values)
    listed = wanted.join(hits.groupBy("target").agg(F.array_sort(F.collect_list(item)).alias("near")), "target", "left")

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                part, near = batch.iloc[[i]][["target", *axes]].reset_index(drop=True), batch["near"].iloc[i]
                near = pd.DataFrame([r if isinstance(r, dict) else r.asDict() for r in (near if near is not None else [])], columns=["distance", "point", *axes, *values]).sort_values("point", ignore_index=True)
                yield answer(part, near, *k_smallest(part[list(axes)].to_numpy(float), near[list(axes)].to_numpy(float), k, radius))

    return out.unionByName(listed.select("target", *axes, "near").mapInPandas(alone, wide))


def nearest(targets: DataFrame, points: DataFrame, k: int, start_radius: float | None, target_id: str, point_id: str, values: list[str] = (), max_radius: float | None = None, rounds: int = 12, axes=AXES) -> DataFrame:
    """target, point, distance, values and rank of the k nearest points of every target (ties by point id), as :func:`searched` finds them."""
    values = list(values)
    kinds = points.schema
    schema = ", ".join([f"target {targets.schema[target_id].dataType.simpleString()}", f"point {kinds[point_id].dataType.simpleString()}", "distance double", *(f"{v} {kinds[v].dataType.simpleString()}" for v in values), "rank int"])

    def emit(part, near, at, distance, found):
        who = np.repeat(np.arange(len(part)), found)
        place = np.arange(len(who)) - np.repeat(np.cumsum(found) - found, found)
        picked = near.iloc[at[who, place]]
        return pd.DataFrame({"target": part["target"].to_numpy()[who], "point": picked["point"].to_numpy(), "distance": distance[who, place], **{v: picked[v].to_numpy() for v in values}, "rank": (place + 1).astype(np.int32)})

    return searched(targets, points, k, start_radius, target_id, point_id, values, emit, schema, max_radius, rounds, axes)


def _extent(targets: DataFrame, points: DataFrame, axes=AXES) -> float:
    """A distance that no target and point exceed; coordinates that are not finite are left out, as they are within no distance."""
    both = targets.select(*axes).union(points.select(*axes))
    finite = [F.when(F.abs(F.col(a)) < float("inf"), F.col(a)) for a in axes]
    sides = both.agg(*(F.max(a) - F.min(a) for a in finite)).first()
    return sum(float(v or 0) ** 2 for v in sides) ** 0.5 * (1 + 1e-9)


def inverse_distance(neighbours: DataFrame, value: str, power: float = 2.0) -> DataFrame:
    """Estimate of each target from its neighbours; a point at the target decides."""
    w = F.pow(F.greatest(F.col("distance"), F.lit(1e-10)), F.lit(-float(power)))
    return neighbours.groupBy("target").agg((F.sum(w * F.col(value)) / F.sum(w)).alias("estimate"), F.count(F.lit(1)).alias("n"), F.min("distance").alias("nearest"))


def classified(blocks: DataFrame, samples: DataFrame, rules: list[tuple[str, float, int]], block_id: str, hole: str) -> DataFrame:
    """Class of each block by the first rule (name, radius, distinct holes) it meets, else "Unclassified".

    Blocks at one place are one row.  As many of the nearest holes as the widest
    rule counts leave a group for each place: those of the whole are among them.
    """
    widest, most = max(r for _, r, _ in rules), max(max(n for _, _, n in rules), 1)
    places = _around(_placed(blocks, AXES).distinct(), widest)
    rows = _cells(_placed(samples, AXES, F.col(hole).cast("string").alias("_hole")).distinct(), widest)

    def meet(part: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(near["_hole"], use_na_sentinel=False)
        order = np.argsort(codes, kind="stable")
        own = codes[order]
        made = []
        for i, j, d in near_pairs(part[list(AXES)].to_numpy(float), near[list(AXES)].to_numpy(float)[order], widest):
            if not len(i):
                continue
            first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (own[j[1:]] != own[j[:-1]])]))
            i, hole_, d = i[first], own[j[first]], np.minimum.reduceat(d, first)
            by_distance = np.lexsort((d, i))
            i, hole_, d = i[by_distance], hole_[by_distance], d[by_distance]
            some = np.flatnonzero(np.arange(len(i)) - np.searchsorted(i, i) < most)
            made.append(part[list(AXES)].iloc[i[some]].reset_index(drop=True).assign(_hole=np.asarray(names, object)[hole_[some]], _d=d[some]))
        return pd.concat(made, ignore_index=True) if made else pd.DataFrame(columns=[*AXES, "_hole", "_d"])

    hits = met(places, rows, [f"_{a}" for a in AXES], meet, "x double, y double, z double, _hole string, _d double").groupBy(*AXES, "_hole").agg(F.min("_d").alias("d"))
    counts = hits.groupBy(*AXES).agg(*(F.count(F.when(F.col("d") <= r, 1)).alias(f"_n{i}") for i, (_, r, _) in enumerate(rules)), F.min("d").alias("nearest"))
    named = reduce(lambda c, i: c.when(F.coalesce(F.col(f"_n{i}"), F.lit(0)) >= rules[i][2], rules[i][0]), range(1, len(rules)), F.when(F.coalesce(F.col("_n0"), F.lit(0)) >= rules[0][2], rules[0][0]))
    return _beside(blocks.select(block_id, *AXES), counts).select(block_id, "nearest", named.otherwise("Unclassified").alias("class"))


def hole_spacing(samples: DataFrame, hole: str, k: int, start_radius: float) -> DataFrame:
    """Mean over holes of the distance between a hole's centre and the k-th nearest other hole's."""
    centres = samples.groupBy(hole).agg(*(F.avg(a).alias(a) for a in AXES))
    near = nearest(centres, centres.withColumnRenamed(hole, "other"), k + 1, start_radius, hole, "other")
    return near.where(F.col("target") != F.col("point")).withColumn("r", F.row_number().over(Window.partitionBy("target").orderBy("distance", "point"))).where(F.col("r") == k).agg(F.count(F.lit(1)).alias("holes"), F.avg("distance").alias("spacing"))


def kernel_sum(grid: DataFrame, events: DataFrame, radius: float, grid_id: str, event_id: str, weight: str, power: float = 2.0) -> DataFrame:
    """Sum of weight / (distance + 1e-6) ** power over the events in reach of a grid point, over its greatest."""
    rows = finite(events).groupBy(*AXES).agg(F.sum(weight).alias("_weight"))  # events at one place are one
    sums = written(kernel(grid, rows, radius, "_weight", power), "kernel")
    top = sums.agg(F.max("_v").alias("_top"))
    return _beside(grid.select(grid_id, *AXES), sums.crossJoin(F.broadcast(top))).select(grid_id, F.coalesce(F.col("_v") / F.col("_top"), F.lit(0.0)).alias("hazard"))


def precedence(blocks: DataFrame, block_id: str, dx: float, dy: float, dz: float, reach: int = 1) -> DataFrame:
    """block, above: the blocks one level up within ``reach`` cells, by an equi join on cell offsets."""
    cells = blocks.select(block_id, *(F.floor(F.col(a) / s + 1e-9).cast("long").alias(f"i{a}") for a, s in zip(AXES, (dx, dy, dz))))
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)))
    wanted = cells.withColumn("o", F.explode(offsets)).select(F.col(block_id).alias("block"), (F.col("ix") + F.col("o.i")).alias("ix"), (F.col("iy") + F.col("o.j")).alias("iy"), (F.col("iz") + 1).alias("iz"))
    return wanted.join(cells.withColumnRenamed(block_id, "above"), ["ix", "iy", "iz"]).select("block", "above")


def grid(spark, counts: tuple[int, int, int], size: tuple[float, float, float], origin=(0.0, 0.0, 0.0)) -> DataFrame:
    """Centres of a regular grid, made where they are used."""
    nx, ny, nz = counts
    ids = spark.range(nx * ny * nz)
    index = (F.col("id") % nx, F.floor(F.col("id") / nx) % ny, F.floor(F.col("id") / (nx * ny)))
    return ids.select(F.col("id").alias("block_id"), *((F.lit(float(o)) + (i + 0.5) * s).alias(a) for a, i, s, o in zip(AXES, index, size, origin)))


def cluster_cells(points: DataFrame, point_id: str, radius: float, least: int) -> DataFrame:
    """Density of each point: how many lie within ``radius`` (itself included), and whether that makes it a core point."""
    near = within(points, points.withColumnRenamed(point_id, "_other"), radius, point_id, "_other")
    return near.groupBy(F.col("target").alias(point_id)).agg(F.count(F.lit(1)).alias("neighbours"), (F.count(F.lit(1)) >= least).alias("core"))

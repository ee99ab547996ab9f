"""Gaussian random fields without a random path: turning bands and moving averages by Fourier transforms, and their conditioning on samples.

Turning bands sum independent processes on lines; each process is a function of
the place on its line, made of hashes, so any node of any grid, and any sample,
gets its value for itself.  The Fourier form filters hashed noise on a torus: a
three-dimensional transform is a transform of lines along each axis, and lines of
one axis become lines of the next by one shuffle of blocks of them.  Conditioning
adds the simple kriging of what the samples differ from the field at their
places; the neighbours and weights are found once for all realisations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from . import kriging
from .simulation import standard_normal, uniform
from .spatial import AXES, least_at_places, searched
from .stored import shards, written

GOLDEN = math.pi * (3 - math.sqrt(5))


def directions(bands: int) -> list[tuple[float, float, float]]:
    """Evenly spread directions of a half sphere, on a golden spiral."""
    out = []
    for i in range(bands):
        z = 1 - (i + 0.5) / bands
        out.append((math.sqrt(1 - z * z) * math.cos(i * GOLDEN), math.sqrt(1 - z * z) * math.sin(i * GOLDEN), z))
    return out


def reduced(df: DataFrame, ranges: tuple[float, float, float], azimuth: float = 0.0, dip: float = 0.0) -> DataFrame:
    """The rows with x, y, z in units of the ranges along the axes of the anisotropy: the model there is isotropic with range 1."""
    return df.withColumns(dict(zip(AXES, geometry.anisotropic(*map(F.col, AXES), azimuth, dip, *ranges))))


def _line(kind: str, t: Column, band: Column, realisation: Column, seed: int) -> Column:
    """A process of unit variance on a line, whose sum over directions has the covariance ``kind`` of range 1 in space.

    Spherical: cells of length 1 behind a random start, in each the straight line
    through its middle with a random sign.  The others: a cosine of random phase
    and a frequency drawn from the model's spectrum (Gaussian: normal in each
    axis of space; exponential: the same over an independent normal).
    """
    if kind == "spherical":
        u = t - uniform(seed, realisation, band)
        cell = F.floor(u)
        sign = F.when(uniform(seed + 1, realisation, band, cell) < 0.5, -1.0).otherwise(1.0)
        return math.sqrt(12) * sign * (u - cell - 0.5)
    n = [standard_normal(seed + 2 + i, realisation, band) for i in range(4)]
    length = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    frequency = math.sqrt(6) * length if kind == "gaussian" else 3.0 * length / F.abs(n[3])
    return math.sqrt(2) * F.cos(frequency * t + 2 * math.pi * uniform(seed + 1, realisation, band))


def turning_bands(nodes: DataFrame, node_id: str, model: dict, realisations: int, bands: int = 64, ranges: tuple[float, float, float] | None = None, azimuth: float = 0.0, dip: float = 0.0, seed: int = 1) -> DataFrame:
    """realisation, node_id, value: unconditional fields of mean 0 at any places; ``model`` as in kriging, ``ranges`` along three axes in place of its range.

    A node's nugget is drawn by its id; null coordinates give null values.
    """
    kind = model.get("model", "spherical")
    rows = reduced(nodes, ranges or (model["range"],) * 3, azimuth, dip).select(node_id, *AXES).withColumn("realisation", F.explode(F.sequence(F.lit(0), F.lit(realisations - 1))))
    table = F.array(*(F.struct(F.lit(i).alias("b"), *(F.lit(v).alias(c) for c, v in zip(AXES, d))) for i, d in enumerate(directions(bands))))
    on = lambda b: sum((F.col(c) * b[c] for c in AXES), F.lit(0.0))
    total = F.aggregate(F.transform(table, lambda b: _line(kind, on(b), b["b"], F.col("realisation"), seed)), F.lit(0.0), lambda a, v: a + v)
    value = total * math.sqrt(model["sill"] / bands)
    if model["nugget"]:
        value = value + math.sqrt(model["nugget"]) * standard_normal(seed + 20, F.col("realisation"), F.col(node_id))
    return rows.select("realisation", node_id, value.alias("value"))


def conditioned(fields: DataFrame, nodes: DataFrame, at_samples: DataFrame, samples: DataFrame, value: str, model: dict, mean: float, realisations: int, k: int = 12, node_id: str = "block_id", sample_id: str = "sample_id", max_radius: float | None = None) -> DataFrame:
    """realisation, node_id, value: the fields (about 0) moved to the mean and drawn to the samples.

    ``fields`` and ``at_samples`` are realisation, id and value at nodes and
    samples, ``model`` holds for the coordinates of ``nodes`` and ``samples``.
    Samples without a value are left out; nodes without one in reach keep their field.
    """
    known = samples.where(F.col(value).isNotNull()).select(sample_id, *AXES, F.col(value).cast("double").alias("_known"))
    names = [f"_r{i}" for i in range(realisations)]
    own = at_samples.groupBy(sample_id).agg(*(F.max(F.when(F.col("realisation") == i, F.col("value"))).alias(f"_f{i}") for i in range(realisations)))
    rest = known.join(own, sample_id).select(sample_id, *AXES, *((F.col("_known") - mean - F.col(f"_f{i}")).alias(n) for i, n in enumerate(names)))

    def emit(part, near, at, distance, found):
        place, v = near[list(AXES)].to_numpy(float), near[names].to_numpy(float)
        where, out = part[list(AXES)].to_numpy(float), np.zeros((len(part), len(names)))
        for n in np.unique(found[found > 0]):
            for some in np.array_split(np.flatnonzero(found == n), 1 + (found == n).sum() // 4096):
                pick = at[some, :n]
                w, _ = kriging.weights(where[some], place[pick], model, "simple")
                out[some] = np.einsum("mn,mnr->mr", w, v[pick])
        return pd.DataFrame({"target": part["target"].to_numpy(), **dict(zip(names, out.T))})

    kind = nodes.schema[node_id].dataType.simpleString()
    moves = searched(nodes, written(rest, "residuals"), k, None, node_id, sample_id, names, emit, f"target {kind}, {', '.join(f'{n} double' for n in names)}", max_radius)
    moves = moves.select(F.col("target").alias(node_id), F.posexplode(F.array(*names)).alias("realisation", "_move"))
    return fields.join(moves, ["realisation", node_id], "left").select("realisation", node_id, (F.col("value") + mean + F.coalesce("_move", F.lit(0.0))).alias("value"))


def conditioned_turning_bands(nodes: DataFrame, samples: DataFrame, value: str, model: dict, mean: float, realisations: int, bands: int = 64, ranges: tuple[float, float, float] | None = None, azimuth: float = 0.0, dip: float = 0.0, seed: int = 1, k: int = 12, node_id: str = "block_id", sample_id: str = "sample_id", **search) -> DataFrame:
    """realisation, node_id, value: turning bands that meet the samples (but for their nugget, which the kriging takes as part of the field, a node at a sample gets its value)."""
    smooth = {**model, "nugget": 0.0}
    samples = least_at_places(samples.where(F.col(value).isNotNull()), k, sample_id)

    def at_places(rows: DataFrame, row_id: str) -> DataFrame:
        """The field of every row; it is a function of the place (the nugget too: a place has the same one as a node and as a sample), so each place is worked out once."""
        own = rows.select(row_id, F.struct(*(F.col(c).cast("double").alias(c) for c in AXES)).alias("_place"))
        places = own.select("_place").distinct().repartition(shards(own.sparkSession), "_place").select("_place", "_place.*")
        field = turning_bands(places, "_place", smooth, realisations, bands, ranges, azimuth, dip, seed)
        if model["nugget"]:
            field = field.withColumn("value", F.col("value") + math.sqrt(model["nugget"]) * standard_normal(seed + 20, F.col("realisation"), *(F.col(f"_place.{c}") for c in AXES)))
        return own.join(field.withColumnRenamed("_place", "_of"), F.col("_place").eqNullSafe(F.col("_of"))).select("realisation", row_id, "value")

    at_nodes, at_samples = at_places(nodes, node_id), at_places(samples, sample_id)
    scale = ranges or (model["range"],) * 3
    near = lambda d, *more: reduced(d, scale, azimuth, dip).select(*more, *AXES)
    return conditioned(at_nodes, near(nodes, node_id), at_samples, near(samples, sample_id, value), value, {**model, "range": 1.0}, mean, realisations, k, node_id, sample_id, **search)


# --- Fourier transforms ------------------------------------------------------------

#: Lines that a group transforms together.
BLOCK = 32


def _turned(lines: DataFrame, keep: str, gone: str, made: str, length: int, fields: list[str], work, block: int) -> DataFrame:
    """Lines along one axis (a row each, at ``gone`` and ``keep`` of the two others) as lines along ``gone`` (at ``made``, the former axis, and ``keep``), transformed by ``work``.

    A group is what all lines of one ``keep`` hold for ``block`` places of the
    former axis: a matrix of ``length`` times ``block``, however large the grid is.
    """
    names = ["pair", keep, gone]
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(fields[0]) - 1) / block).cast("int")), lambda b: F.struct(b.alias("part"), *(F.slice(f, b * block + 1, F.lit(block)).alias(f) for f in fields)))
    rows = lines.select(*names, F.inline(pieces))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(gone)
        stacked = {f: np.stack(group[f].to_list()) for f in fields}
        out = work(stacked)
        n = next(iter(out.values())).shape[1]
        first = group.iloc[0]
        return pd.DataFrame({"pair": np.full(n, first["pair"], np.int32), keep: np.full(n, first[keep], np.int32), made: (int(first["part"]) * block + np.arange(n)).astype(np.int32), **{f: list(np.ascontiguousarray(v.T)) for f, v in out.items()}})

    schema = f"pair int, {keep} int, {made} int, " + ", ".join(f"{f} array<double>" for f in fields)
    return rows.groupBy("pair", keep, "part").applyInPandas(run, schema)


def _complex(x: dict, transform) -> dict:
    """Fields re, im by the transform along the first axis; s, the covariance, even on the torus, stays real."""
    z = transform(x["re"] + 1j * x["im"], axis=0)
    out = {"re": z.real, "im": z.imag}
    if "s" in x:
        out["s"] = np.fft.fft(x["s"], axis=0).real
    return out


def torus(counts: tuple[int, int, int], size: tuple[float, float, float], ranges: tuple[float, float, float]) -> tuple[int, int, int]:
    """Sides of the least torus, of even number, on which the grid's ends do not feel each other."""
    return tuple(n + math.ceil(r / s) + (n + math.ceil(r / s)) % 2 for n, s, r in zip(counts, size, ranges))


def noise_lines(spark: SparkSession, sides: tuple[int, int, int], pairs: int, size, model: dict, ranges, seed: int) -> DataFrame:
    """Lines along x: two realisations of hashed noise as re and im, and the covariance with the origin of the torus."""
    nx, ny, nz = sides
    rows = spark.range(pairs * ny * nz).select((F.col("id") % pairs).cast("int").alias("pair"), (F.floor(F.col("id") / pairs) % ny).cast("int").alias("iy"), F.floor(F.col("id") / (pairs * ny)).cast("int").alias("iz"))
    xs = F.sequence(F.lit(0), F.lit(nx - 1))
    place = lambda i: (F.col("iz").cast("long") * ny + F.col("iy")) * nx + i
    wrapped = lambda i, n, s, r: F.least(i, F.lit(n) - i) * (float(s) / float(r))
    far = lambda i: F.sqrt(sum((F.pow(wrapped(c, n, s, r), 2) for c, n, s, r in zip((i, F.col("iy"), F.col("iz")), sides, size, ranges)), F.lit(0.0)))
    shape = {"spherical": lambda h: F.when(h < 1, 1 - 1.5 * h + 0.5 * h * h * h).otherwise(0.0), "exponential": lambda h: F.exp(-3 * h), "gaussian": lambda h: F.exp(-3 * h * h)}[model.get("model", "spherical")]
    return rows.select("pair", "iy", "iz", F.transform(xs, lambda i: standard_normal(seed, F.col("pair") * 2, place(i))).alias("re"), F.transform(xs, lambda i: standard_normal(seed, F.col("pair") * 2 + 1, place(i))).alias("im"), F.transform(xs, lambda i: model["sill"] * shape(far(i))).alias("s"))


def fourier_fields(spark: SparkSession, counts: tuple[int, int, int], size: tuple[float, float, float], model: dict, realisations: int, ranges: tuple[float, float, float] | None = None, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """realisation, block_id, value: unconditional Gaussian fields of the model on a grid (block_id counts x first, as ``spatial.grid`` does).

    The noise is multiplied by the root of the covariance's transform, of which
    what is below 0 counts as 0.  Two realisations go as one complex field.
    """
    ranges = ranges or (model["range"],) * 3
    sides = torus(counts, size, ranges)
    nx, ny, nz = sides
    fields = ["re", "im", "s"]

    def along_x(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                done = _complex({f: np.stack(rows[f].to_list()).T for f in fields}, np.fft.fft)
                yield rows[["pair", "iy", "iz"]].assign(**{f: list(np.ascontiguousarray(v.T)) for f, v in done.items()})

    def filtered(x: dict) -> dict:
        z = _complex(x, np.fft.fft)
        root = np.sqrt(np.maximum(z["s"], 0.0))
        back = np.fft.ifft((z["re"] + 1j * z["im"]) * root, axis=0)[: counts[2]]
        return {"re": back.real, "im": back.imag, "s": np.zeros((counts[2], 1)).repeat(back.shape[1], 1)}

    lines = noise_lines(spark, sides, (realisations + 1) // 2, size, model, ranges, seed).mapInPandas(along_x, "pair int, iy int, iz int, re array<double>, im array<double>, s array<double>")
    lines = _turned(lines, "iz", "iy", "ix", ny, fields, lambda x: _complex(x, np.fft.fft), block)  # along y, at ix and iz
    lines = _turned(lines, "ix", "iz", "iy", nz, fields, filtered, block)  # along z, at iy and ix: there and back
    back = lambda n: lambda x: {f: v[:n] for f, v in _complex({"re": x["re"], "im": x["im"]}, np.fft.ifft).items()}
    lines = _turned(lines.drop("s"), "ix", "iy", "iz", ny, ["re", "im"], back(counts[1]), block)  # along y, at iz and ix
    lines = _turned(lines, "iz", "ix", "iy", nx, ["re", "im"], back(counts[0]), block)  # along x, at iy and iz
    cells = lines.select("pair", "iy", "iz", F.posexplode(F.arrays_zip("re", "im")).alias("ix", "z"))
    block_id = (F.col("iz").cast("long") * counts[1] + F.col("iy")) * counts[0] + F.col("ix")
    out = cells.select(block_id.alias("block_id"), F.inline(F.array(*(F.struct((F.col("pair") * 2 + k).alias("realisation"), F.col("z")[f].alias("value")) for k, f in enumerate(("re", "im"))))))
    if model["nugget"]:
        out = out.withColumn("value", F.col("value") + math.sqrt(model["nugget"]) * standard_normal(seed + 1, F.col("realisation"), F.col("block_id")))
    return out.where(F.col("realisation") < realisations).select("realisation", "block_id", "value")


def conditioned_fourier(spark: SparkSession, samples: DataFrame, value: str, counts: tuple[int, int, int], size: tuple[float, float, float], origin: tuple[float, float, float], model: dict, mean: float, realisations: int, seed: int = 1, k: int = 12, **search) -> DataFrame:
    """realisation, block_id, value: Fourier fields that meet the samples, each at the middle of its block (several in a block count as their mean; those outside the grid do not)."""
    from .spatial import grid

    nodes = grid(spark, counts, size, origin)
    at = [F.floor((F.col(c) - o) / s).cast("long") for c, o, s in zip(AXES, origin, size)]
    inside = F.lit(True)
    for i, n in zip(at, counts):
        inside = inside & (i >= 0) & (i < n)
    held = samples.where(inside & F.col(value).isNotNull()).groupBy(((at[2] * counts[1] + at[1]) * counts[0] + at[0]).alias("block_id")).agg(F.avg(value).alias(value))
    held = written(held.join(nodes, "block_id"), "held")
    fields = written(fourier_fields(spark, counts, size, model, realisations, seed=seed), "fields")
    own = fields.join(held.select("block_id"), "block_id", "left_semi")
    return conditioned(fields, nodes, own, held, value, model, mean, realisations, k, "block_id", "block_id", **search)

"""Random fields: values by definition, covariances, and samples that are met."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orebed.functions import geometry
from orebed.operators import fields

MODEL = {"model": "spherical", "nugget": 0.0, "sill": 2.0, "range": 60.0}


def _u(seed, *keys):
    text = "|".join(map(str, (seed, *keys)))
    return (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)


@pytest.mark.parametrize("kind", ["spherical", "exponential", "gaussian"])
def test_turning_bands_have_the_covariance_of_the_model(spark, kind):
    """Over 600 realisations of three places: variance and covariances within 0.3 of a sill of 2 (over three standard errors)."""
    nodes = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 12.0, 9.0, 0.0), (2, 0.0, 20.0, 30.0)], "block_id long, x double, y double, z double")
    rows = fields.turning_bands(nodes, "block_id", {**MODEL, "model": kind}, 600, bands=24).collect()
    table = np.zeros((600, 3))
    for r in rows:
        table[r["realisation"], r["block_id"]] = r["value"]
    found = np.cov(table.T, bias=True)
    far = lambda h: {"spherical": 1 - 1.5 * h + 0.5 * h**3, "exponential": np.exp(-3 * h), "gaussian": np.exp(-3 * h * h)}[kind] * 2
    places = np.array([[0, 0, 0], [12, 9, 0], [0, 20, 30]])
    for i in range(3):
        for j in range(3):
            assert found[i, j] == pytest.approx(far(np.linalg.norm(places[i] - places[j]) / 60), abs=0.3)


def test_a_node_is_its_bands(spark):
    nodes = spark.createDataFrame([(5, 31.0, -7.0, 12.0)], "block_id long, x double, y double, z double")
    found = fields.turning_bands(nodes, "block_id", MODEL, 2, bands=5, ranges=(60.0, 30.0, 20.0), azimuth=30.0, dip=10.0).collect()
    place = np.array([31.0, -7.0, 12.0])
    p = [np.dot(place, a) / r for a, r in zip(geometry.rotation(30.0, 10.0), (60.0, 30.0, 20.0))]
    for r in found:
        total = 0.0
        for b, d in enumerate(fields.directions(5)):
            u = np.dot(p, d) - _u(1, r["realisation"], b)
            cell = int(np.floor(u))
            total += 12**0.5 * (-1 if _u(2, r["realisation"], b, cell) < 0.5 else 1) * (u - cell - 0.5)
        assert r["value"] == pytest.approx(total * (2.0 / 5) ** 0.5)


@pytest.mark.parametrize("nugget", [0.0, 0.3])
def test_samples_are_met(spark, nugget):
    rng = np.random.default_rng(1)
    data = [(i, *map(float, rng.uniform(0, 100, 3)), float(rng.normal(7, 1.4))) for i in range(40)]
    samples = spark.createDataFrame([*data, (99, 1.0, 2.0, 3.0, None)], "sample_id long, x double, y double, z double, value double")
    nodes = samples.select((F.col("sample_id") + 1000).alias("block_id"), "x", "y", "z")
    nodes = nodes.unionByName(spark.createDataFrame([(1, 5000.0, 0.0, 0.0)], nodes.schema))
    out = fields.conditioned_turning_bands(nodes, samples, "value", {**MODEL, "nugget": nugget}, 7.0, 3, bands=16, ranges=(80.0, 50.0, 30.0), azimuth=20.0)
    found = {(r["realisation"], r["block_id"]): r["value"] for r in out.collect()}
    assert len(found) == 3 * 42
    for i, *_, v in data:
        assert [found[k, 1000 + i] for k in range(3)] == pytest.approx([v] * 3, abs=1e-6)
    free = {r["realisation"]: r["value"] for r in fields.turning_bands(nodes.where("block_id = 1"), "block_id", MODEL, 3, 16, (80.0, 50.0, 30.0), 20.0).collect()}
    if not nugget:  # far from all samples the field stays as it is
        assert [found[k, 1] for k in range(3)] == pytest.approx([free[k] + 7.0 for k in range(3)])


def test_fourier_fields_equal_numpy(spark):
    counts, size = (9, 7, 5), (10.0, 10.0, 10.0)
    model = {**MODEL, "range": 35.0}
    found = {(r["realisation"], r["block_id"]): r["value"] for r in fields.fourier_fields(spark, counts, size, model, 3, block=4).collect()}
    assert len(found) == 3 * 9 * 7 * 5
    sides = fields.torus(counts, size, (35.0,) * 3)
    nx, ny, nz = sides
    z, y, x = np.meshgrid(*(np.minimum(np.arange(n), n - np.arange(n)) for n in (nz, ny, nx)), indexing="ij")
    h = np.sqrt(x**2 + y**2 + z**2) * 10 / 35
    spectrum = np.fft.fftn(np.where(h < 1, 1 - 1.5 * h + 0.5 * h**3, 0) * 2.0).real
    normal = lambda r, p: np.sqrt(-2 * np.log(_u(1, r, p))) * np.cos(_u(7920, r, p) * 6.283185307179586)
    for r in range(3):
        noise = np.array([normal(r, p) for p in range(nx * ny * nz)]).reshape(nz, ny, nx)
        field = np.fft.ifftn(np.fft.fftn(noise) * np.sqrt(np.maximum(spectrum, 0))).real[:5, :7, :9].ravel()
        assert np.allclose([found[r, b] for b in range(9 * 7 * 5)], field)


def test_fourier_fields_have_the_covariance_of_the_model(spark):
    """60 realisations of a 10 x 10 x 6 grid: the mean products at lags 0 to 3 along x within 0.2 of the model's (sill 2)."""
    rows = fields.fourier_fields(spark, (10, 10, 6), (10.0,) * 3, {**MODEL, "range": 40.0}, 60).toPandas()
    cube = rows.sort_values(["realisation", "block_id"])["value"].to_numpy().reshape(60, 6, 10, 10)
    for lag in range(4):
        h = lag * 10 / 40
        assert (cube[..., : 10 - lag] * cube[..., lag:]).mean() == pytest.approx(2 * (1 - 1.5 * h + 0.5 * h**3), abs=0.2)


def test_fourier_fields_meet_the_samples(spark):
    data = [(i, 10.0 * i + 3, 5.0 * (i % 4) + 2, 4.0, 6.0 + i) for i in range(8)] + [(20, 3.0, 2.0, 1.0, 8.0), (21, -4.0, 0.0, 0.0, 99.0), (22, 3.0, 2.0, 1.0, None)]
    samples = spark.createDataFrame(data, "sample_id long, x double, y double, z double, value double")
    out = fields.conditioned_fourier(spark, samples, "value", (8, 4, 2), (10.0, 5.0, 5.0), (0.0, 0.0, 0.0), {**MODEL, "nugget": 0.1}, 9.0, 2)
    found = {(r["realisation"], r["block_id"]): r["value"] for r in out.collect()}
    assert len(found) == 2 * 64
    for k in range(2):
        assert found[k, 0] == pytest.approx((6.0 + 8.0) / 2, abs=1e-6)
        for i in range(1, 8):
            assert found[k, (i % 4) * 8 + i] == pytest.approx(6.0 + i, abs=1e-6)

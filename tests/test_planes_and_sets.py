"""Nested variogram fits, sets of axes, planes of contacts and faults, against plain versions and planted cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orebed.operators import planes, structural, variograms


def test_planted_structures_are_found(spark):
    sph = lambda h, a: np.where(h < a, 1.5 * h / a - 0.5 * (h / a) ** 3, 1.0)
    h = np.arange(1, 25) * 10.0
    data = [(k + 1, float(d), float(0.4 + 1.1 * sph(d, 60.0) + 2.5 * sph(d, 210.0)), 50 + 3 * k) for k, d in enumerate(h)]
    curve = spark.createDataFrame([*data, (99, None, None, 0)], "lag int, distance double, gamma double, pairs int")
    found = variograms.fitted_nested(curve, tries=12)  # the grid: 30, 60, ... 360
    assert [s["model"] for s in found] == ["nugget", "spherical", "spherical"]
    assert [s["range"] for s in found] == pytest.approx([0, 60, 210])
    assert [s["sill"] for s in found] == pytest.approx([0.4, 1.1, 2.5], abs=1e-6)
    three = variograms.fitted_nested(curve, ("spherical", "spherical", "spherical"), tries=12)
    assert sum(s["sill"] for s in three) == pytest.approx(4.0, abs=0.01)
    held = variograms.fitted_nested(curve, tries=12, nugget=0.4)
    assert [s["sill"] for s in held] == pytest.approx([0.4, 1.1, 2.5], abs=1e-6)
    assert variograms.fitted_nested(curve.where("lag > 100")) == []
    rising = curve.where("lag < 25").withColumn("gamma", 5.0 - F.col("gamma"))  # only a nugget fits without negative sills
    assert all(s["sill"] >= 0 for s in variograms.fitted_nested(rising, tries=6))


def _axes(seed, centres, n, spread):
    rng = np.random.default_rng(seed)
    out = []
    for c in centres:
        for _ in range(n):
            v = np.array(c) + rng.normal(0, spread, 3)
            out.append(v / np.linalg.norm(v) * rng.choice([-1, 1]) * rng.uniform(0.5, 2))
    return out


CENTRES = [(0.1, 0.2, -0.97), (0.9, 0.1, -0.3), (-0.2, 0.95, 0.1)]


def test_signs_of_axes_mean_nothing(spark):
    axes = _axes(3, CENTRES, 60, 0.08)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(axes)] + [(900, None, 0.0, 1.0), (901, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    rows, centres = structural.axial_clusters(df, "id", ("x", "y", "z"), 3)
    found = {r["id"]: (r["cluster"], r["angle"]) for r in rows.collect()}
    assert len(found) == 180 and all(len({found[60 * s + i][0] for i in range(60)}) == 1 for s in range(3))
    turned = df.withColumns({c: F.when(F.col("id") % 3 == 0, -F.col(c)).otherwise(F.col(c)) for c in "xyz"})
    again, other = structural.axial_clusters(turned, "id", ("x", "y", "z"), 3)
    assert {r["id"]: r["cluster"] for r in again.collect()} == {i: c for i, (c, _) in found.items()}
    assert np.allclose(centres, other)
    unit = np.array([v / np.linalg.norm(v) for v in axes])
    for s in range(3):  # the centre is the leading eigenvector of its set
        own = unit[60 * s : 60 * s + 60]
        lead = np.linalg.eigh(own.T @ own)[1][:, 2]
        assert abs(lead @ centres[found[60 * s][0]]) == pytest.approx(1.0)
    sets = structural.axial_sets(df, "id", ("x", "y", "z"), rows)
    assert [s["n"] for s in sets] == [60, 60, 60] and all(s["share1"] > 0.95 and s["z"] <= 0 for s in sets)
    assert structural.axial_clusters(df.where("id >= 900"), "id", ("x", "y", "z"), 3)[0].collect() == []


def test_density_clusters_of_axes_equal_brute_force(spark):
    axes = _axes(5, CENTRES, 25, 0.06) + _axes(6, [(0.5, -0.6, 0.6)], 1, 0.01) + _axes(7, [(0.0, 0.0, 1.0)], 12, 1.0)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(axes)], "id long, x double, y double, z double")
    found = {r["id"]: r["cluster"] for r in structural.axial_density_clusters(df, "id", ("x", "y", "z"), 9.0, 4).collect()}
    unit = np.array([v / np.linalg.norm(v) for v in axes])
    near = np.degrees(np.arccos(np.minimum(np.abs(unit @ unit.T), 1))) <= 9.0
    core = near.sum(1) >= 4
    label = {i: i for i in np.flatnonzero(core)}
    for _ in range(len(unit)):
        label = {i: min(label[j] for j in np.flatnonzero(near[i] & core)) for i in label}
    for i in range(len(unit)):
        around = np.flatnonzero(near[i] & core)
        assert found[i] == (label[i] if core[i] else label[around[0]] if len(around) else -1)


def _plane(rng, n, dip, direction, centre, noise, extent=50.0):
    d, a = np.radians([dip, direction])
    down = np.array([np.sin(a) * np.cos(d), np.cos(a) * np.cos(d), -np.sin(d)])
    along = np.array([np.cos(a), -np.sin(a), 0])
    normal = np.array([np.sin(d) * np.sin(a), np.sin(d) * np.cos(a), np.cos(d)])
    u = rng.uniform(-extent, extent, (n, 2))
    return np.array(centre) + u[:, :1] * down + u[:, 1:] * along + rng.normal(0, noise, (n, 1)) * normal, normal


def _contacts(spark):
    rng = np.random.default_rng(9)
    out, normals, i = [], {}, 0
    for f, (dip, direction, n) in {"shale": (30, 120, 40), "ore": (55, 300, 40), "cap": (10, 45, 6), "two": (0, 0, 2)}.items():
        points, normals[f] = _plane(rng, n, dip, direction, (10 * i, 0, 100 * len(normals)), 0.2)
        for p in points:
            out.append((i, *map(float, p), f, i % 7))
            i += 1
    return spark.createDataFrame(out, "id long, x double, y double, z double, formation string, hole_id int"), normals, out


def test_planes_of_contacts(spark):
    df, normals, data = _contacts(spark)
    found = {r["formation"]: r for r in planes.fitted_planes(df, ["formation"]).collect()}
    assert set(found) == {"shale", "ore", "cap"}
    for f, r in found.items():
        x = np.array([d[1:4] for d in data if d[4] == f])
        values, vectors = np.linalg.eigh(np.cov(x.T))
        assert abs(np.dot(vectors[:, 0], [r["gx"], r["gy"], r["gz"]])) == pytest.approx(1.0, abs=1e-9) and r["gz"] >= 0
        assert r["confidence"] == pytest.approx(1 - values[0] / values[1], abs=1e-6)
        assert np.dot([r["gx"], r["gy"], r["gz"]], normals[f]) > 0.99
    line = spark.createDataFrame([(1, float(i), 2.0 * i, 0.0) for i in range(5)] + [(2, 1.0, 1.0, 1.0)] * 4, "g int, x double, y double, z double")
    assert {r["confidence"] for r in planes.fitted_planes(line, ["g"]).collect()} == {0.0}


def test_planes_of_neighbourhoods(spark):
    df, normals, data = _contacts(spark)
    rows = planes.local_gradients(df, "id", 8).collect()
    by = {r["id"]: r for r in rows}
    assert [r["formation"] for r in rows if r["id"] is None] == ["cap"]  # six contacts: one plane at the centre
    for f in ("shale", "ore"):
        own = [d for d in data if d[4] == f]
        x = np.array([d[1:4] for d in own])
        for d in own:
            order = np.argsort(np.linalg.norm(x - np.array(d[1:4]), axis=1))[1:9]
            values, vectors = np.linalg.eigh(np.cov(x[order].T))
            score = 1 - values[0] / values[1]
            assert (d[0] in by) == (score >= 0.25)
            if d[0] in by:
                r = by[d[0]]
                assert abs(np.dot(vectors[:, 0], [r["gx"], r["gy"], r["gz"]])) == pytest.approx(1.0, abs=1e-8)
                assert r["confidence"] == pytest.approx(score, abs=1e-8) and (r["x"], r["y"], r["z"]) == tuple(d[1:4])


def test_one_gradient_a_place(spark):
    df, _, data = _contacts(spark)
    ranks = spark.createDataFrame([("shale", 0), ("ore", 1), ("cap", 2)], "formation string, rank int")
    rows = planes.contact_gradients(df, ranks, "id", k=8).collect()
    assert len({(r["x"], r["y"], r["z"]) for r in rows}) == len(rows)
    assert {tuple(d[1:4]) for d in data if d[4] != "two"} <= {(r["x"], r["y"], r["z"]) for r in rows}
    parts = planes.boundary_gradients(df).unionByName(planes.sequence_gradients(df, ranks)).unionByName(planes.cross_hole_gradients(df)).collect()
    best = {}
    for r in parts:
        best[r["x"], r["y"], r["z"]] = max(best.get((r["x"], r["y"], r["z"]), 0), r["confidence"])
    for r in rows:
        assert r["confidence"] == pytest.approx(max(best.get((r["x"], r["y"], r["z"]), 0), 0.6 if r["source"] == "local" else 0))
        assert np.linalg.norm([r["gx"], r["gy"], r["gz"]]) == pytest.approx(1.0)


def test_a_planted_fault_is_found(spark):
    rng = np.random.default_rng(12)
    fault, normal = _plane(rng, 80, 65, 250, (500, 500, 0), 0.5, 40.0)
    blob = rng.normal(0, 12, (60, 3)) + np.array([0, 0, 0])
    calm = rng.uniform(0, 1000, (300, 3))
    data = [(i, *map(float, p), 25.0) for i, p in enumerate(fault)] + [(1000 + i, *map(float, p), 30.0) for i, p in enumerate(blob)] + [(2000 + i, *map(float, p), 3.0) for i, p in enumerate(calm)]
    df = spark.createDataFrame(data, "id long, x double, y double, z double, residual double")
    (row,) = planes.potential_faults(df, "id", "residual", 10.0, 20.0, 5, 0.9).collect()
    assert row["dip"] == pytest.approx(65, abs=2) and row["dip_direction"] == pytest.approx(250, abs=2) and row["mean_misfit"] == 25.0 and row["n"] >= 75
    assert planes.potential_faults(df, "id", "residual", 99.0, 20.0).collect() == []

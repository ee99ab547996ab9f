"""Pairs within a radius as sums: against numpy, and where so many rows share a place that their pairs cannot be listed (4e8 of them)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orebed.operators import simulation, spatial, variograms


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    at, v = np.round(rng.uniform(0, 60, (160, 3)), 1), rng.integers(0, 9, 160).astype(float)
    at[100:130], v[110:130] = at[:30], v[10:30]  # copies of places, some of values too
    rows = [(int(i), *map(float, p), float(w), int(i % 7)) for i, (p, w) in enumerate(zip(at, v))]
    odd = [(900, float("nan"), 1.0, 1.0, 5.0, 1), (901, float("inf"), 1.0, 1.0, 5.0, 1), (902, None, 1.0, 1.0, 5.0, 1), (903, 1.0, 1.0, 1.0, None, 1)]
    return at, v, spark.createDataFrame(rows + odd, "id int, x double, y double, z double, v double, hole int")


def test_curves(cloud):
    at, v, frame = cloud
    i, j = np.triu_indices(160, 1)
    off = at[j] - at[i]
    d = np.sqrt((off * off).sum(1))
    for got, inside in ((variograms.experimental(frame, "id", "v", 4, 5.0), d > 0), (variograms.directional(frame, "id", "v", 4, 5.0, 40.0, angle=30.0), np.abs(off[:, 0] * np.sin(np.radians(40)) + off[:, 1] * np.cos(np.radians(40))) >= d * np.cos(np.radians(30)))):
        for r in got.collect():
            some = inside & (d > 0) & (np.ceil(d / 5) == r["lag"])
            assert r["pairs"] == some.sum() and r["gamma"] == pytest.approx(((v[i] - v[j]) ** 2 / 2)[some].mean()) and r["distance"] == pytest.approx(d[some].mean())
    wide = {r["lag"]: r["pairs"] for r in variograms.experimental(frame, "id", "v", 4, 5.0, tolerance=1.0).collect()}
    assert wide == {k: int(((d >= (k - 1) * 5) & (d <= (k + 1) * 5)).sum()) for k in range(1, 5)}  # copies of a place are in the first lag


def test_rows_of_one_id_do_not_pair(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0), (1, 1.0, 0.0, 0.0, 2.0), (2, 2.0, 0.0, 0.0, 4.0)], "id int, x double, y double, z double, v double")
    assert [(r["lag"], r["pairs"], r["gamma"]) for r in variograms.experimental(rows, "id", "v", 1, 3.0).collect()] == [(1, 2, pytest.approx((9 + 4) / 4))]


def test_kernel_in_small_parts(cloud, monkeypatch):
    at, v, frame = cloud
    monkeypatch.setattr(spatial, "MEETING", 3)
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
    want = np.where(d <= 15, v[None] / (d + 1e-6) ** 2, 0).sum(1)
    got = {r["id"]: r["hazard"] for r in spatial.kernel_sum(frame, frame.where("id < 900").withColumnRenamed("id", "e"), 15.0, "id", "e", "v").collect()}
    assert len(got) == 164 and [got[i] for i in range(160)] == pytest.approx(list(want / want.max())) and got[900] == got[902] == 0
    near = {r["id"]: (r["nearest"], r["class"]) for r in spatial.classified(frame, frame.withColumnRenamed("id", "sample_id"), [("a", 8.0, 3), ("b", 12.0, 2)], "id", "hole").collect()}
    hole = np.arange(160) % 7
    for k in range(160):
        of = np.array([d[k][hole == h].min() for h in range(7)])
        assert near[k] == (of.min(), "a" if (of <= 8).sum() >= 3 else "b" if (of <= 12).sum() >= 2 else "Unclassified")
    assert near[901] == (None, "Unclassified")


def test_many_rows_at_a_place(spark):
    n = 20_000
    rows = spark.range(2 * n).select("id", *((F.col("id") % 2 * 3 + k).cast("double").alias(a) for k, a in enumerate("xyz")), (F.col("id") % 2 * 4).cast("double").alias("v"), (F.col("id") % 5).alias("hole"))
    [r] = variograms.experimental(rows, "id", "v", 1, 10.0).collect()
    assert (r["pairs"], r["gamma"], r["distance"]) == (n * n, 8.0, pytest.approx(27**0.5))
    [c] = variograms.cross(rows.withColumn("w", -F.col("v")), "id", "v", "w", 1, 10.0).collect()
    assert (c["pairs"], c["gamma"]) == (n * n, -8.0)
    got = {r["hazard"]: r["count"] for r in spatial.kernel_sum(rows, rows.withColumnRenamed("id", "e"), 4.0, "id", "e", "v").groupBy("hazard").count().collect()}
    assert got == {0.0: n, 1.0: n}
    classes = spatial.classified(rows, rows.withColumnRenamed("id", "sample_id"), [("a", 4.0, 5)], "id", "hole").groupBy("class", "nearest").count().collect()
    assert [tuple(r) for r in classes] == [("a", 0.0, 2 * n)]
    volumes = simulation.hazard_realisations(rows.limit(n).select("id", "x", "y", "z", F.lit(1.0).alias("magnitude")), rows, 90.0, 2, event_id="id", grid_id="id")
    assert volumes.groupBy("realisation").agg(F.max("hazard").alias("h"), F.count("*").alias("n")).orderBy("realisation").collect() == [(0, 1.0, 2 * n), (1, 1.0, 2 * n)]

import numpy as np

from orebed.operators import spatial


def test_targets_far_from_dense_points_get_all_k(spark):
    rng = np.random.default_rng(2)
    data = [(i, *map(float, rng.uniform(0, 1, 3))) for i in range(40)]
    points = spark.createDataFrame(data, "other long, x double, y double, z double")
    far = [(0, 0.5, 0.5, 0.5), (1, 3e6, 0.0, 0.0), (2, None, 0.0, 0.0), (3, float("nan"), 0.0, 0.0)]
    targets = spark.createDataFrame(far, "id long, x double, y double, z double")
    x = np.array([r[1:] for r in data])
    expected = {(t[0], k + 1): int(j) for t in far[:2] for k, j in enumerate(np.argsort(np.linalg.norm(x - np.array(t[1:]), axis=1))[:5])}
    assert {(r["target"], r["rank"]): r["point"] for r in spatial.nearest(targets, points, 5, None, "id", "other").collect()} == expected
    few = spatial.nearest(targets, points.limit(3), 5, 0.1, "id", "other").collect()
    assert sorted((r["target"], r["rank"]) for r in few) == [(t, k) for t in (0, 1) for k in (1, 2, 3)]

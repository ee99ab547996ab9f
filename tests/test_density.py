"""Density clusters against brute force: crowds, copies of one place, thin chains, points without a place."""

import random

import pytest

from orebed.operators import clustering, economics


def _brute(points, radius, least):
    at = {k: p for k, *p in points if None not in p}
    reach = {k: [j for j, q in at.items() if sum((a - b) ** 2 for a, b in zip(p, q)) ** 0.5 <= radius] for k, p in at.items()}
    core = {k for k, near in reach.items() if len(near) >= least}
    group = {}
    for k in sorted(core):
        todo = [] if k in group else [k]
        while todo:
            i = todo.pop()
            if i not in group:
                group[i] = k
                todo += [j for j in reach[i] if j in core]
    border = {k: group[min(j for j in near if j in core)] for k, near in reach.items() if k not in core and any(j in core for j in near)}
    return {k: group.get(k, border.get(k, -1)) for k, *_ in points}


@pytest.mark.parametrize("radius, least", [(1.0, 4), (0.37, 3), (2.5, 12)])
def test_clusters_equal_brute_force(spark, radius, least):
    rng = random.Random(5)
    points = [(rng.gauss(0, 0.6), rng.gauss(0, 0.6), rng.gauss(0, 0.6)) for _ in range(120)]  # a crowd
    points += [(6e2, 5e2, -3.0)] * 25 + [(6e2 + radius, 5e2, -3.0)] * 3  # copies, and others at the very radius
    points += [(10 + 0.9 * radius * i, 0.0, 0.0) for i in range(12)]  # a chain
    points += [tuple(rng.uniform(-4, 4) for _ in range(3)) for _ in range(160)] + [(None, 0.0, 0.0), (-50.0, -50.0, -50.0)]
    table = [(i, *p) for i, p in enumerate(points)]
    rng.shuffle(table)
    found = clustering.density_clusters(spark.createDataFrame(table, "id long, x double, y double, z double"), "id", radius, least)
    assert {r["id"]: r["cluster"] for r in found.collect()} == _brute(table, radius, least)


def test_no_points(spark):
    assert clustering.density_clusters(spark.createDataFrame([], "id long, x double, y double, z double"), "id", 1.0, 3).count() == 0


def test_routes(spark):
    blocks = spark.createDataFrame([(1, 2.0, 10.0), (2, 0.1, 10.0)], "block_id int, grade double, tonnes double")
    routes = spark.createDataFrame([("mill", 0.9, 10.0, 5.0, 1.0), ("heap", 0.5, 10.0, 1.0, 1.0), ("dump", 0.0, 0.0, 0.0, 1.0)], "route string, recovery double, price double, cost double, factor double")
    assert [tuple(r) for r in economics.best_route(blocks, routes, "block_id").orderBy("block_id").collect()] == [(1, "mill", 130.0), (2, "dump", 0.0)]
    assert {r["route"] for r in economics.best_route(blocks, routes.where("price < 0"), "block_id").collect()} == {None}
    with pytest.raises(ValueError, match="more than 2"):
        economics.best_route(blocks, routes, "block_id", 2)


def test_kmeans_puts_rows_at_their_nearest_centre(spark):
    rng = random.Random(6)
    rows = [(i, i % 3, 100.0 * (i % 3) + rng.gauss(0, 3), rng.gauss(0, 1) + 9 * (i % 3 == 1)) for i in range(150)]
    found = clustering.kmeans(spark.createDataFrame(rows, "id int, kind int, a double, b double"), ["a", "b"], 3).toPandas()
    assert found.groupby("kind")["cluster"].nunique().max() == 1 and found["cluster"].nunique() == 3
    scaled = found[["a", "b"]] / found[["a", "b"]].std()
    centres = scaled.groupby(found["cluster"]).mean()
    away = {c: ((scaled - centres.loc[c]) ** 2).sum(axis=1) for c in centres.index}
    assert all(away[c][i] <= min(d[i] for d in away.values()) for i, c in enumerate(found["cluster"]))

"""The ways that only large tables take, forced on small ones, and the cases beyond old bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orebed.operators import components, running, selection, simulation, spatial, stored, survey


def _cloud(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    data = [(i, *map(float, np.round(rng.uniform(0, 100, 3))), float(i % 7)) for i in range(n)]
    return spark.createDataFrame(data, "id long, x double, y double, z double, v double"), data


def test_crowded_cells_are_joined_instead(spark, monkeypatch):
    points, data = _cloud(spark, 300)
    targets = points.where("id < 40").select(F.col("id").alias("t"), "x", "y", "z")
    own = spatial.nearest(targets, points, 6, None, "t", "id", ["v"])
    together = {(r["target"], r["rank"]): (r["point"], r["v"]) for r in own.collect()}
    x = np.array([d[1:4] for d in data])
    for t in range(40):
        order = np.lexsort((np.arange(300), np.round(np.linalg.norm(x - x[t], axis=1), 9)))[:6]
        assert [together[t, k + 1][0] for k in range(6)] == order.tolist()
    monkeypatch.setattr(spatial, "DENSE", 5)
    monkeypatch.setattr(spatial, "GROUP_TARGETS", 3)
    joined = spatial.nearest(targets, points, 6, None, "t", "id", ["v"])
    assert {(r["target"], r["rank"]): (r["point"], r["v"]) for r in joined.collect()} == together


def test_equal_distances_go_by_place():
    points = np.array([[1.0, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [3, 0, 0]])
    at, far, found = spatial.k_smallest(np.zeros((1, 3)), points, 3, 10.0)
    assert at.tolist() == [[0, 1, 2]] and far.tolist() == [[1.0, 1.0, 1.0]] and found.tolist() == [3]
    assert spatial.k_smallest(np.zeros((1, 3)), points, 5, 2.0)[2].tolist() == [4]


@pytest.mark.parametrize("d", [1, 2, 3])
def test_looking_into_cells_equals_looking_at_all(d, monkeypatch):
    rng = np.random.default_rng(d)
    points, targets = np.round(rng.uniform(0, 6, (400, d)), 1), np.round(rng.uniform(0, 6, (300, d)), 1)
    cells = lambda x: np.floor(x / 0.9).astype(np.int64)
    expected = spatial.k_smallest(targets, points, 7, 0.9)
    for sharing in (1, 5, 10**6):
        monkeypatch.setattr(spatial, "SHARING", sharing)
        at, far, found = spatial.k_nearest(targets, cells(targets), points, cells(points), 7, 0.9, pairs=500)
        assert (found == expected[2]).all()
        for t in range(300):
            assert at[t, : found[t]].tolist() == expected[0][t, : found[t]].tolist()
            assert far[t, : found[t]].tolist() == expected[1][t, : found[t]].tolist()


def test_groups_are_few(spark):
    """One Python call for about a thousand targets, however small the cells: by their number, not by the radius."""
    targets, _ = _cloud(spark, 20000, 4)
    points, _ = _cloud(spark, 20000, 5)
    calls = spark.sparkContext.accumulator(0)
    far = spark.sparkContext.accumulator(0)

    def emit(part, near, at, distance, found):
        calls.add(1)
        far.add(len(near))
        return part[["target"]].assign(n=found)

    out = spatial.searched(targets, points, 4, 3.5, "id", "id", [], emit, "target long, n long", 3.5)
    assert out.count() == 20000
    assert 2 <= calls.value <= 20000 / 1000 * 2 and far.value < 20000 * 8


def test_running_sums_ranks_and_quantiles(spark):
    rng = np.random.default_rng(5)
    values = [None if i % 11 == 0 else float(v) for i, v in enumerate(np.round(rng.normal(size=500), 1))]
    rows = spark.createDataFrame([(i, "a" if i % 3 else None, v) for i, v in enumerate(values)], "id long, k string, v double")
    fine = sorted((v, i) for i, v in enumerate(values) if v is not None)
    before = {r["id"]: r["before"] for r in running.running(rows.where("v is not null"), ["v", "id"], F.lit(1.0)).collect()}
    assert before == {i: float(k) for k, (_, i) in enumerate(fine)}
    found = {r["k"]: (r["p10"], r["p50"]) for r in running.quantiles(rows, "v", {"p10": 0.1, "p50": 0.5}, ["k"], parts=4).collect()}
    for k in ("a", None):
        own = [v for i, v in enumerate(values) if v is not None and ("a" if i % 3 else None) == k]
        assert found[k] == pytest.approx(np.percentile(own, [10, 50]))
    assert running.quantiles(rows.where("v > 99"), "v", {"p": 0.5}).first()["p"] is None


def test_ranges_know_their_neighbours(spark):
    knots = spark.createDataFrame([(float(k * k), k) for k in range(12)], "g double, k long")
    rows = spark.createDataFrame([(i, float(i) - 3.5) for i in range(140)] + [(999, None)], "id long, g double")
    for r in running.around(rows.where("g is not null"), knots, "g").collect():
        low = [k for k in range(12) if k * k <= r["g"]]
        high = [k for k in range(12) if k * k >= r["g"]]
        assert (r["_a"]["k"] if r["_a"] else None) == (low[-1] if low else None)
        assert (r["_b"]["k"] if r["_b"] else None) == (high[0] if high else None)


def test_long_and_round_lineages(spark):
    edges = [(i, i + 1) for i in range(70)] + [(100, 101), (101, 102), (102, 100)]
    found = {(r["node"], r["ancestor"]): r["distance"] for r in survey.lineages(spark.createDataFrame(edges, "child long, parent long")).collect()}
    assert found[0, 70] == 70 and found[100, 102] == 2 and found[100, 100] == 3 and len(found) == 70 * 71 // 2 + 9


def test_many_ignore_rules(spark):
    found = spark.createDataFrame([("GAP", str(i), "assays", "ERROR") for i in range(12_000)] + [("LOST", "7", "lith", "ERROR")], "rule_code string, hole_id string, table_name string, severity string")
    rules = spark.createDataFrame([("GAP", str(i), None) for i in range(0, 12_000, 2)] + [(None, None, "lith")], "rule_code string, hole_id string, table_name string")
    shown, hidden = selection.without_ignored(found, rules)
    assert shown.count() == 6000 and hidden.count() == 6001


def test_components_of_a_hub(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 400)] + [(i, i + 1000) for i in range(1, 400)], "u long, v long")
    assert {r["component"] for r in components.components(edges).collect()} == {0}


def test_interval_of_a_mean(spark):
    points, data = _cloud(spark, 200)
    low, high, mean = simulation.corrected_interval(points, "v", "id", 200)
    assert low < mean < high and mean == pytest.approx(np.mean([d[4] for d in data])) and high - low < 1.2


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "applicationId": "a"})

    with pytest.raises(ValueError):
        stored.shared_folder(Session())

"""Checks between tables, with nulls, ties, empty tables and plain arithmetic beside them."""

import math

import pytest
from pyspark.sql import functions as F

from orebed.operators import checks, modelling, planning, selection, simulation, validation, variograms


def test_assembled(spark):
    rows = spark.createDataFrame(
        [("a", "0", "1", None, 0), ("a", "1", "2", "own", 1), ("a", None, "2", None, 2), ("a", "3", None, None, 3), ("a", "x", "4", None, 4), ("a", "4", "4", None, 5), ("a", "-2", "-1", None, 6), ("a", "5", "6", None, 7), ("b", "0", "1", None, 8), ("a", "NaN", "6", None, 9)],
        "hole_id string, depth_from string, depth_to string, lith_code string, k int",
    )
    logs = spark.createDataFrame([("a", 0.0, 2.0, "up"), ("a", 3.0, 6.0, "mid"), ("a", 5.0, 8.0, "low"), ("a", None, 8.0, "?")], "hole_id string, depth_from double, depth_to double, lith_code string")
    fine, out = checks.assembled(rows, logs, bad=spark.createDataFrame([(7,), (7,)], "k int"), key=["k"])
    assert sorted((r["k"], r["lith_code"]) for r in fine.collect()) == [(0, "up"), (1, "own"), (8, None)]
    assert sorted((r["k"], r["reason"]) for r in out.collect()) == [(2, "missing_from_depth"), (3, "missing_to_depth"), (4, "invalid_depth_format"), (5, "zero_or_negative_length"), (6, "negative_depth"), (7, "validation_error"), (9, "missing_from_depth")]
    tied = checks.assembled(spark.createDataFrame([("a", 2.0, 3.5)], "hole_id string, depth_from double, depth_to double"), logs.where("lith_code in ('up', 'mid')"))[0].first()
    assert tied["lith_code"] == "up"  # middles at 1.0 and 4.5, its own at 2.75
    assert checks.assembled(rows.where("k < 0"), logs)[0].count() == 0


def test_breaks(spark):
    rows = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0005, 2.0), ("a", 2.5, 3.0), ("a", 2.9, 4.0), ("b", 0.0, 1.0)], "hole_id string, depth_from double, depth_to double")
    assert [tuple(r) for r in checks.breaks(rows).collect()] == [("a", 1, 1)]


def test_spot_checks_take_all_of_a_small_table(spark):
    points = spark.createDataFrame([(i, float(i), 0.0, 5.0) for i in range(4)], "id int, x double, y double, z double")
    surface = spark.createDataFrame([(9, 0.0, 3.0, 1.0), (4, 0.0, -3.0, 1.0)], "v int, x double, y double, z double")
    found = checks.spot_checks(points, surface, 10, "id", "v").orderBy("id").collect()
    assert [r["v"] for r in found] == [4] * 4
    assert found[3]["distance"] == pytest.approx(math.sqrt(34)) and found[3]["vertical"] == 4.0 and found[3]["horizontal"] == pytest.approx(math.sqrt(18))
    assert checks.spot_checks(points, surface.where("v < 0"), 10, "id", "v").count() == 0


def test_series_without_periods_or_polygons(spark):
    blocks = spark.createDataFrame([(10.0, 2.0, 1.0), (10.0, None, None), (5.0, 3.0, float("nan"))], "volume double, density double, fe double")
    mined = spark.createDataFrame([("p1", 7.0, 2.0)], "period string, tonnes double, fe double")
    found = {r["source"]: (r["period"], r["material"], r["tonnes"], r["fe"]) for r in checks.mine_series(["fe"], blocks, mined, blocks).collect()}
    assert found["mined"] == ("p1", "ore", 7.0, 2.0)
    assert found["long_model"] == found["gc_model"] == ("all", "ore", 20.0 + 27.0 + 15.0, 1.0)


def test_slopes(spark):
    plan = spark.createDataFrame([(1, "n"), (1, "s"), (2, "s"), (3, "x")], "period int, wall string")
    slopes = spark.createDataFrame([("n", 1.2, 0.1), ("n", 0.9, 0.3), ("s", 0.8, None), ("s", 1.5, None)], "wall string, fos double, probability double")
    found = {r["period"]: (r["min_fos"], r["failure_probability"]) for r in checks.slope_periods(plan, slopes, ["wall"]).collect()}
    assert found[1] == pytest.approx((0.8, 0.2)) and found[2] == (0.8, 0.5) and found[3] == (None, None)
    every = {r["period"]: (r["min_fos"], r["failure_probability"]) for r in checks.slope_periods(plan, slopes, worst=True).collect()}
    assert set(every.values()) == {(0.8, 0.3)} and len(every) == 3


def test_held_out(spark):
    samples = spark.createDataFrame([(i, float(i), 0.0, 0.0, 2.0 * i) for i in range(60)], "sample_id int, x double, y double, z double, v double")
    rows, scores = checks.held_out(samples, "v", 0.3, k=2)
    assert scores.first()["n"] == rows.count() and 8 < rows.count() < 30
    own = checks.held_out(samples, "v", 0.3, k=4, refit=False)[1].first()  # every sample is among its own neighbours
    assert own["mae"] == pytest.approx(0.0, abs=1e-9) and own["r2"] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        checks.held_out(samples, "v", 1.0)


def test_hazards(spark):
    events = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 2.0), (2, 50.0, 0.0, 0.0, 1.0), (3, None, 0.0, 0.0, 1.0)], "event_id int, x double, y double, z double, magnitude double")
    grid = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 50.0, 0.0, 1.0), (3, 900.0, 0.0, 0.0)], "block_id int, x double, y double, z double")
    still = {(r["block_id"], r["realisation"]): r["hazard"] for r in simulation.hazard_realisations(events, grid, 10.0, 2, place=0.0, error=0.0).collect()}
    assert len(still) == 6 and still[1, 0] == 1.0 and still[2, 1] == pytest.approx(0.1) and still[3, 0] == 0.0
    drawn = simulation.hazard_realisations(events, grid, 30.0, 8, place=3.0)
    nodes = {r["block_id"]: r for r in simulation.hazard_by_node(drawn, 0.5).collect()}
    assert nodes[1]["exceedance"] > nodes[2]["exceedance"] and nodes[3]["greatest"] == 0.0
    assert simulation.hazard_summary(drawn).first()["greatest"] == 1.0
    assert sorted(drawn.repartition(7).collect()) == sorted(drawn.collect())
    assert simulation.hazard_realisations(events.where("event_id < 0"), grid, 10.0, 2).where(F.col("hazard") == 0).count() == 6


def test_block_model_faults(spark):
    names = "block_id int, x double, y double, z double, Volume double, density double, tonnes double, fe double"
    blocks = spark.createDataFrame([(1, -5.0, 0.0, 0.0, 10.0, 2.0, 20.0, 60.0), (2, 0.0, 0.0, 0.0, -1.0, 2.0, 5.0, 120.0), (3, 0.0, 0.0, 0.0, None, float("nan"), 5.0, None)], names)
    found = {(r["check"], r["column"]): (r["severity"], r["n"], r["worst"]) for r in validation.block_model(blocks, {"fe": "percent"}, 4).collect()}
    assert found == {("negative", "Volume"): ("ERROR", 1, -1.0), ("tonnage", "tonnes"): ("WARNING", 1, 7.0), ("unit", "fe"): ("WARNING", 1, 120.0), ("coverage", "block_id"): ("WARNING", 3, 4.0)}
    assert validation.block_model(blocks.where("block_id = 1"), {"fe": "percent"}, 1).count() == 0
    assert {r["column"] for r in validation.block_model(blocks.drop("density"), {"cu": "ppm"}).collect()} == {"density", "cu"}


def test_rules_of_domains(spark):
    rows = spark.createDataFrame([("a", 100.0, None), ("b", 100.0, 60.0), ("c", 4.0, 0.0)], "domain string, range double, spacing double")
    found = {(r["domain"], r["class"]): r["distance"] for r in modelling.domain_rules(rows).collect()}
    assert [found["a", c] for c in ("Measured", "Indicated", "Inferred")] == pytest.approx([25.0, 67.0, 100.0])
    assert [found["b", c] for c in ("Measured", "Indicated", "Inferred")] == pytest.approx([45.0, 90.0, 150.0])
    assert {found["c", c] for c in ("Measured", "Indicated", "Inferred")} == {10.0}


def test_reordered(spark):
    plan = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "pushback string, place int")
    order = spark.createDataFrame([("d", 0), ("gone", 1), ("b", 2)], "pushback string, place int")
    assert {r["pushback"]: r["place"] for r in planning.reordered(plan, order).collect()} == {"d": 0, "b": 2, "a": 2, "c": 3}
    assert {r["pushback"]: r["place"] for r in planning.reordered(plan, order.where("place < 0")).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_rockbursts(spark):
    volumes = spark.createDataFrame([(1, 0, 0.5), (1, 1, 1.0), (2, 0, 0.0)], "block_id int, realisation int, hazard double")
    rock = spark.createDataFrame([(1, 30.0, 0.5), (2, 80.0, 1.0)], "block_id int, rating double, stress double")
    still = {(r["block_id"], r["realisation"]): r["hazard"] for r in simulation.rockburst_realisations(volumes, rock, 0.0, 0.0).collect()}
    assert still == pytest.approx({(1, 0): 0.3 + 0.15 + 0.05, (1, 1): 0.6 + 0.15 + 0.05, (2, 0): 0.15 + 0.1})


def test_gates(spark):
    data = spark.createDataFrame([(0.0, 1.0), (1.0, 2.0), (2.0, None)], "x double, v double")
    fits = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 4.0), ("d", None)], "direction string, nugget double")
    source = selection.table_hash(data.dropna(), ["x", "v"])
    found = variograms.gates(fits, data, ["x", "v"], source).first()
    assert (found["nuggets"], found["ratio"], found["nugget"], found["consistent"], found["lineage"], found["passed"]) == (3, 4.0, 2.0, False, True, False)
    assert variograms.gates(fits, data, ["x", "v"], source, 0.5, 4.0).first()["passed"]
    assert not variograms.gates(fits, data.where("x > 0"), ["x", "v"], source, tolerance=9.0).first()["passed"]
    none = variograms.gates(fits.where("nugget < 0"), data, ["x", "v"]).first()
    assert (none["nuggets"], none["ratio"], none["nugget"], none["passed"]) == (0, 1.0, 0.0, True)
    assert variograms.gates(spark.createDataFrame([(0.0,), (1.0,)], "nugget double"), data, ["v"]).first()["ratio"] == float("inf")


def test_short_nuggets(spark):
    rows = spark.createDataFrame([("h", 0.0, 1.0, 1.0), ("h", 1.0, 2.0, None), ("h", 2.0, 3.0, 4.0), ("g", 0.0, 1.0, 9.0)], "hole_id string, depth_from double, depth_to double, v double")
    assert [tuple(r) for r in variograms.short_nuggets(rows.withColumn("d", F.lit(1)), "v", ["d"]).collect()] == [(1, 4.5, 1)]

"""Operators on small fixtures whose results follow by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orebed.functions import economics, geometry, rock, variogram
from orebed.operators import aggregates, clustering, economics as money, intervals, kriging, processes, selection, simulation, spatial, structural, survey, timeseries, validation, variograms
from orebed.plans.jobs import Jobs
from orebed.sources import blockmodels
from orebed.streaming import monitors

HOLE = "hole_id string, depth_from double, depth_to double, g double"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_composites(spark):
    hole = spark.createDataFrame([("A", 0.0, 1.0, 1.0), ("A", 1.0, 3.0, 4.0)], HOLE)
    assert rows(intervals.fixed_length(hole, ["g"], 2.0), "depth_from", "depth_to", "g", "is_partial") == [(0.0, 2.0, 2.5, False), (2.0, 3.0, 4.0, True)]
    assert rows(intervals.fixed_length(hole, ["g"], 2.0, partial="discard"), "depth_from", "g") == [(0.0, 2.5)]
    assert rows(intervals.fixed_length(hole, ["g"], 2.0, partial="merge"), "depth_from", "depth_to", "g") == [(0.0, 3.0, 3.0)]
    null = spark.createDataFrame([("A", 0.0, 1.0, None), ("A", 1.0, 2.0, 4.0)], HOLE)
    assert rows(intervals.fixed_length(null, ["g"], 2.0), "g") == [(4.0,)]
    assert rows(intervals.fixed_length(null, ["g"], 2.0, null_as_zero=True), "g") == [(2.0,)]
    equal = spark.createDataFrame([("A", 0.0, 1.0, 1.0), ("A", 1.0, 2.0, 4.0)], HOLE)
    assert rows(intervals.indicator(equal, "g", 2.0, 2.0), "indicator") == [(0.5,)]
    assert rows(intervals.bench(hole, ["g"], 2.0, -1.0), "depth_from", "depth_to", "g") == [(0.0, 1.0, 1.0), (1.0, 3.0, 4.0)]
    dense = hole.withColumn("d", F.lit(2.0))
    assert rows(intervals.equal_mass(dense, ["g"], 4.0, "d"), "depth_from", "depth_to", "mass", "g") == [(0.0, 2.0, 4.0, 2.5), (2.0, 3.0, 2.0, 4.0)]
    assert rows(intervals.rolling(hole, ["g"], 2.0, 1.0), "depth_from", "g") == [(0.0, 2.5), (1.0, 4.0)]


def test_composites_keep_metal(spark):
    rng = np.random.default_rng(0)
    ends = np.cumsum(rng.uniform(0.2, 3.0, 60))
    data = [("A", float(a), float(b), float(g)) for a, b, g in zip([0, *ends], ends, rng.uniform(0, 9, 60))]
    frame = spark.createDataFrame(data, HOLE)
    done = intervals.fixed_length(frame, ["g"], 2.5).agg(F.sum(F.col("g") * F.col("length"))).first()[0]
    assert math.isclose(done, sum((b - a) * g for _, a, b, g in data), rel_tol=1e-9)


def test_economic_runs(spark):
    hole = spark.createDataFrame([("A", 0.0, 5.0, 9.0), ("A", 5.0, 6.0, 1.0), ("A", 6.0, 10.0, 8.0), ("A", 10.0, 20.0, 0.0), ("A", 20.0, 21.0, 9.0)], HOLE)
    assert rows(intervals.economic(hole, "g", 5.0, 2.0, 2.0), "depth_from", "depth_to", "waste_length") == [(0.0, 10.0, 1.0)]


def test_validation(spark):
    frame = spark.createDataFrame([("A", 0.0, 2.0, 1.0), ("A", 1.5, 3.0, 1.0), ("A", 3.5, 4.0, 1.0), ("B", 0.0, 1.0, 1.0)], HOLE)
    collars = spark.createDataFrame([("A", 0.0, 0.0, 0.0, 10.0), ("C", 0.0, 0.0, None, -5.0), ("C", 0.0, 0.0, 0.0, 5.0)], "hole_id string, x double, y double, z double, length double")
    found = validation.intervals(frame, collars, "assays")
    assert rows(found, "rule_code", "depth") == [("GAP", 3.5), ("OVERLAP", 1.5)]
    assert rows(validation.orphans(frame, "assays", collars), "hole_id") == [("B",)]
    assert rows(validation.collars(collars), "rule_code") == [("DUPLICATE",), ("DUPLICATE",), ("MISSING",), ("NEGATIVE_TD",)]
    assert validation.verdict(found).first()[0] == "FAIL"
    assert rows(validation.short_holes(frame, collars, "assays"), "hole_id") == [("A",)]
    fixed = validation.fixed_intervals(frame, collars, snap=0.6)
    assert rows(fixed.where("hole_id = 'A'"), "depth_from", "depth_to") == [(0.0, 2.0), (2.0, 3.0), (3.0, 4.0)]
    kept, ignored = selection.without_ignored(found, spark.createDataFrame([("GAP", None, None)], "rule_code string, hole_id string, table_name string"))
    assert (rows(kept, "rule_code"), rows(ignored, "rule_code")) == ([("OVERLAP",)], [("GAP",)])


def test_survey_repair(spark):
    frame = spark.createDataFrame([("A", 0.0, 350.0, -60.0), ("A", 30.0, 10.0, -95.0)], "hole_id string, depth double, azimuth double, dip double")
    assert rows(validation.fixed_surveys(frame, 15.0), "depth", "azimuth", "dip") == [(0.0, 350.0, -60.0), (15.0, 0.0, -75.0), (30.0, 10.0, -90.0)]


def test_paths(spark):
    collars = spark.createDataFrame([("V", 1.0, 2.0, 100.0), ("S", 0.0, 0.0, 0.0)], "hole_id string, x double, y double, z double")
    surveys = spark.createDataFrame([("V", 0.0, 0.0, -90.0), ("V", 20.0, 0.0, -90.0), ("S", 10.0, 90.0, -45.0)], "hole_id string, depth double, azimuth double, dip double")
    stations = survey.desurvey(collars, surveys)
    last = stations.where("hole_id = 'S' and depth = 10").first()
    assert last["x"] == pytest.approx(10 / math.sqrt(2)) and last["z"] == pytest.approx(-10 / math.sqrt(2)) and last["y"] == pytest.approx(0)
    middle = spark.createDataFrame([("V", 5.0, 15.0), ("V", 30.0, 50.0)], "hole_id string, depth_from double, depth_to double")
    found = rows(survey.located(middle, stations, collars), "depth_from", "x", "y", "z")
    assert found[0] == pytest.approx((5.0, 1.0, 2.0, 90.0)) and found[1] == pytest.approx((30.0, 1.0, 2.0, 80.0))
    chain = survey.lineages(spark.createDataFrame([("c", "b"), ("b", "a")], "child string, parent string"))
    assert rows(chain, "node", "ancestor", "distance") == [("b", "a", 1), ("c", "a", 2), ("c", "b", 1)]


def test_declustering_and_curves(spark):
    points = spark.createDataFrame([(1.0, 1.0, 2.0), (2.0, 1.0, 4.0), (3.0, 3.0, 6.0), (15.0, 1.0, 10.0)], "x double, y double, v double")
    weights = aggregates.cell_weights(points, {"x": 10.0, "y": 10.0})
    assert weights.agg(F.sum("weight")).first()[0] == pytest.approx(2.0)
    one = aggregates.declustered(points, "v", [10.0]).first()
    assert (one["cells"], one["mean"], one["declustered_mean"]) == (2, 5.5, 7.0)
    blocks = spark.createDataFrame([(10.0, 1.0), (20.0, 2.0), (30.0, 3.0)], "t double, g double")
    assert rows(aggregates.grade_tonnage(blocks, "g", "t", [2.0, 5.0]), "cutoff", "tonnes", "grade", "metal") == [(2.0, 50.0, 2.6, 130.0), (5.0, 0.0, None, 0.0)]


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    data = [(i, *map(float, rng.uniform(0, 100, 3))) for i in range(300)]
    frame = spark.createDataFrame(data, "id long, x double, y double, z double")
    x = np.array([r[1:] for r in data])
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    near = spatial.nearest(frame, frame.withColumnRenamed("id", "other"), 4, 5.0, "id", "other").collect()
    assert {(r["target"], r["rank"]): r["point"] for r in near} == {(i, k + 1): int(j) for i in range(300) for k, j in enumerate(np.argsort(d[i], kind="stable")[:4])}
    for spread in ("targets", "points"):
        assert spatial.within(frame, frame.withColumnRenamed("id", "other"), 20.0, "id", "other", spread=spread).count() == (d <= 20).sum()
    assert spatial.pairs(frame, 20.0, "id").count() == ((d <= 20).sum() - 300) / 2


def test_kriging(spark):
    samples = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0), (1, 10.0, 0.0, 0.0, 2.0), (2, 0.0, 10.0, 0.0, 3.0), (3, 10.0, 10.0, 0.0, 6.0)], "sample_id long, x double, y double, z double, v double")
    model = {"model": "spherical", "nugget": 0.0, "sill": 1.0, "range": 50.0}
    at = spark.createDataFrame([(0, 10.0, 10.0, 0.0), (1, 5.0, 5.0, 0.0)], "block_id long, x double, y double, z double")
    for kind, mean in (("ordinary", None), ("simple", 3.0)):
        found = {r["block_id"]: r for r in kriging.krige(at, samples, "v", model, 4, kind=kind, mean=mean).collect()}
        assert found[0]["estimate"] == pytest.approx(6.0, abs=1e-4) and found[0]["variance"] == pytest.approx(0, abs=1e-4)
        assert found[1]["estimate"] == pytest.approx(3.0, abs=1e-4)
    few = kriging.krige(at, samples.limit(2), "v", model, 2).collect()
    assert all(r["estimate"] is None and r["variance"] is None for r in few)


def test_variogram_fit(spark):
    h = [(k, 5.0 * k, 100) for k in range(1, 21)]
    frame = spark.createDataFrame(h, "lag long, distance double, pairs long").withColumn("gamma", variogram.spherical(F.col("distance"), 60.0, 0.8, 0.2))
    fit = variograms.fitted(frame)
    assert fit["range"] == pytest.approx(60, rel=0.05) and fit["sill"] == pytest.approx(0.8, rel=0.05) and fit["nugget"] == pytest.approx(0.2, rel=0.15)


def test_simulation(spark):
    p = spark.createDataFrame([(v,) for v in (0.001, 0.02, 0.3, 0.5, 0.975, 0.999)], "p double")
    found = [r[0] for r in p.select(simulation.normal_quantile(F.col("p"))).collect()]
    assert found == pytest.approx([-3.090232306, -2.053748911, -0.524400513, 0.0, 1.959963985, 3.090232306], abs=1e-7)
    frame = spark.range(2000).select(F.col("id").alias("sample_id"), (F.col("id") * 7 % 2000).cast("double").alias("v"))
    scores = simulation.normal_scores(frame, "v")
    moments = scores.agg(F.avg("normal_score"), F.stddev_pop("normal_score"), F.corr("v", "normal_score")).first()
    assert abs(moments[0]) < 1e-6 and moments[1] == pytest.approx(1, abs=0.01) and moments[2] > 0.97
    assert scores.select("v").orderBy("normal_score").collect() == scores.select("v").orderBy("v").collect()
    draws = simulation.latin_hypercube(spark, 50, {"a": ("uniform", 0.0, 1.0), "b": ("normal", 10.0, 2.0)})
    assert draws.select(F.floor(F.col("a") * 50)).distinct().count() == 50
    assert draws.agg(F.avg("b")).first()[0] == pytest.approx(10, abs=0.2)
    paths = simulation.price_paths(spark, 20, 10, 100.0, 0.0, 0.2, 0.1)
    assert paths.count() == 220 and paths.where("price <= 0").count() == 0
    means = simulation.confidence(simulation.bootstrap_means(frame, "v", "sample_id", 60), "mean").first()
    assert means["low"] < 999.5 < means["high"]


def test_series(spark):
    levels = spark.sql("select 1 p, timestamp'2020-01-01' ts, 10.0D v union all select 1, timestamp'2020-12-31 06:00:00', 9.99D")
    last = timeseries.subsidence(levels, "p", "ts", "v").orderBy("ts").collect()[-1]
    assert last["change_mm"] == pytest.approx(-10) and last["velocity"] == pytest.approx(-10, rel=0.01)
    events = spark.sql("select timestamp'2024-01-01' + make_dt_interval(0, h) ts from values (0), (12), (29), (48) t(h)")
    assert rows(timeseries.event_rate(events, "ts", 1.0), "bin", "n", "total") == [(0, 2, 2), (1, 1, 3)]


def test_money(spark):
    flows = spark.createDataFrame([(1, [-100.0, 60.0, 60.0]), (2, [-100.0, 230.0, -132.0]), (3, [1.0, 2.0])], "s int, f array<double>")
    found = flows.select("s", economics.present_value(F.col("f"), 0.10).alias("npv"), economics.internal_rate(F.col("f")).alias("irr"), economics.sign_changes(F.col("f")).alias("n")).orderBy("s").collect()
    assert found[0]["npv"] == pytest.approx(4.1322314) and found[0]["irr"] == pytest.approx(0.130662, abs=1e-5)
    assert [r["n"] for r in found] == [1, 2, 0] and found[2]["irr"] is None
    units = spark.createDataFrame([("g", 1, 6.0), ("g", 2, 5.0), ("g", 3, 4.0)], "g string, k int, tonnes double")
    assert rows(money.bucket_filled(units, 10.0, "g", ["k"]), "k", "period") == [(1, 1), (2, 2), (3, 2)]
    trucks = spark.createDataFrame([("a", 5.0), ("b", 8.0), ("c", 4.0)], "route string, required double")
    assert rows(money.allocated_trucks(trucks, 10.0), "route", "allocated") == [("a", 2.0), ("b", 8.0), ("c", 0.0)]



def test_orientations(spark):
    frame = spark.createDataFrame([(30.0, 120.0), (80.0, 300.0), (0.0, 0.0)], "dip double, dd double")
    n = geometry.pole(F.col("dip"), F.col("dd"))
    back = frame.select("dip", "dd", *(c.alias(k) for k, c in zip(("bd", "bdd"), geometry.dip_and_direction(*n)))).collect()
    assert all(r["bd"] == pytest.approx(r["dip"], abs=1e-5) for r in back) and all(r["bdd"] == pytest.approx(r["dd"]) for r in back[:2])
    turned = frame.select(*(c.alias(k) for k, c in zip("xyz", geometry.from_schmidt(*geometry.schmidt(*n)))), *(c.alias(f"n{k}") for k, c in zip("xyz", n))).collect()
    assert all(r[k] == pytest.approx(r[f"n{k}"], abs=1e-9) for r in turned for k in "xyz")
    matrix = np.array(geometry.rotation(40, 20, 10))
    assert np.allclose(matrix @ matrix.T, np.eye(3))
    found = structural.wedges(spark.createDataFrame([(1, 60.0, 60.0), (2, 60.0, 180.0)], "k int, dip double, dip_direction double"), "k", 75.0, 120.0, 30.0).first()
    assert found["trend"] == pytest.approx(120.0) and found["feasible"]
    assert frame.select(rock.bond_energy(F.lit(12.0), 10000.0, 100.0)).first()[0] == pytest.approx(10.8)


def test_selection(spark):
    a, b = (spark.createDataFrame([(i,) for i in v], "k int") for v in ([1, 2, 3], [3, 4]))
    assert rows(selection.combined(a, b, "add", "k"), "k") == [(1,), (2,), (3,), (4,)]
    assert rows(selection.combined(a, b, "subtract", "k"), "k") == [(1,), (2,)]
    assert rows(selection.combined(a, b, "intersect", "k"), "k") == [(3,)]
    frame = spark.createDataFrame([("A", 1.0, 2.0, 3.0)], "BHID string, From double, TO double, Fe double")
    assert selection.canonical(frame).columns == ["hole_id", "depth_from", "depth_to", "Fe"]
    assert selection.grade_columns(selection.canonical(frame)) == ["Fe"]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("BHID;FROM;TO;FE\nA;0;1;5\nB;NA;2;6\n")
    good, bad = blockmodels.read_text_table(spark, str(tmp_path / "a.csv"), required=("hole_id", "depth_from"))
    assert (rows(good, "hole_id"), rows(bad, "hole_id")) == ([("A",)], [("B",)])
    (tmp_path / "c.csv").write_text("time,x,y,z,magnitude\n2024-01-01 00:00:00,1,2,3,0.5\nnever,1,2,3,1\n")
    events, lost = blockmodels.read_catalogue(spark, str(tmp_path / "c.csv"))
    assert events.count() == lost.count() == 1
    (tmp_path / "p.xyz").write_text("1 2 3\n4,5,6,7\nheader\n")
    assert rows(blockmodels.read_xyz(spark, str(tmp_path / "p.xyz")), "x", "y", "z") == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]
    wide = spark.createDataFrame([("A", 0.0, 1.0, 5.0, None)], "hole_id string, depth_from double, depth_to double, fe double, cu double")
    long = blockmodels.long_assays(wide, ["fe", "cu"])
    assert long.count() == 1 and rows(blockmodels.wide_assays(long, ["fe", "cu"]), "fe", "cu") == [(5.0, None)]
    blockmodels.write_table(wide, str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 1
    sizes = blockmodels.with_sizes(spark.createDataFrame([(0.0, 0.0, 0.0), (5.0, 0.0, 10.0), (20.0, 0.0, 30.0)], "x double, y double, z double")).first()
    assert (sizes["dx"], sizes["dy"], sizes["dz"]) == (5.0, 1.0, 10.0)


def test_jobs(spark):
    jobs, told = Jobs(spark), []
    jobs.register("curve", lambda s, p: aggregates.grade_tonnage(s.table("blocks"), "g", "t", p["cutoffs"]))
    jobs.listen("blocks", lambda name, df: told.append(name))
    jobs.table("blocks", spark.createDataFrame([(10.0, 1.0)], "t double, g double"))
    assert jobs.run("curve", cutoffs=[0.5]).count() == 1 and told == ["blocks"] and jobs.names() == ["curve"]


def test_streamed_rate(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(4).write.parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    stream = monitors.event_rate(monitors.chunked(spark, str(tmp_path / "in"), source.schema), late="60 days")
    run = stream.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    found = {r["start"]: r["n"] for r in spark.table("rates").collect()}
    assert found == {r["d"]: r["n"] for r in source.groupBy(F.date_trunc("day", "ts").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}


def test_clusters(spark):
    data = [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 2.0, 0.0), (3, 3.5, 0.0), (4, 50.0, 0.0), (5, 51.0, 0.0), (6, 52.0, 0.0), (7, 200.0, 0.0)]
    points = spark.createDataFrame([(i, x, y, 0.0) for i, x, y in data], "id long, x double, y double, z double")
    assert rows(clustering.density_clusters(points, "id", 1.5, 3), "id", "cluster") == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 5), (5, 5), (6, 5), (7, -1)]
    path = spark.createDataFrame([(i, i + 1) for i in range(20)], "u long, v long")
    assert {r["component"] for r in clustering.connected(path).collect()} == {0}
    scored = clustering.cluster_quality(spark.createDataFrame([(0, 0.0), (0, 1.0), (1, 10.0), (1, 11.0)], "cluster int, v double"), ["v"]).first()
    assert (scored["between"], scored["within"], scored["score"]) == (100.0, 1.0, 200.0)
    assert clustering.first_of_cell(points, "id", 10.0).count() == 3
    assert rows(clustering.ranked_cells(points.where("id < 2"), 1.0), "cell") == [(0,), (1,)]


def test_processes(spark):
    flows = spark.createDataFrame([("a", 1, 5.0, 0.0), ("a", 2, 9.0, 2.0), ("a", 3, 0.0, 50.0)], "node string, period int, inflow double, outflow double")
    assert rows(processes.water_balance(flows, 1.0, 10.0), "period", "stored", "spill") == [(1, 6.0, 0.0), (2, 10.0, 3.0), (3, 0.0, 0.0)]
    cave = spark.createDataFrame([("d", 25.0)], "id string, tonnes double")
    assert rows(processes.cave_draw(cave, 5, 10.0), "period", "drawn") == [(1, 10.0), (2, 10.0), (3, 5.0)]
    a, b = (spark.createDataFrame(v, "period int, volume double") for v in ([(1, 5.0), (2, 4.0)], [(2, 6.0)]))
    assert rows(processes.void_series(a, b), "period", "void") == [(1, 5.0), (2, 3.0)]
    shells = spark.createDataFrame([(i, float(i)) for i in range(5)], "shell int, depth double")
    assert rows(processes.pushbacks_by_depth(shells, 2), "shell", "pushback") == [(0, 1), (1, 1), (2, 2), (3, 2), (4, 2)]

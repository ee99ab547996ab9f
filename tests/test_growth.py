"""Work that must not grow faster than the input: counted on small tables."""

from pyspark.sql import functions as F

from orebed.llm import lm_scoring, quality_rules
from orebed.llm.common import label_ids
from orebed.operators import clustering, components, fields, running, spatial, structural, survey, validation


def _copies(spark, places, copies):
    return spark.range(places * copies).select("id", *((F.col("id") % places * m % 7).cast("double").alias(c) for c, m in zip("xyz", (1, 2, 3))), (F.col("id") % 5).cast("double").alias("v"))


def test_a_field_is_worked_out_once_a_place(spark, monkeypatch):
    seen, bands = [], fields.turning_bands
    monkeypatch.setattr(fields, "turning_bands", lambda rows, *more: (seen.append(rows.count()), bands(rows, *more))[1])
    nodes = _copies(spark, 5, 6).withColumnRenamed("id", "block_id")
    samples = _copies(spark, 4, 30).withColumnRenamed("id", "sample_id")
    model = {"model": "spherical", "nugget": 0.0, "sill": 1.0, "range": 5.0}
    found = {r["block_id"]: r["value"] for r in fields.conditioned_turning_bands(nodes, samples, "v", model, 0.0, 1, 4, k=2).collect()}
    assert seen == [5, 4] and len(found) == 30
    assert all(abs(found[i] - found[i % 5]) < 1e-12 for i in range(30))


def test_copies_of_a_place_make_no_dense_group(spark, monkeypatch):
    points, targets = _copies(spark, 3, 60), _copies(spark, 3, 1).withColumnRenamed("id", "t")
    wanted = {t: [t, t + 3] for t in range(3)}
    monkeypatch.setattr(spatial, "DENSE", 50)
    monkeypatch.setattr(spatial, "within", None)  # the way row by row
    found = {}
    for r in spatial.nearest(targets, points, 2, None, "t", "id").orderBy("target", "rank").collect():
        found.setdefault(r["target"], []).append(r["point"])
    assert found == wanted


def test_a_mesh_in_order_takes_one_round(spark, monkeypatch):
    stars, star = [], components._star
    monkeypatch.setattr(components, "_star", lambda *args, **more: (stars.append(1), star(*args, **more))[1])
    faces = spark.range(0, 300, 1, 1).select("id", (F.col("id") * 2).alias("a"), (F.col("id") * 2 + 1).alias("b"), F.when(F.col("id") % 100 == 99, -1 - F.col("id")).otherwise(F.col("id") * 2 + 2).alias("c"))
    found = {r["id"]: r["part"] for r in clustering.mesh_parts(faces, "id").collect()}
    assert found == {i: -1 - (i // 100 * 100 + 99) for i in range(300)}
    assert len(stars) == 2


def test_hubs_and_lone_nodes(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 3)
    monkeypatch.setattr(components, "PIECE", 4)
    edges = [(50, i) for i in range(30, 60)] + [(i, i + 100) for i in range(40, 45)] + [(7, 7), (5, None)]
    found = {r["node"]: r["component"] for r in clustering.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 30 for i in [*range(30, 60), *range(140, 145)]}, 7: 7, 5: 5, None: None}


def test_base_scores_need_no_filter(spark, monkeypatch):
    docs = spark.createDataFrame([(i, None if i == 3 else "a B c " * (i % 4) + f"w{i}") for i in range(30)], "doc_id long, text string")
    whole = lm_scoring.lm_scoring(docs).drop("score").orderBy("doc_id").collect()
    for name in ("made_filter", "_probed", "_probed_by_segment"):
        monkeypatch.setattr(lm_scoring, name, None)
    assert lm_scoring.base_scoring(docs).orderBy("doc_id").collect() == whole


def test_contacts_do_not_meet_by_unit(spark):
    contacts = spark.range(60).select((F.col("id") % 5).alias("hole_id"), F.col("id").cast("double").alias("depth"), F.when(F.col("id") % 7 < 3, "A").otherwise("N").alias("unit"))
    out = structural.stratigraphy(contacts, spark.createDataFrame([("A", 1), ("N", 2)], "unit string, rank int"), 1)
    assert "hashpartitioning(unit" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 5


def test_no_ancestor_is_found_twice(spark, monkeypatch):
    rows, written = [], survey.written
    monkeypatch.setattr(survey, "written", lambda df, name: (t := written(df, name), rows.append(t.count()))[0])
    edges = [(i, i - 1) for i in range(1, 21)] + [(30, 31), (31, 32), (32, 30), (20, 10)]
    found = {(r["node"], r["ancestor"]): r["distance"] for r in survey.lineages(spark.createDataFrame(edges, "child long, parent long")).collect()}
    want = {(i, j): i - j if i < 20 or j > 10 else min(i - j, 1 + 10 - j) for i in range(1, 21) for j in range(i)}
    want |= {(30 + a, 30 + b): (b - a) % 3 or 3 for a in range(3) for b in range(3)}
    assert found == want and sum(rows) == len(want)


def test_density_clusters_of_places(spark, monkeypatch):
    rows, written = {}, clustering.written
    monkeypatch.setattr(clustering, "written", lambda df, name: (t := written(df, name), rows.setdefault(name, t.count()))[0])
    points = spark.range(600).select("id", (F.col("id") % 3 * 10).cast("double").alias("x"), F.lit(0.0).alias("y"), F.when(F.col("id") != 599, 0.0).alias("z"))
    found = {r["id"]: r["cluster"] for r in clustering.density_clusters(points, "id", 1.0, 4).collect()}
    assert found == {**{i: i % 3 for i in range(599)}, 599: -1} and rows["cells"] == 3


def test_stations_are_read_once(spark):
    stations = spark.createDataFrame([(1, 5.0, 10.0, -60.0), (1, 9.0, 20.0, -70.0), (2, 0.0, 0.0, -90.0)], "hole_id long, depth double, azimuth double, dip double")
    collars = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0)], "hole_id long, x double, y double, z double")
    out = survey.desurvey(collars, stations)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
    assert [(r["hole_id"], r["depth"], r["azimuth"]) for r in out.orderBy("hole_id", "depth").collect()] == [(1, 0.0, 10.0), (1, 5.0, 10.0), (1, 9.0, 20.0), (2, 0.0, 0.0)]


def test_holes_are_counted_where_they_are(spark):
    found = spark.range(90).select(F.lit("s").alias("table_name"), F.lit("R").alias("rule_code"), F.lit("ERROR").alias("severity"), F.when(F.col("id") < 80, F.col("id") % 8).alias("hole_id")).repartition(4, "hole_id")
    out = validation.summary(found)
    assert [tuple(r) for r in out.collect()] == [("s", "R", "ERROR", 90, 8)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any("hole_id" in line and "ENSURE_REQUIREMENTS" in line for line in plan.splitlines())


def test_a_recurrence_of_short_groups_is_folded_once(spark):
    steps = spark.sparkContext.accumulator(0)

    def step(state, x):
        steps.add(1)
        total = (state[0] if state else 0.0) + x[0]
        return (total,), (total,)

    rows = spark.range(2000).select((F.col("id") % 400).alias("g"), "id", F.lit(1.0).alias("v"))
    found = running.folded(rows, ["g"], ["id"], [F.col("v")], step, {"sum": "double"}).collect()
    assert all(r["sum"] == r["id"] // 400 + 1 for r in found) and steps.value < 2100


def test_the_forest_and_its_cut_come_from_all_labelled_rows(spark, monkeypatch):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), (i * (F.col("id") % 97 + 1) % 89).cast("string")))).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 50 != 0).cast("int").alias("quality"))
    seen, cut = [], quality_rules.threshold
    monkeypatch.setattr(quality_rules, "threshold", lambda scores, n, lost: (seen.append((scores.where("label = 1").count(), n)), cut(scores, n, lost))[1])
    forest, at = quality_rules.fit(docs, labels, trees=8)
    ids = label_ids(labels, "quality").where("label = 1 and pmod(turn, 2) = 1").count()
    assert seen == [(ids, ids)] and ids > 2000 and 0 < at < 1
    other = quality_rules.fit(docs.repartition(7), labels.repartition(3), trees=8)
    assert other[1] == at and (other[0].split == forest.split).all()

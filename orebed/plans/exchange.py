"""Queries of files, selections, co-kriging and sampled stability, each with the same in SQL for DuckDB; they register beside those of :mod:`queries`."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import economics, rock
from ..operators import kriging, modelling, planning, selection, simulation
from ..operators.stored import shared_folder
from ..sources import projects
from . import tables as V
from .queries import _DIST, query, r, rounded
from .workflows import _MODEL, _between, _cov, _u


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/exchange-{uuid.uuid4().hex}"


@query(f"WITH {V.INTERVALS}, {V.COLLARS} SELECT 'assays' AS \"table\", count(*) AS n, {r('sum(depth_to - depth_from)', 'total', 2)}, 0::BIGINT AS rejected FROM intervals UNION ALL SELECT 'collars', count(*) FILTER (hole_id % 40 <> 9), {r('sum(x) FILTER (hole_id % 40 <> 9)', 'total', 2)}, count(*) FILTER (hole_id % 40 = 9) FROM collars")
def loaded_project(spark, sf_dir):
    """Tables under other headers are written as text and read as a project; collars without an elevation are rejected."""
    assays = V.intervals(spark, sf_dir).select(F.col("hole_id").alias("BHID"), F.col("depth_from").alias("FROM"), F.col("depth_to").alias("TO"), "grade")
    collars = V.collars(spark, sf_dir).select(F.col("hole_id").alias("HoleID"), F.col("x").alias("EASTING"), F.col("y").alias("NORTHING"), F.when(F.col("hole_id") % 40 != 9, F.col("z")).alias("RL"))
    files = projects.write_all({"assays": assays, "collars": collars}, _folder(spark))
    tables, lost = projects.read_project(spark, files, sep=",")
    one = lambda n, c: tables[n].agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(c), 2).alias("total")).select(F.lit(n).alias("table"), "n", "total")
    return one("assays", F.col("depth_to") - F.col("depth_from")).unionByName(one("collars", F.col("x"))).join(lost, "table")


@query("SELECT 'orientation' AS format, CASE WHEN p_partkey % 4 = 0 THEN 'fault' ELSE p_brand END AS feature_type, count(*) AS n, " + r("avg(p_partkey % 90)", "dip") + " FROM part GROUP BY 2")
def read_structures(spark, sf_dir):
    key = F.col("p_partkey")
    rows = V.table(spark, sf_dir, "part").select((key % 1000).alias("x"), (key % 700).alias("y"), (key % 50).alias("z"), (key % 90).alias("dip"), (key % 360).alias("azimuth"), F.when(key % 4 != 0, F.col("p_brand")).alias("feature_type"))
    path = projects.write_all({"structures": rows}, _folder(spark))["structures"]
    kind, read = projects.read_structures(spark, path)
    return rounded(read.groupBy(F.lit(kind).alias("format"), "feature_type").agg(F.count(F.lit(1)).alias("n"), F.avg("dip").alias("dip")))


@query("SELECT n_name AS name, 3::BIGINT AS version, (n_nationkey * 3)::BIGINT AS npv FROM nation WHERE n_name = 'NATION_6' UNION ALL SELECT n_name, 1, n_nationkey::BIGINT FROM nation WHERE n_name = 'NATION_3'")
def stored_scenarios(spark, sf_dir):
    rows = V.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("version"), F.col("n_nationkey").alias("_k"))
    folder = _folder(spark)
    projects.save_scenarios(rows.select("name", "version", (F.col("_k") * F.col("version")).alias("npv")), folder)
    return projects.scenario(spark, folder, "NATION_6").unionByName(projects.scenario(spark, folder, "NATION_3", 1)).select("name", "version", "npv")


@query("SELECT n_name AS name, length(n_name) + 1 AS length, sha256(n_name || chr(10)) AS checksum FROM nation WHERE n_regionkey = 1")
def catalogued_files(spark, sf_dir):
    folder = _folder(spark)
    names = V.table(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_name", F.col("n_name").alias("name"))
    names.write.partitionBy("name").text(folder)
    files = projects.catalogue(spark, folder, "part-*")
    return files.select(F.replace(F.url_decode(F.regexp_extract("path", "name=([^/]+)", 1)), F.lit("+"), F.lit(" ")).alias("name"), "length", "checksum")


@query(f"WITH {V.BLOCKS} SELECT class, count(*) AS n, {r('sum(x)', 'east', 2)} FROM blocks WHERE class IN ('Measured', 'Indicated') GROUP BY 1")
def classified_blocks(spark, sf_dir):
    rows = projects.for_exchange(selection.of_classes(V.blocks(spark, sf_dir)))
    return rows.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("XC"), 2).alias("east"))


@query("SELECT 'grade' AS variable, true AS valid, NULL::VARCHAR AS reason UNION ALL SELECT 'domain', false, 'not numeric' UNION ALL SELECT 'silver', false, 'not found'")
def usable_variables(spark, sf_dir):
    rows = V.blocks(spark, sf_dir)
    return selection.usable_variable(rows, "grade").unionByName(selection.usable_variable(rows, "domain")).unionByName(selection.usable_variable(rows, "silver"))


@query("SELECT p_partkey AS id, " + r("p_retailprice / CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 WHEN 3 THEN 31.1034768 WHEN 4 THEN 453.59237 END::DOUBLE", "price", 8) + " FROM part")
def converted_prices(spark, sf_dir):
    key = F.col("p_partkey")
    unit = F.element_at(F.array(*map(F.lit, ("g", "kg", "T", "oz", "LB", "bag"))), (key % 6 + 1).cast("int"))
    return rounded(V.table(spark, sf_dir, "part").select(key.alias("id"), economics.price_per_gram(F.col("p_retailprice"), unit).alias("price")), 8)


_NEAREST = f"near AS (SELECT block_id, s.x, s.y, s.z, value, {_DIST} AS d, row_number() OVER (PARTITION BY block_id ORDER BY {_DIST}, sample_id) AS k FROM targets t, samples s)"


@query(f"WITH {V.TARGETS}, {V.SAMPLES}, {_NEAREST}, c AS (SELECT block_id, (value - 45) / 15 AS v, {_cov('d')} / 220 AS c, (block_id % 9 - 4) / 2::DOUBLE AS s FROM near WHERE k = 1), w AS (SELECT *, (c - 0.36 * c) / (1 + 1e-10 - 0.36 * c * c) AS w1, (0.6 * (1 + 1e-10) - 0.6 * c * c) / (1 + 1e-10 - 0.36 * c * c) AS w2 FROM c) SELECT block_id, {r('45 + 15 * (w1 * v + w2 * s)', 'estimate')}, {r('225 * greatest(1 - w1 * c - w2 * 0.6, 0)', 'variance')}, 1 AS n FROM w")
def collocated_cokriging(spark, sf_dir):
    targets = V.targets(spark, sf_dir).withColumn("second", 10 + F.col("block_id") % 9)
    return rounded(kriging.collocated(targets, V.samples(spark, sf_dir), "value", "second", _MODEL, 0.6, (45.0, 15.0, 14.0, 2.0), 1))


@query(f"WITH {V.TARGETS}, {V.SAMPLES}, {_NEAREST} SELECT a.block_id, {r('CASE WHEN ' + _between('a', 'b') + ' = 0 THEN 0 ELSE b.value / ' + _between('a', 'b') + ' * a.d + a.value / ' + _between('a', 'b') + ' * b.d END', 'estimate')}, 2 AS n FROM near a JOIN near b ON a.block_id = b.block_id AND a.k = 1 AND b.k = 2")
def radial_functions(spark, sf_dir):
    return rounded(kriging.radial(V.targets(spark, sf_dir), V.samples(spark, sf_dir), "value", 2))


@query(f"WITH d AS (SELECT s_suppkey AS id, i, (5 + s_suppkey % 10 + {_u(1, 's_suppkey', 'i')} * 4) * (0.5 + {_u(2, 's_suppkey', 'i')} * 0.5) * 0.8 * (2 + {_u(3, 's_suppkey', 'i')} * 2) AS n FROM supplier, (SELECT unnest(range(20)) AS i)) SELECT id, count(*) AS n, {r('avg((n / 16 < 1)::INT)', 'failure_probability')} FROM d GROUP BY id")
def sampled_stability(spark, sf_dir):
    u = lambda k: simulation.uniform(k, F.col("id"), F.col("i"))
    rows = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i"))
    number = rock.stability_number(5 + F.col("id") % 10 + u(1) * 4, 0.5 + u(2) * 0.5, F.lit(0.8), 2 + u(3) * 2)
    return rounded(planning.failure_share(rows.select("id", (number / 16).alias("f")), "f", ["id"]))


@query(f"WITH {V.BLOCKS}, a AS (SELECT CASE domain WHEN 'A' THEN 50 WHEN 'N' THEN 38 ELSE 45 END AS angle FROM blocks) SELECT angle::BIGINT AS angle, count(*) AS n FROM a GROUP BY 1")
def slope_angles(spark, sf_dir):
    angles = spark.createDataFrame([("A", "50"), ("N", "38")], "domain string, ore_type string")
    rows = modelling.mapped_types(V.blocks(spark, sf_dir), angles, "domain", other="45")
    return rows.groupBy(F.col("ore_type").cast("long").alias("angle")).agg(F.count(F.lit(1)).alias("n"))

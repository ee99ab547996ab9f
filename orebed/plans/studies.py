"""Queries of studies: cell sizes, contours, risk, materials, regions, value scenarios, each with the same in SQL for DuckDB; they register beside those of :mod:`queries`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, rock
from ..operators import aggregates, clustering, reporting, simulation, spatial
from . import tables as V
from .expressions import _lines
from .queries import _DIST, query, r, rounded
from .workflows import _DRAWS, _draws, _normal, _u


@query(f"WITH {V.SAMPLES}, s AS (SELECT *, unnest([20, 40, 60, 80, 100, 120])::DOUBLE AS size FROM samples), c AS (SELECT size, floor(x / size) AS a, floor(y / size) AS b, avg(value) AS m FROM s GROUP BY ALL), d AS (SELECT size, avg(m) AS m FROM c GROUP BY 1), h AS (SELECT size, abs(m - lag(m) OVER (ORDER BY size)) / abs(lag(m) OVER (ORDER BY size)) AS h FROM d) SELECT coalesce(min(size) FILTER (h < 0.001), arg_min(size, h)) AS size, count(*) FILTER (h < 0.001) > 0 AS stable FROM h")
def recommended_cell_size(spark, sf_dir):
    curve = aggregates.declustered(V.samples(spark, sf_dir), "value", [20.0, 40.0, 60.0, 80.0, 100.0, 120.0])
    return reporting.recommended_cell_size(curve)


@query(f"WITH {V.SAMPLES}, e AS (SELECT max(value) AS hi, min(value) AS lo FROM samples WHERE value > 0), k AS (SELECT unnest(range(5))::INT AS level), p AS (SELECT level, quantile_cont(value, [0.1, 0.325, 0.55, 0.775, 1.0])[level + 1] AS v FROM samples, k WHERE value > 0 GROUP BY level) SELECT level, {r('hi / 5 * (level + 1)', 'linear')}, {r('lo * pow(hi / lo, level / 4.0::DOUBLE)', 'steps')}, {r('p.v', 'percentile')} FROM e, k JOIN p USING (level)")
def contour_levels(spark, sf_dir):
    rows = V.samples(spark, sf_dir)
    one = lambda kind, name: reporting.contour_levels(rows, "value", 5, kind).withColumnRenamed("value", name)
    return rounded(one("linear", "linear").join(one("log", "steps"), "level").join(one("percentile", "percentile"), "level"))


@query(f"WITH {V.BLOCKS}, {_DRAWS}, p AS (SELECT period, sum(tonnes) AS t, sum(tonnes * grade) / 100 AS m FROM blocks GROUP BY 1), v AS (SELECT draw, price, mining, recovery, sum((m * recovery * price - t * (mining + processing)) * pow(1.08::DOUBLE, -period)) AS npv FROM draws, p GROUP BY ALL) SELECT unnest(['price', 'mining', 'recovery']) AS input, 'npv' AS output, {r('unnest([corr(price, npv), corr(mining, npv), corr(recovery, npv)])', 'r')} FROM v")
def input_correlations(spark, sf_dir):
    from ..operators import planning

    draws = _draws(spark)
    values = planning.simulated_values(V.blocks(spark, sf_dir), draws, 0.08)
    return rounded(reporting.correlations(draws.join(values, "draw"), ["price", "mining", "recovery"], ["npv"]))


@query(f"WITH {V.BLOCKS}, l AS (SELECT quantile_cont(grade2, 0.005) AS lo, quantile_cont(grade2, 0.995) AS hi FROM blocks) SELECT block_id, {r('greatest(greatest(least(density + 0.85 * (grade - density), hi), lo), 0)', 'filtered')} FROM blocks, l")
def filtered_estimates(spark, sf_dir):
    rows = V.blocks(spark, sf_dir)
    return rounded(reporting.filtered_estimates(rows.select("block_id", "grade", "density"), "grade", "density", rows, "grade2", positive=True).select("block_id", "filtered"))


@query(f"WITH {V.BLOCKS} SELECT count(*) AS blocks, {r('sum(density * 6250)', 'tonnes', 2)}, {r('avg(grade)', 'grade')}, {r('sum(density * 6250) * avg(grade) / 1e6', 'metal')} FROM blocks WHERE grade >= 4")
def plain_resources(spark, sf_dir):
    out = rounded(reporting.plain_resources(V.blocks(spark, sf_dir), "grade", ">=", 4.0, 6250.0, F.col("density")))
    return out.withColumn("tonnes", F.round("tonnes", 2))


_RISK = "p AS (SELECT period, sum(tonnes) AS t, avg(CASE WHEN block_id % 4 <> 0 THEN grade END) AS a, avg(CASE WHEN block_id % 4 <> 0 THEN grade2 END) AS b FROM blocks GROUP BY 1)"


@query(f"WITH {V.BLOCKS}, {_RISK} SELECT period, {r('t', 'tonnes')}, {r('coalesce(a, 0)', 'hazard')}, {r('coalesce(b, 0)', 'slope')}, {r('coalesce(a, 0) * 0.75 + coalesce(b, 0) * 0.25', 'risk')} FROM p")
def risk_profile(spark, sf_dir):
    blocks = V.blocks(spark, sf_dir)
    places = blocks.where("block_id % 4 != 0").select("block_id", F.col("grade").alias("hazard"), F.col("grade2").alias("slope"))
    return rounded(reporting.risk_profile(blocks.select("block_id", "period", "tonnes"), places, {"hazard": 3.0, "slope": 1.0}))


@query(f"WITH {V.BLOCKS}, a AS (SELECT period, sum(tonnes) AS v FROM blocks WHERE domain = 'A' GROUP BY 1), b AS (SELECT period, sum(tonnes) AS v FROM blocks WHERE domain = 'N' GROUP BY 1) SELECT period, {r('coalesce(a.v, 0)', 'base')}, {r('coalesce(b.v, 0)', 'other')}, {r('coalesce(b.v, 0) - coalesce(a.v, 0)', 'difference')}, {r('100 * (coalesce(b.v, 0) - coalesce(a.v, 0)) / nullif(coalesce(a.v, 0), 0)', 'percent')} FROM a FULL JOIN b USING (period)")
def profile_differences(spark, sf_dir):
    per = lambda d: V.blocks(spark, sf_dir).where(F.col("domain") == d).groupBy("period").agg(F.sum("tonnes").alias("v"))
    return rounded(reporting.profile_differences(per("A"), per("N"), "period", "v"))


@query(f"WITH {V.BLOCKS}, p AS (SELECT x, y, z, count(*) AS n FROM blocks GROUP BY ALL), c AS (SELECT sum(n) AS m FROM p GROUP BY floor(x / 50), floor(y / 50), floor(z / 50)) SELECT (SELECT count(*) FROM blocks) AS points, 0::BIGINT AS missing, (SELECT sum(n - 1)::BIGINT FROM p) AS repeated, {r('(SELECT avg(m) FROM c)', 'per_cell')}, max(x) - min(x) AS dx, max(y) - min(y) AS dy, max(z) - min(z) AS dz FROM p")
def scan_quality(spark, sf_dir):
    return rounded(reporting.scan_quality(V.blocks(spark, sf_dir), 50.0))


@query("WITH g AS (SELECT p_partkey AS id, (p_partkey * 7 % 101)::DOUBLE AS g, (p_size * 6)::DOUBLE AS rg, (p_partkey * 3 % 50)::DOUBLE AS sp FROM part), d AS (SELECT *, least(greatest(greatest(0.25 * rg, 0.75 * sp), 10), 500) AS m, least(greatest(greatest(0.67 * rg, 1.5 * sp), 10), 500) AS i, least(greatest(greatest(rg, 2.5 * sp), 10), 500) AS f FROM g) SELECT id, CASE WHEN g >= 75 THEN 45 WHEN g >= 50 THEN 40 WHEN g >= 25 THEN 35 ELSE 30 END::DOUBLE AS friction_angle, CASE WHEN g >= 75 THEN 500 WHEN g >= 50 THEN 300 WHEN g >= 25 THEN 150 ELSE 50 END::DOUBLE AS cohesion, CASE WHEN g >= 75 THEN 27 WHEN g >= 50 THEN 26 WHEN g >= 25 THEN 25 ELSE 24 END::DOUBLE AS unit_weight, " + ", ".join((r("CASE WHEN g < 25 THEN 0.1 * g ELSE 0.5 + 0.01 * g END", "mb", 6), r("CASE WHEN g < 25 THEN 0.001 ELSE 0.01 * (g - 25) / 75 END", "s", 6), r("CASE WHEN g < 25 THEN 0.5 ELSE 0.5 - 0.01 * (g - 25) / 75 END", "a", 6), r("greatest(least(m, 0.8 * i), 10)", "measured", 6), r("greatest(least(i, 0.8 * f), 10)", "indicated", 6), r("f", "inferred", 6))) + " FROM d")
def rock_materials(spark, sf_dir):
    key = F.col("p_partkey")
    rows = V.table(spark, sf_dir, "part").select(key.alias("id"), (key * 7 % 101).cast("double").alias("g"), (F.col("p_size") * 6).cast("double").alias("rg"), (key * 3 % 50).cast("double").alias("sp"))
    both = {**rock.material(F.col("g")), **rock.spacing_rules(F.col("rg"), F.col("sp"))}
    return rounded(rows.select("id", *(c.alias(n) for n, c in both.items())), 6)


@query("WITH RECURSIVE f AS (SELECT p_partkey AS id, p_partkey * 3 AS a, p_partkey * 3 + 1 AS b, CASE WHEN p_partkey % 5 = 0 THEN p_partkey * 3 + 2 ELSE (p_partkey + 1) * 3 END AS c FROM part), e AS (SELECT a AS u, b AS v FROM f UNION ALL SELECT b, c FROM f UNION ALL SELECT b, a FROM f UNION ALL SELECT c, b FROM f), reached AS (SELECT u, v FROM e UNION SELECT reached.u, e.v FROM reached JOIN e ON e.u = reached.v) SELECT id, min(v) AS part FROM f JOIN reached ON u = a GROUP BY id")
def mesh_parts(spark, sf_dir):
    key = F.col("p_partkey")
    faces = V.table(spark, sf_dir, "part").select(key.alias("id"), (key * 3).alias("a"), (key * 3 + 1).alias("b"), F.when(key % 5 == 0, key * 3 + 2).otherwise((key + 1) * 3).alias("c"))
    return clustering.mesh_parts(faces, "id")


@query(f"WITH RECURSIVE {V.SAMPLES}, n AS (SELECT sample_id, x, y, z, -sin(radians(sample_id * 13 % 90)) * sin(radians(sample_id * 29 % 360)) AS nx, -sin(radians(sample_id * 13 % 90)) * cos(radians(sample_id * 29 % 360)) AS ny, -cos(radians(sample_id * 13 % 90)) AS nz FROM samples), k AS (SELECT t.sample_id AS u, s.sample_id AS v, abs(t.nx * s.nx + t.ny * s.ny + t.nz * s.nz) AS dot, row_number() OVER (PARTITION BY t.sample_id ORDER BY {_DIST}, s.sample_id) AS k FROM n t, n s), e AS (SELECT u, v FROM k WHERE k <= 5 AND u <> v AND dot >= cos(radians(25)) UNION SELECT v, u FROM k WHERE k <= 5 AND u <> v AND dot >= cos(radians(25)) UNION SELECT sample_id, sample_id FROM n), reached AS (SELECT u, v FROM e UNION SELECT reached.u, e.v FROM reached JOIN e ON e.u = reached.v) SELECT u AS sample_id, min(v) AS region FROM reached GROUP BY u")
def grown_regions(spark, sf_dir):
    key = F.col("sample_id")
    normal = geometry.pole((key * 13 % 90).cast("double"), (key * 29 % 360).cast("double"))
    points = V.samples(spark, sf_dir).select("sample_id", "x", "y", "z", *(c.alias(n) for c, n in zip(normal, ("nx", "ny", "nz"))))
    return clustering.grown_regions(points, "sample_id", 4, 25.0)


_GRADES = f"g AS (SELECT block_id, i AS scenario, exp(ln(grade) - 0.5 * 0.3 * 0.3 + 0.3::DOUBLE * {_normal(1, 'i', 'block_id')}) AS g, tonnes, period FROM blocks, (SELECT unnest(range(1, 4)) AS i) WHERE grade > 0)"


@query(f"WITH {V.BLOCKS}, {_GRADES}, {_DRAWS}, p AS (SELECT scenario, period, sum(tonnes * g) AS m, sum(tonnes) AS t FROM g GROUP BY ALL) SELECT scenario::INT AS scenario, draw, {r('sum((m * recovery * price / 100 - t * (mining + processing)) * pow(1.08::DOUBLE, -period))', 'npv', 2)} FROM p, draws GROUP BY ALL")
def value_scenarios(spark, sf_dir):
    blocks = V.blocks(spark, sf_dir)
    grades = simulation.grade_scenarios(blocks, "grade", 0.3, 3)
    return rounded(simulation.value_scenarios(grades, blocks, _draws(spark), 0.08), 2)


@query(f"WITH lines AS (SELECT p_partkey AS id, p_size::DOUBLE AS size, (p_partkey * 7 % 101)::DOUBLE AS share FROM part), d AS (SELECT id, least(greatest(share + ({_u(1, 'id', 'i')} - 0.5) * 20, 0), 100) AS rmr, 30 + size AS angle FROM lines, (SELECT unnest(range(15)) AS i)), c AS (SELECT id, least(greatest((100 - rmr) / 100 * 40 + least(30, greatest(angle - CASE WHEN rmr >= 80 THEN 70 WHEN rmr >= 60 THEN 60 WHEN rmr >= 40 THEN 50 WHEN rmr >= 20 THEN 40 ELSE 30 END, 0) / 10 * 30) + 10, 0), 100) AS i FROM d) SELECT id, count(*) AS n, {r('avg(i)', 'risk_index')}, {r('avg(CASE WHEN i < 25 THEN 0.05 WHEN i < 50 THEN 0.15 WHEN i < 75 THEN 0.4 ELSE 0.7 END)', 'failure_probability')} FROM c GROUP BY id")
def sampled_slopes(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(14))))
    rating = F.greatest(F.least(F.col("share") + (simulation.uniform(1, F.col("id"), F.col("i")) - 0.5) * 20, F.lit(100.0)), F.lit(0.0))
    risk = rock.slope_risk(F.col("rmr"), 30 + F.col("size"), F.lit(0.0), F.lit(True))
    rows = rows.withColumn("rmr", rating)
    return rounded(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.avg(risk["risk_index"]).alias("risk_index"), F.avg(risk["failure_probability"]).alias("failure_probability")))


@query(f"WITH {V.SAMPLES}, k AS (SELECT t.sample_id, {_DIST} AS d, row_number() OVER (PARTITION BY t.sample_id ORDER BY {_DIST}, s.sample_id) AS k FROM samples t, samples s WHERE s.sample_id <> t.sample_id), n AS (SELECT d FROM k WHERE k = 1) SELECT {r('median(d)', 'lag')}, {r('quantile_cont(d, 0.9)', 'wide')} FROM n")
def variogram_lags(spark, sf_dir):
    """The lag of a variogram from the distance to the nearest other sample."""
    from ..operators.running import quantiles

    samples = V.samples(spark, sf_dir)
    near = spatial.nearest(samples, samples.withColumnRenamed("sample_id", "_other"), 2, None, "sample_id", "_other").where(F.col("target") != F.col("point"))
    first = near.groupBy("target").agg(F.min("distance").alias("d"))
    return rounded(quantiles(first, "d", {"lag": 0.5, "wide": 0.9}))

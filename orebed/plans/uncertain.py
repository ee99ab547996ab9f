"""Queries of soft data and of checks on assembled tables, each with the same in SQL for DuckDB; they register beside those of :mod:`queries`."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import checks, kriging, modelling, planning, selection, simulation, soft, validation, variograms
from ..operators.running import ranked
from ..operators.stored import shared_folder
from . import tables as V
from .exchange import _NEAREST
from .queries import _DIST, _MODEL, query, r, rounded
from .workflows import _NEAR, _TWO, _between, _cov, _normal, _u


def _soft(spark, sf_dir):
    """Customers as soft points; one in forty has no variance."""
    key = F.col("c_custkey")
    return V.table(spark, sf_dir, "customer").select(key.alias("soft_id"), (key * 17 % 1000).cast("double").alias("x"), (key * 59 % 700).cast("double").alias("y"), (key * 11 % 200).cast("double").alias("z"), (20 + key % 60).cast("double").alias("mean"), (key % 40 * 5).cast("double").alias("variance"))


_SOFT = "soft AS (SELECT c_custkey AS soft_id, (c_custkey * 17 % 1000)::DOUBLE AS x, (c_custkey * 59 % 700)::DOUBLE AS y, (c_custkey * 11 % 200)::DOUBLE AS z, (20 + c_custkey % 60)::DOUBLE AS mean, (c_custkey % 40 * 5)::DOUBLE AS variance FROM customer)"
_BESIDE = f"beside AS (SELECT block_id, mean AS m, variance AS v FROM (SELECT block_id, mean, variance, {_DIST} AS d, row_number() OVER (PARTITION BY block_id ORDER BY {_DIST}, soft_id) AS k FROM targets t, soft s) WHERE k = 1 AND variance > 0 AND d <= 120)"
_UPDATE = f"SELECT block_id, {r('CASE WHEN use THEN (estimate / variance + m * 0.5 / v) / (1 / variance + 0.5 / v) ELSE estimate END', 'estimate')}, {r('CASE WHEN use THEN 1 / (1 / variance + 0.5 / v) ELSE variance END', 'variance')}, n, use AS soft FROM (SELECT e.*, m, v, v IS NOT NULL AND estimate IS NOT NULL AND variance > 0 AS use FROM e LEFT JOIN beside USING (block_id))"


@query(f"WITH {V.TARGETS}, {V.SAMPLES}, {_SOFT}, {_NEAR}, {_TWO}, {_BESIDE}, e AS (SELECT block_id, w1 * v1 + w2 * v2 AS estimate, greatest(220 - w1 * c1 - w2 * c2 - mu, 0) AS variance, 2 AS n FROM o) {_UPDATE}")
def soft_kriging(spark, sf_dir):
    return rounded(soft.krige(V.targets(spark, sf_dir), V.samples(spark, sf_dir), _soft(spark, sf_dir), "value", _MODEL, 0.5, 120.0, k=2, least=2))


_SECOND = "second AS (SELECT sample_id, x, y, z, (10 + sample_id % 9)::DOUBLE AS value FROM samples)"


@query(f"""WITH {V.TARGETS}, {V.SAMPLES}, {_SOFT}, {_BESIDE}, {_SECOND}, n2 AS (SELECT block_id, value, {_DIST} AS d, row_number() OVER (PARTITION BY block_id ORDER BY {_DIST}, sample_id) AS k FROM targets t, second s),
 own AS (SELECT block_id, 14 + {_cov('d')} / (220 * (1 + 1e-10)) * (value - 14) AS second FROM n2 WHERE k = 1), {_NEAREST},
 c AS (SELECT block_id, (value - 45) / 15 AS v, {_cov('d')} / 220 AS c, (second - 14) / 2 AS s FROM near JOIN own USING (block_id) WHERE k = 1), w AS (SELECT *, (c - 0.36 * c) / (1 + 1e-10 - 0.36 * c * c) AS w1, (0.6 * (1 + 1e-10) - 0.6 * c * c) / (1 + 1e-10 - 0.36 * c * c) AS w2 FROM c),
 e AS (SELECT block_id, 45 + 15 * (w1 * v + w2 * s) AS estimate, 225 * greatest(1 - w1 * c - w2 * 0.6, 0) AS variance, 1 AS n FROM w) {_UPDATE}""")
def soft_cokriging(spark, sf_dir):
    """Co-kriging with a secondary kriged at the targets, updated by soft points."""
    samples = V.samples(spark, sf_dir).withColumn("second", (10 + F.col("sample_id") % 9).cast("double"))
    targets = soft.with_secondary(V.targets(spark, sf_dir), samples, "second", _MODEL, 14.0, k=1, least=1)
    return rounded(soft.collocated(targets, samples, _soft(spark, sf_dir), "value", "second", _MODEL, 0.6, (45.0, 15.0, 14.0, 2.0), 0.5, 120.0, k=1))


def _horner(x: str, k) -> str:
    out = repr(k[0])
    for v in k[1:]:
        out = f"({out} * {x} + {v!r})"
    return out


_A, _B = simulation.PROBABILITY
_TAIL = f"CASE WHEN abs(z) < 7.07106781186547 THEN exp(-z * z / 2) * {_horner('abs(z)', _A)} / {_horner('abs(z)', _B)} ELSE exp(-z * z / 2) / (abs(z) + 1 / (abs(z) + 2 / (abs(z) + 3 / (abs(z) + 4 / (abs(z) + 0.65))))) / 2.506628274631 END"
_OWN = "p AS (SELECT block_id, least(greatest(w1 * (v1 <= 25)::INT + w2 * (v2 <= 25)::INT, 0), 1) AS a, least(greatest(w1 * (v1 <= 45)::INT + w2 * (v2 <= 45)::INT, 0), 1) AS b, least(greatest(w1 * (v1 <= 65)::INT + w2 * (v2 <= 65)::INT, 0), 1) AS c FROM o), f AS (SELECT block_id, (a + least(a, b, c)) / 2 AS a, (greatest(a, b) + least(b, c)) / 2 AS b, (greatest(a, b, c) + c) / 2 AS c FROM p)"


@query(f"""WITH {V.TARGETS}, {V.SAMPLES}, {_SOFT}, {_NEAR}, {_TWO}, {_OWN}, {_BESIDE},
 g AS (SELECT block_id, i, CASE i WHEN 1 THEN a WHEN 2 THEN b ELSE c END AS p, v, ([25, 45, 65][i] - m) / sqrt(v) AS z FROM f LEFT JOIN beside USING (block_id), (SELECT unnest([1, 2, 3]) AS i)),
 h AS (SELECT block_id, i, CASE WHEN v IS NULL THEN p ELSE 0.6 * p + 0.4 * CASE WHEN z > 0 THEN 1 - {_TAIL} ELSE {_TAIL} END END AS p FROM g),
 k AS (SELECT block_id, i, least(greatest(max(p) OVER (PARTITION BY block_id ORDER BY i), 0), 1) AS p FROM h), l AS (SELECT block_id, max(p) FILTER (i = 1) AS a, max(p) FILTER (i = 2) AS b, max(p) FILTER (i = 3) AS c FROM k GROUP BY 1)
 SELECT block_id, {r('a', 'p0')}, {r('b', 'p1')}, {r('c', 'p2')}, {r('CASE WHEN a >= 0.5 THEN 25 WHEN b >= 0.5 THEN 25 + (0.5 - a) * 20 / (b - a) WHEN c >= 0.5 THEN 45 + (0.5 - b) * 20 / (c - b) ELSE 65 END', 'median')}, {r('(2 - a - b) * 10 + (2 - b - c) * 10', 'mean')} FROM l""")
def soft_indicator_kriging(spark, sf_dir):
    return rounded(soft.indicator(V.targets(spark, sf_dir), V.samples(spark, sf_dir), _soft(spark, sf_dir), "value", [25.0, 45.0, 65.0], _MODEL, 0.4, 120.0, k=2, least=2))


_CLASSES = "SELECT a * 15 + (b - a) * 35 + (c - b) * 55 + (1 - c) * 80 AS m, a * 225 + (b - a) * 1225 + (c - b) * 3025 + (1 - c) * 6400 AS s, t.* FROM f JOIN targets t USING (block_id)"


@query(f"WITH {V.TARGETS}, {V.SAMPLES}, {_NEAR}, {_TWO}, {_OWN}, g AS ({_CLASSES}) SELECT block_id AS soft_id, x, y, z, {r('m', 'mean')}, {r('greatest(s - m * m, 0)', 'variance')} FROM g")
def soft_points_of_distributions(spark, sf_dir):
    targets = V.targets(spark, sf_dir)
    found = kriging.indicator_kriging(targets, V.samples(spark, sf_dir), "value", [25.0, 45.0, 65.0], _MODEL, k=2, least=2).drop("mean")
    return rounded(soft.from_distribution(targets.join(found, "block_id"), ["p0", "p1", "p2"], [25.0, 45.0, 65.0], 5.0, 95.0))


@query(f"WITH {V.BLOCKS}, b AS (SELECT * FROM blocks WHERE domain = 'A') SELECT block_id AS soft_id, x, y, z, grade AS mean, {r('(SELECT var_pop(grade) FROM b)', 'variance')} FROM b")
def soft_points_of_blocks(spark, sf_dir):
    return rounded(soft.from_blocks(V.blocks(spark, sf_dir), "grade", None, F.col("domain") == "A"))


@query(f"WITH {_SOFT} SELECT soft_id, x, y, z, mean, {r('pow(sqrt(variance), 2)', 'variance')} FROM soft")
def soft_points_of_files(spark, sf_dir):
    """Soft points written as a delimited table with deviations, and read back."""
    path = f"{shared_folder(spark)}/soft-{uuid.uuid4().hex}"
    _soft(spark, sf_dir).select("soft_id", F.col("x").alias("X"), F.col("y").alias("Y"), F.col("z").alias("Z"), F.col("mean").alias("Grade"), F.sqrt("variance").alias("StdDev")).write.csv(path, header=True)
    return rounded(soft.read(spark, path, "soft_id"))


# --- assembled tables ---------------------------------------------------------------

_ASSAYS = V.LOGGED + ", assays AS (SELECT hole_id, CASE WHEN grade = 4 THEN NULL ELSE depth_from - CASE WHEN hole_id % 9 = 0 THEN 20 ELSE 0 END END AS depth_from, CASE WHEN grade = 6 AND density > 2.5 THEN NULL ELSE depth_to END AS depth_to, grade, density, CASE WHEN grade IN (2, 7) THEN lith_code END AS lith_code FROM logged), wrong AS (SELECT DISTINCT hole_id FROM assays WHERE hole_id % 17 = 5)"
_REASON = "CASE WHEN hole_id IN (FROM wrong) THEN 'validation_error' WHEN depth_from IS NULL THEN 'missing_from_depth' WHEN depth_to IS NULL THEN 'missing_to_depth' WHEN depth_to <= depth_from THEN 'zero_or_negative_length' WHEN depth_from < 0 OR depth_to < 0 THEN 'negative_depth' END"


def _assembled(spark, sf_dir):
    """Field assays, some without depths and most without a code, beside whole logs."""
    g, hole = F.col("grade"), F.col("hole_id")
    moved = F.when(g != 4, F.col("depth_from") - F.when(hole % 9 == 0, 20).otherwise(0))
    rows = V.logged(spark, sf_dir).withColumns({"depth_from": moved, "depth_to": F.when(~((g == 6) & (F.col("density") > 2.5)), F.col("depth_to")), "lith_code": F.when(g.isin(2, 7), F.col("lith_code"))})
    return checks.assembled(rows, V.intervals(spark, sf_dir), bad=rows.where(hole % 17 == 5), key=["hole_id"])


@query(f"""WITH {_ASSAYS}, fine AS (SELECT *, row_number() OVER () AS id FROM assays WHERE ({_REASON}) IS NULL), near AS (SELECT f.id, m.lith_code AS code, row_number() OVER (PARTITION BY f.id ORDER BY abs((f.depth_from + f.depth_to) / 2 - (m.depth_from + m.depth_to) / 2), m.depth_from + m.depth_to) AS k FROM fine f JOIN intervals m USING (hole_id))
 SELECT hole_id, {r('depth_from', 'depth_from')}, {r('depth_to', 'depth_to')}, grade, coalesce(lith_code, code) AS lith_code FROM fine JOIN near USING (id) WHERE k = 1""")
def assembled_intervals(spark, sf_dir):
    return rounded(_assembled(spark, sf_dir)[0].select("hole_id", "depth_from", "depth_to", "grade", "lith_code"))


@query(f"WITH {_ASSAYS} SELECT {_REASON} AS reason, count(*) AS n FROM assays WHERE ({_REASON}) IS NOT NULL GROUP BY 1")
def excluded_assays(spark, sf_dir):
    return _assembled(spark, sf_dir)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {V.LOGGED}, d AS (SELECT hole_id, depth_from - lag(depth_to) OVER (PARTITION BY hole_id ORDER BY depth_from, depth_to) AS d FROM logged) SELECT hole_id, count(*) FILTER (d > 0.001) AS gaps, count(*) FILTER (d < -0.001) AS overlaps FROM d GROUP BY 1 HAVING count(*) FILTER (abs(d) > 0.001) > 0")
def interval_breaks(spark, sf_dir):
    return checks.breaks(V.logged(spark, sf_dir))


# --- places, series, slopes, held-out samples -----------------------------------------

_APART = "(t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y)"


@query(f"""WITH {V.TARGETS}, {V.SAMPLES}, t AS (SELECT * FROM samples WHERE value > 30 ORDER BY {_u(42, 'sample_id')}, sample_id LIMIT 12), n AS (SELECT t.sample_id, s.block_id, t.x, t.y, t.z, s.x AS surface_x, s.y AS surface_y, s.z AS surface_z, {_DIST} AS distance, abs(t.z - s.z) AS vertical, sqrt({_APART}) AS horizontal, row_number() OVER (PARTITION BY t.sample_id ORDER BY {_DIST}, s.block_id) AS k FROM t, targets s)
 SELECT sample_id, block_id, x, y, z, surface_x, surface_y, surface_z, {r('distance', 'distance')}, vertical, {r('horizontal', 'horizontal')} FROM n WHERE k = 1""")
def surface_spot_checks(spark, sf_dir):
    """Twelve samples beside the nearest of the surface's vertices."""
    return rounded(checks.spot_checks(V.samples(spark, sf_dir), V.targets(spark, sf_dir), 12, "sample_id", "block_id", F.col("value") > 30))


_DIGS = [("d1", True, (110.0, 60.0, 410.0, 310.0)), ("d2", False, (360.0, 210.0, 660.0, 440.0))]


@query(f"""WITH {V.BLOCKS}, digs AS (SELECT 'd1' AS id, 'ore' AS material, 110 AS x0, 60 AS y0, 410 AS x1, 310 AS y1 UNION ALL SELECT 'd2', 'waste', 360, 210, 660, 440)
 SELECT 'long_model' AS source, period::VARCHAR AS period, 'ore' AS material, {r('sum(density * 6250)', 'tonnes', 2)}, {r('avg(grade)', 'grade')}, {r('avg(grade2)', 'grade2')} FROM blocks GROUP BY period
 UNION ALL SELECT 'gc_model', id, material, {r('sum(density * 6250)', 'tonnes', 2)}, {r('avg(grade)', 'grade')}, {r('avg(grade2)', 'grade2')} FROM blocks JOIN digs ON x > x0 AND x < x1 AND y > y0 AND y < y1 GROUP BY id, material
 UNION ALL SELECT 'mined', period::VARCHAR, domain, {r('sum(tonnes)', 'tonnes', 2)}, {r('max(grade)', 'grade')}, {r('min(grade2)', 'grade2')} FROM blocks GROUP BY period, domain""")
def mine_series(spark, sf_dir):
    blocks = V.blocks(spark, sf_dir)
    sized = blocks.withColumn("volume", F.lit(6250.0))
    mined = blocks.groupBy("period", F.col("domain").alias("material")).agg(F.sum("tonnes").alias("tonnes"), F.max("grade").alias("grade"), F.min("grade2").alias("grade2"))
    rings = [(i, ore, [(a, b), (c, b), (c, d), (a, d)]) for i, ore, (a, b, c, d) in _DIGS]
    return rounded(checks.mine_series(["grade", "grade2"], sized, mined, sized, rings)).withColumn("tonnes", F.round("tonnes", 2))


_SLOPES = "slopes AS (SELECT ['A', 'N', 'R'][sample_id % 3 + 1] AS domain, value / 40 AS fos, CASE WHEN sample_id % 4 = 0 AND sample_id % 3 < 2 THEN value / 100 END AS probability FROM samples)"


@query(f"WITH {V.BLOCKS}, {V.SAMPLES}, {_SLOPES}, p AS (SELECT DISTINCT period, domain FROM blocks) SELECT period, {r('min(fos)', 'min_fos')}, {r('coalesce(avg(probability), avg((fos < 1)::INT))', 'failure_probability')} FROM p LEFT JOIN slopes USING (domain) GROUP BY period")
def slope_periods(spark, sf_dir):
    key = F.col("sample_id")
    domain = F.when(key % 3 == 0, "A").when(key % 3 == 1, "N").otherwise("R")
    results = V.samples(spark, sf_dir).select(domain.alias("domain"), (F.col("value") / 40).alias("fos"), F.when((key % 4 == 0) & (key % 3 < 2), F.col("value") / 100).alias("probability"))
    return rounded(checks.slope_periods(V.blocks(spark, sf_dir), results, ["domain"]))


@query(f"""WITH {V.SAMPLES}, k AS (SELECT *, {_u(1, 'sample_id')} < 0.2 AS test FROM samples), n AS (SELECT t.sample_id AS id, t.value AS actual, s.x, s.y, s.z, s.value, {_DIST} AS d, row_number() OVER (PARTITION BY t.sample_id ORDER BY {_DIST}, s.sample_id) AS k FROM k t JOIN k s ON t.test AND NOT s.test),
 e AS (SELECT a.id, a.actual, CASE WHEN {_between('a', 'b')} = 0 THEN 0 ELSE (b.value * a.d + a.value * b.d) / {_between('a', 'b')} END AS e FROM n a JOIN n b ON a.id = b.id AND a.k = 1 AND b.k = 2) SELECT count(*) AS n, {r('avg(abs(actual - e))', 'mae')}, {r('sqrt(avg((actual - e) ** 2))', 'rmse')}, {r('1 - sum((actual - e) ** 2) / (var_pop(actual) * count(*))', 'r2')} FROM e""")
def held_out_radial(spark, sf_dir):
    return rounded(checks.held_out(V.samples(spark, sf_dir), "value", k=2)[1])


# --- hazard under uncertain catalogues ------------------------------------------------

_HAZARDS = f"""moved AS (SELECT sample_id, i AS realisation, x + 10::DOUBLE * {_normal(1, 'i', 'sample_id')} AS x, y + 10::DOUBLE * {_normal(2, 'i', 'sample_id')} AS y, z + 10::DOUBLE * {_normal(3, 'i', 'sample_id')} AS z, greatest(value / 20 + 0.2::DOUBLE * {_normal(4, 'i', 'sample_id')}, 0) AS m FROM samples, (SELECT unnest(range(6)) AS i)),
 sums AS (SELECT block_id, realisation, sum(pow(10::DOUBLE, m) / ({_DIST} + 1e-6) ** 2) AS v FROM targets t JOIN moved s ON {_DIST} <= 90 GROUP BY 1, 2), tops AS (SELECT realisation, max(v) AS top FROM sums GROUP BY 1),
 volumes AS (SELECT f.block_id, f.realisation, coalesce(v / top, 0) AS h FROM (SELECT block_id, unnest(range(6)) AS realisation FROM targets) f LEFT JOIN sums s ON s.block_id = f.block_id AND s.realisation = f.realisation LEFT JOIN tops p ON p.realisation = f.realisation)"""


def _volumes(spark, sf_dir):
    events = V.samples(spark, sf_dir).withColumn("magnitude", F.col("value") / 20)
    return simulation.hazard_realisations(events, V.targets(spark, sf_dir), 90.0, 6, event_id="sample_id")


@query(f"WITH {V.TARGETS}, {V.SAMPLES}, {_HAZARDS} SELECT block_id, {r('avg(h)', 'mean', 6)}, {r('stddev_pop(h)', 'deviation', 6)}, {r('max(h)', 'greatest', 6)}, {r('avg((h >= 0.05)::INT)', 'exceedance', 6)} FROM volumes GROUP BY 1")
def hazard_realisations(spark, sf_dir):
    return rounded(simulation.hazard_by_node(_volumes(spark, sf_dir), 0.05), 6)


@query(f"WITH {V.TARGETS}, {V.SAMPLES}, {_HAZARDS} SELECT {r('avg(h)', 'mean', 6)}, {r('stddev_pop(h)', 'deviation', 6)}, {r('min(h)', 'least', 6)}, {r('max(h)', 'greatest', 6)}, {r('quantile_cont(h, 0.1)', 'p10', 6)}, {r('quantile_cont(h, 0.5)', 'p50', 6)}, {r('quantile_cont(h, 0.9)', 'p90', 6)} FROM volumes")
def hazard_uncertainty(spark, sf_dir):
    return rounded(simulation.hazard_summary(_volumes(spark, sf_dir)), 6)


@query(f"""WITH {V.TARGETS}, {V.SAMPLES}, {_HAZARDS}, rock AS (SELECT block_id, (block_id * 7 % 90 + 10)::DOUBLE AS rating, (block_id % 11)::DOUBLE / 10 AS stress FROM targets),
 d AS (SELECT block_id, h, least(greatest(rating + 5::DOUBLE * {_normal(11, 'realisation', 'block_id')}, 0), 100) AS rating, greatest(stress + 0.1::DOUBLE * (SELECT max(stress) FROM rock) * {_normal(12, 'realisation', 'block_id')}, 0) AS stress FROM volumes JOIN rock USING (block_id)),
 b AS (SELECT block_id, greatest(least(h * 0.6 + CASE WHEN rating < 60 THEN rating / 60 ELSE 0.5 END * 0.3 + stress * 0.1, 1), 0) AS h FROM d) SELECT block_id, {r('avg(h)', 'mean', 6)}, {r('stddev_pop(h)', 'deviation', 6)}, {r('max(h)', 'greatest', 6)}, {r('avg((h >= 0.3)::INT)', 'exceedance', 6)} FROM b GROUP BY 1""")
def rockburst_realisations(spark, sf_dir):
    key = F.col("block_id")
    rock = V.targets(spark, sf_dir).select("block_id", (key * 7 % 90 + 10).cast("double").alias("rating"), ((key % 11).cast("double") / 10).alias("stress"))
    return rounded(simulation.hazard_by_node(simulation.rockburst_realisations(_volumes(spark, sf_dir), rock), 0.3), 6)


# --- models and rules ------------------------------------------------------------------


@query(f"""WITH {V.BLOCKS}, b AS (SELECT block_id, x, y, z, CASE WHEN grade = 3 THEN -tonnes ELSE tonnes / density END AS volume, density, CASE WHEN grade = 7 THEN tonnes + 2 ELSE tonnes END AS tonnes, grade * 11 - 5 AS grade, grade2 * 2e5 AS au FROM blocks),
 f AS (SELECT 'negative' AS "check", 'volume' AS "column", 'ERROR' AS severity, count(*) FILTER (volume < 0) AS n, min(volume) AS worst FROM b UNION ALL SELECT 'negative', 'grade', 'WARNING', count(*) FILTER (grade < 0), min(grade) FROM b
 UNION ALL SELECT 'tonnage', 'tonnes', 'WARNING', count(*) FILTER (abs(tonnes - volume * density) > 0.001), max(abs(tonnes - volume * density)) FROM b UNION ALL SELECT 'unit', 'grade', 'WARNING', count(*) FILTER (grade > 100), max(grade) FROM b
 UNION ALL SELECT 'unit', 'au', 'WARNING', count(*) FILTER (au > 1e6), max(au) FROM b UNION ALL SELECT 'coverage', 'block_id', 'WARNING', count(*), 800 FROM b) SELECT "check", "column", severity, n, {r('worst', 'worst')} FROM f WHERE n > 0""")
def block_model_faults(spark, sf_dir):
    g = F.col("grade")
    blocks = V.blocks(spark, sf_dir).select("block_id", "x", "y", "z", F.when(g == 3, -F.col("tonnes")).otherwise(F.col("tonnes") / F.col("density")).alias("volume"), "density", F.when(g == 7, F.col("tonnes") + 2).otherwise(F.col("tonnes")).alias("tonnes"), (g * 11 - 5).alias("grade"), (F.col("grade2") * 2e5).alias("au"))
    return rounded(validation.block_model(blocks, {"grade": "percent", "au": "ppm"}, 800))


@query(f"""WITH {V.TARGETS}, d AS (SELECT block_id AS domain, x AS a, CASE WHEN block_id % 3 > 0 THEN y / 4 END AS s FROM targets), c AS (SELECT domain, least(greatest(a * 0.25, coalesce(s * 0.75, 0), 10), 500) AS m, least(greatest(a * 0.67, coalesce(s * 1.5, 0), 10), 500) AS i, least(greatest(a, coalesce(s * 2.5, 0), 10), 500) AS f FROM d)
 SELECT domain, 'Measured' AS class, {r('greatest(least(m, i * 0.8), 10)', 'distance')}, 3 AS holes FROM c UNION ALL SELECT domain, 'Indicated', {r('greatest(least(i, f * 0.8), 10)', 'distance')}, 2 FROM c UNION ALL SELECT domain, 'Inferred', {r('f', 'distance')}, 1 FROM c""")
def domain_rules(spark, sf_dir):
    domains = V.targets(spark, sf_dir).select(F.col("block_id").alias("domain"), F.col("x").alias("range"), F.when(F.col("block_id") % 3 > 0, F.col("y") / 4).alias("spacing"))
    return rounded(modelling.domain_rules(domains))


@query(f"WITH {V.TARGETS}, o AS (SELECT block_id AS pushback, row_number() OVER (ORDER BY y DESC, block_id) - 1 AS place FROM targets WHERE block_id % 4 = 1) SELECT pushback, place FROM o UNION ALL SELECT block_id, (SELECT count(*) FROM o) + row_number() OVER (ORDER BY x, block_id) - 1 FROM targets WHERE block_id % 4 <> 1")
def reordered_pushbacks(spark, sf_dir):
    plan = V.targets(spark, sf_dir).select(F.col("block_id").alias("pushback"), F.col("x").alias("place"), "y")
    order = ranked(plan.where("pushback % 4 = 1"), [F.desc("y"), "pushback"], "_turn").select("pushback", (F.col("_turn") - 1).alias("place"))
    return planning.reordered(plan.drop("y").withColumn("place", F.col("place").cast("long")), order)


@query(f"""WITH {V.INTERVALS}, d AS (SELECT lith_code, grade - lag(grade) OVER (PARTITION BY hole_id, lith_code ORDER BY depth_from, depth_to) AS d FROM intervals), n AS (SELECT lith_code, avg(d * d) / 2 AS nugget FROM d WHERE d IS NOT NULL GROUP BY 1), g AS (SELECT count(*) AS nuggets, min(nugget) AS least, max(nugget) AS greatest, median(nugget) AS median FROM n)
 SELECT data, nuggets, {r('least', 'least')}, {r('greatest', 'greatest')}, {r('median', 'median')}, {r('greatest / least', 'ratio')}, greatest / least <= 3 AS consistent, data = 'same' AS lineage, {r('median', 'nugget')}, greatest / least <= 3 AND data = 'same' AS passed FROM g, (SELECT unnest(['same', 'changed']) AS data)""")
def variogram_gates(spark, sf_dir):
    """Nuggets of the codes, for the data they came from in another order, and for data with one value changed."""
    rows = V.intervals(spark, sf_dir)
    columns = ["hole_id", "depth_from", "depth_to", "grade"]
    fits, source = variograms.short_nuggets(rows, "grade", ["lith_code"]), selection.table_hash(rows, columns)
    other = rows.withColumn("grade", F.when((F.col("depth_from") == 0) & (F.col("hole_id") == 1), F.col("grade") + 1).otherwise(F.col("grade")))
    same = variograms.gates(fits, rows.repartition(3), columns, source).withColumn("data", F.lit("same"))
    return rounded(same.unionByName(variograms.gates(fits, other, columns, source).withColumn("data", F.lit("changed"))))

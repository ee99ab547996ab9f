"""Queries of the domain's operators over the driver's tables, each with the same in SQL for DuckDB.

Doubles are rounded on both sides, as sums differ in their last digits by order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import economics, geometry, rock, variogram
from ..operators import aggregates, clustering, economics as money, intervals, kriging, processes, selection, simulation, spatial, structural, survey, timeseries, validation, variograms
from . import tables as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.col(c) for c in df.columns))


def r(expression: str, name: str, digits: int = 4) -> str:
    return f"round({expression}, {digits}) AS {name}"


CUTOFFS = [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0]
_CUTS = "cutoffs AS (SELECT unnest([0,1,2,3,4,5,6,7,8,9])::DOUBLE AS cutoff)"


# --- aggregation ----------------------------------------------------------------


@query(f"WITH {V.BLOCKS}, {_CUTS} SELECT cutoff, {r('sum(CASE WHEN grade >= cutoff THEN tonnes ELSE 0 END)', 'tonnes')}, {r('sum(CASE WHEN grade >= cutoff THEN tonnes * grade ELSE 0 END)', 'metal')}, count(*) FILTER (grade >= cutoff) AS n, {r('sum(CASE WHEN grade >= cutoff THEN tonnes * grade END) / sum(CASE WHEN grade >= cutoff THEN tonnes END)', 'grade')} FROM blocks, cutoffs GROUP BY cutoff")
def grade_tonnage_curve(spark, sf_dir):
    return rounded(aggregates.grade_tonnage(V.blocks(spark, sf_dir), "grade", "tonnes", CUTOFFS))


@query(f"WITH {V.BLOCKS}, {_CUTS} SELECT domain, cutoff, {r('sum(CASE WHEN grade >= cutoff THEN tonnes ELSE 0 END)', 'tonnes')}, {r('sum(CASE WHEN grade >= cutoff THEN tonnes * grade ELSE 0 END)', 'metal')}, count(*) FILTER (grade >= cutoff) AS n, {r('sum(CASE WHEN grade >= cutoff THEN tonnes * grade END) / sum(CASE WHEN grade >= cutoff THEN tonnes END)', 'grade')} FROM blocks, cutoffs GROUP BY ALL")
def grade_tonnage_by_domain(spark, sf_dir):
    return rounded(aggregates.grade_tonnage(V.blocks(spark, sf_dir), "grade", "tonnes", CUTOFFS, ["domain"]))


@query(f"""WITH {V.BLOCKS}, per AS (SELECT class AS category, tonnes / density AS v, tonnes / density * density AS t, grade FROM blocks),
 every AS (SELECT * FROM per UNION ALL SELECT 'M+I', v, t, grade FROM per WHERE category IN ('Measured', 'Indicated') UNION ALL SELECT 'All', v, t, grade FROM per)
 SELECT category, count(*) AS n, {r('sum(v)', 'volume')}, {r('sum(t)', 'tonnes')}, {r('sum(t * grade)', 'metal')}, {r('sum(t * grade) / sum(t)', 'grade')} FROM every GROUP BY category""")
def resource_summary(spark, sf_dir):
    return rounded(aggregates.resources(V.blocks(spark, sf_dir), "class", F.col("tonnes") / F.col("density"), F.col("density"), "grade", {"M+I": ["Measured", "Indicated"]}))


@query(f"WITH {V.BLOCKS} SELECT domain, count(value) AS n, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'std')}, {r('min(value)', 'min')}, {r('max(value)', 'max')}, {r('quantile_cont(value, 0.1)', 'p10')}, {r('quantile_cont(value, 0.5)', 'p50')}, {r('quantile_cont(value, 0.9)', 'p90')}, {r('stddev_pop(value) / avg(value)', 'cv')} FROM blocks GROUP BY domain")
def descriptive_statistics(spark, sf_dir):
    return rounded(aggregates.describe(V.blocks(spark, sf_dir), "value", ["domain"]))


@query(f"WITH {V.BLOCKS} SELECT domain, count(grade) AS n, {r('sum(tonnes * grade) / sum(tonnes)', 'mean')}, {r('(sum(tonnes * grade * grade) - sum(tonnes * grade) * (sum(tonnes * grade) / sum(tonnes))) / (sum(tonnes) - sum(tonnes * tonnes) / sum(tonnes))', 'variance')}, {r('sum(tonnes)', 'weight')} FROM blocks GROUP BY domain")
def weighted_statistics(spark, sf_dir):
    return rounded(aggregates.weighted(V.blocks(spark, sf_dir), "grade", "tonnes", ["domain"]))


@query(f"WITH {V.SAMPLES}, sized AS (SELECT *, unnest([50, 100, 200])::DOUBLE AS size FROM samples), cells AS (SELECT size, floor(x / size) AS cx, floor(y / size) AS cy, count(*) AS n, avg(value) AS m, sum(value) AS s FROM sized GROUP BY ALL) SELECT size, count(*) AS cells, {r('sum(s) / sum(n)', 'mean')}, {r('avg(m)', 'declustered_mean')}, max(n) AS most FROM cells GROUP BY size")
def declustering_by_cell_size(spark, sf_dir):
    return rounded(aggregates.declustered(V.samples(spark, sf_dir), "value", [50.0, 100.0, 200.0]))


@query(f"WITH {V.SAMPLES} SELECT sample_id, {r('1.0::DOUBLE / count(*) OVER (PARTITION BY floor(x / 100), floor(y / 100), floor(z / 50))', 'weight', 8)} FROM samples")
def declustering_weights(spark, sf_dir):
    return rounded(aggregates.cell_weights(V.samples(spark, sf_dir), {"x": 100.0, "y": 100.0, "z": 50.0}).select("sample_id", "weight"), 8)


@query(f"WITH {V.SAMPLES} SELECT floor(x / 100)::BIGINT AS ix, floor(y / 100)::BIGINT AS iy, count(*) AS n FROM samples GROUP BY ALL ORDER BY n DESC, ix, iy LIMIT 20")
def fullest_cells(spark, sf_dir):
    return aggregates.top_cells(V.samples(spark, sf_dir), 100.0, most=20)


@query(f"WITH {V.BLOCKS}, l AS (SELECT min(x) AS lo, (max(x) - min(x)) / 12 AS w FROM blocks), b AS (SELECT greatest(ceil((x - lo) / w) - 1, 0)::BIGINT AS bin, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS n FROM blocks, l GROUP BY 1) SELECT f.bin, {r('lo + (f.bin + 0.5::DOUBLE) * w', 'middle')}, {r('mean', 'mean')}, {r('std', 'std')}, coalesce(n, 0) AS n FROM (SELECT unnest(range(12)) AS bin) f CROSS JOIN l LEFT JOIN b ON b.bin = f.bin")
def swath_plot(spark, sf_dir):
    return rounded(aggregates.swath(V.blocks(spark, sf_dir), "x", "value", 12))


@query(f"WITH {V.BLOCKS} SELECT domain, count(*) AS n, {r('regr_slope(value, tonnes)', 'slope')}, {r('regr_intercept(value, tonnes)', 'intercept')}, {r('regr_r2(value, tonnes)', 'r2')}, {r('100 * (avg(tonnes) - avg(value)) / avg(value)', 'bias_percent')}, {r('avg(abs(tonnes - value))', 'mae')}, {r('sqrt(avg((tonnes - value) * (tonnes - value)))', 'rmse')} FROM blocks GROUP BY domain")
def estimate_regression(spark, sf_dir):
    return rounded(aggregates.regression(V.blocks(spark, sf_dir), "value", "tonnes", ["domain"]))


@query(f"WITH {V.BLOCKS} SELECT ((grade >= 5) OR (grade2 >= 6))::INT AS ore, count(*) AS n, {r('sum(tonnes)', 'tonnes')}, {r('avg(grade)', 'mean_grade')} FROM blocks GROUP BY 1")
def ore_waste_classes(spark, sf_dir):
    return rounded(money.ore_waste(V.blocks(spark, sf_dir), [("grade", 5.0), ("grade2", 6.0)]))


@query(f"WITH {V.BLOCKS}, p AS (SELECT x, sum(tonnes) AS v FROM blocks GROUP BY x), s AS (SELECT x, sum(v) OVER (ORDER BY x) / sum(v) OVER () AS s FROM p) SELECT (SELECT {r('quantile_cont(x, 0.1)', 'p')} FROM blocks) AS p10, (SELECT quantile_cont(x, 0.5) FROM blocks) AS p50, (SELECT quantile_cont(x, 0.8) FROM blocks) AS p80, min(x) FILTER (s >= 0.1) AS v10, min(x) FILTER (s >= 0.5) AS v50, min(x) FILTER (s >= 0.8) AS v80 FROM s")
def fragment_sizes(spark, sf_dir):
    return rounded(aggregates.fragment_sizes(V.blocks(spark, sf_dir), "x", "tonnes"))


# --- selection ------------------------------------------------------------------


@query(f"WITH {V.BLOCKS} SELECT block_id, grade FROM blocks WHERE x BETWEEN 100 AND 300 AND y BETWEEN 50 AND 200 AND z <= 40 AND grade > 4 AND abs(grade2 - 3) > 1e-8 + 3e-5")
def block_selection(spark, sf_dir):
    rows = V.blocks(spark, sf_dir).where(selection.box({"x": (100, 300), "y": (50, 200), "z": (None, 40)}))
    return selection.criteria(rows, [("grade", ">", 4), ("grade2", "!=", 3), ("absent", ">", 1)]).select("block_id", "grade")


@query(f"WITH {V.BLOCKS}, d AS (SELECT block_id, (x - 500) * (3::DOUBLE / 5) + (y - 250) * (4::DOUBLE / 5) AS distance FROM blocks) SELECT block_id, {r('distance', 'distance')} FROM d WHERE abs(distance) <= 20.5")
def cross_section(spark, sf_dir):
    inside, distance = selection.slab(0.0, 41.0, (3.0, 4.0, 0.0), (500.0, 250.0, 0.0))
    return rounded(V.blocks(spark, sf_dir).where(inside).select("block_id", distance.alias("distance")))


@query(f"WITH {V.BLOCKS}, a AS (SELECT block_id FROM blocks WHERE grade >= 8), b AS (SELECT block_id FROM blocks WHERE grade2 >= 5) SELECT 'new' AS mode, block_id FROM b UNION ALL SELECT 'add', block_id FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'subtract', block_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'intersect', block_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b)")
def selection_difference(spark, sf_dir):
    rows, out = V.blocks(spark, sf_dir), None
    for mode in ("new", "add", "subtract", "intersect"):
        one = selection.combined(rows.where("grade >= 8"), rows.where("grade2 >= 5"), mode, "block_id").select(F.lit(mode).alias("mode"), "block_id")
        out = one if out is None else out.unionByName(one)
    return out


_RING = [(100.0, 50.0), (700.0, 100.0), (650.0, 400.0), (350.0, 210.0), (120.0, 430.0)]


@query("WITH RECURSIVE " + V.BLOCKS + ", edges AS (SELECT unnest([100,700,650,350,120])::DOUBLE AS ax, unnest([50,100,400,210,430])::DOUBLE AS ay, unnest([700,650,350,120,100])::DOUBLE AS bx, unnest([100,400,210,430,50])::DOUBLE AS \"by\"), cells AS (SELECT DISTINCT x, y FROM blocks), inside AS (SELECT x, y FROM cells, edges WHERE (ay > y) <> (\"by\" > y) AND x < (bx - ax) * (y - ay) / (\"by\" - ay) + ax GROUP BY x, y HAVING count(*) % 2 = 1) SELECT domain, count(*) AS n, round(sum(tonnes), 4) AS tonnes FROM blocks JOIN inside USING (x, y) GROUP BY domain")
def dig_polygon_tonnes(spark, sf_dir):
    rows = V.blocks(spark, sf_dir).where(geometry.in_polygon(F.col("x"), F.col("y"), _RING))
    return rounded(rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.sum("tonnes").alias("tonnes")))


@query(f"WITH {V.BLOCKS}, h AS (SELECT ('0x' || substr(md5(concat_ws('|', block_id, domain, class, period)), 1, 15))::BIGINT::HUGEINT AS h FROM blocks) SELECT count(*) AS n, (sum(h) % 1152921504606846976)::BIGINT AS hash FROM h")
def table_fingerprint_count(spark, sf_dir):
    return selection.table_hash(V.blocks(spark, sf_dir), ["block_id", "domain", "class", "period"])


# --- intervals ------------------------------------------------------------------

_FIXED = """o AS (SELECT *, min(depth_from) OVER (PARTITION BY hole_id) AS o FROM intervals WHERE depth_to > depth_from),
 b AS (SELECT *, unnest(range(floor((depth_from - o) / {L})::BIGINT, ceil((depth_to - o) / {L})::BIGINT)) AS bin FROM o),
 c AS (SELECT *, greatest(depth_from, o + bin * {L}) AS a, least(depth_to, o + (bin + 1) * {L}) AS z FROM b)"""


@query(f"WITH {V.INTERVALS}, {_FIXED.format(L='10::DOUBLE')} SELECT hole_id, bin, {r('min(a)', 'depth_from')}, {r('max(z)', 'depth_to')}, {r('sum(z - a)', 'length')}, count(*) AS sample_count, {r('sum(grade * (z - a)) / sum(z - a)', 'grade')}, sum(z - a) < 10 - 1e-9 AS is_partial FROM c WHERE z > a GROUP BY hole_id, bin")
def fixed_length_composites(spark, sf_dir):
    return rounded(intervals.fixed_length(V.intervals(spark, sf_dir), ["grade"], 10.0))


@query(f"WITH {V.INTERVALS}, {_FIXED.format(L='10::DOUBLE')} SELECT hole_id, bin, {r('sum((grade >= 5)::INT::DOUBLE * (z - a)) / sum(z - a)', 'indicator')} FROM c WHERE z > a GROUP BY hole_id, bin")
def indicator_composites(spark, sf_dir):
    return rounded(intervals.indicator(V.intervals(spark, sf_dir), "grade", 5.0, 10.0).select("hole_id", "bin", "indicator"))


@query(f"WITH {V.INTERVALS}, d AS (SELECT *, (depth_to::DECIMAL(18,6) - depth_from::DECIMAL(18,6))::DECIMAL(18,6) * density::DECIMAL(18,6) AS dm FROM intervals), s AS (SELECT *, sum(dm) OVER (PARTITION BY hole_id ORDER BY depth_from, depth_to ROWS UNBOUNDED PRECEDING) AS de FROM d), m AS (SELECT *, de::DOUBLE AS e, (de - dm)::DOUBLE AS st FROM s), b AS (SELECT *, unnest(range(floor(st / 40)::BIGINT, ceil(e / 40)::BIGINT)) AS bin FROM m), c AS (SELECT *, greatest(st, bin * 40) AS a, least(e, (bin + 1) * 40) AS z FROM b) SELECT hole_id, bin, {r('sum(z - a)', 'mass', 6)}, {r('sum(grade * (z - a)) / sum(z - a)', 'grade', 6)} FROM c WHERE z > a GROUP BY hole_id, bin")
def equal_mass_composites(spark, sf_dir):
    rows = intervals.equal_mass(V.intervals(spark, sf_dir), ["grade"], 40.0, "density")
    return rounded(rows.select("hole_id", "bin", "mass", "grade"), 6)


@query(f"WITH {V.INTERVALS}, h AS (SELECT hole_id, min(depth_from) AS o, max(depth_to) AS e FROM intervals GROUP BY 1), w AS (SELECT hole_id, unnest(range(floor((e - o - 20) / 10 + 1e-9)::BIGINT + 1)) AS bin, o FROM h WHERE e - o >= 20) SELECT w.hole_id, bin, {r('o + bin * 10', 'depth_from')}, {r('o + bin * 10 + 20', 'depth_to')}, {r('sum(least(depth_to, o + bin * 10 + 20) - greatest(depth_from, o + bin * 10))', 'covered')}, {r('sum((least(depth_to, o + bin * 10 + 20) - greatest(depth_from, o + bin * 10)) * grade) / sum(least(depth_to, o + bin * 10 + 20) - greatest(depth_from, o + bin * 10))', 'grade')} FROM w JOIN intervals i ON i.hole_id = w.hole_id AND depth_from < o + bin * 10 + 20 AND depth_to > o + bin * 10 GROUP BY w.hole_id, bin, o")
def rolling_composites(spark, sf_dir):
    return rounded(intervals.rolling(V.intervals(spark, sf_dir), ["grade"], 20.0, 10.0))


@query(f"WITH {V.INTERVALS}, s AS (SELECT *, CASE WHEN lag(lith_code) OVER w = lith_code AND depth_from - lag(depth_to) OVER w < 1e-3 THEN 0 ELSE 1 END AS s FROM intervals WINDOW w AS (PARTITION BY hole_id ORDER BY depth_from, depth_to)), i AS (SELECT *, sum(s) OVER (PARTITION BY hole_id ORDER BY depth_from, depth_to ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM s) SELECT hole_id, island, any_value(lith_code) AS lith_code, {r('min(depth_from)', 'depth_from')}, {r('max(depth_to)', 'depth_to')}, {r('sum(depth_to - depth_from)', 'length')}, count(*) AS sample_count, {r('sum(grade * (depth_to - depth_from)) / sum(depth_to - depth_from)', 'grade')} FROM i GROUP BY hole_id, island")
def lithology_composites(spark, sf_dir):
    return rounded(intervals.islands(V.intervals(spark, sf_dir), "lith_code", ["grade"]))


@query(f"WITH {V.INTERVALS} SELECT hole_id, {r('(depth_to + nf) / 2', 'depth')}, above, below FROM (SELECT hole_id, depth_to, lith_code AS above, lead(lith_code) OVER w AS below, lead(depth_from) OVER w AS nf FROM intervals WINDOW w AS (PARTITION BY hole_id ORDER BY depth_from, depth_to)) WHERE above <> below")
def lithology_contacts(spark, sf_dir):
    return rounded(intervals.contacts(V.intervals(spark, sf_dir), "lith_code"))


@query(f"WITH {V.INTERVALS} SELECT count(*) AS n, count(DISTINCT hole_id) AS holes, {r('avg(grade)', 'mean')}, {r('stddev_pop(grade)', 'std')}, {r('sum((depth_to - depth_from) * grade) / sum(depth_to - depth_from)', 'weighted_mean')}, {r('sum(depth_to - depth_from)', 'metres')}, {r('sqrt(sum((depth_to - depth_from) * grade * grade) / sum(depth_to - depth_from) - (sum((depth_to - depth_from) * grade) / sum(depth_to - depth_from)) ** 2)', 'weighted_std')} FROM intervals")
def interval_statistics(spark, sf_dir):
    return rounded(intervals.length_stats(V.intervals(spark, sf_dir), "grade"))


@query()
def economic_composites(spark, sf_dir):
    return rounded(intervals.economic(V.intervals(spark, sf_dir), "grade", 5.0, 5.0, 20.0))


# --- validation -----------------------------------------------------------------

_RULES = """p AS (SELECT l.*, lag(depth_to) OVER (PARTITION BY l.hole_id ORDER BY depth_from, depth_to) AS prev, c.length AS td FROM logged l LEFT JOIN collars c USING (hole_id)),
 v AS (SELECT 'LENGTH' AS rule_code, 'ERROR' AS severity, hole_id FROM p WHERE depth_to <= depth_from UNION ALL SELECT 'GAP', 'WARNING', hole_id FROM p WHERE depth_from - prev > 0.10
 UNION ALL SELECT 'OVERLAP', 'ERROR', hole_id FROM p WHERE depth_from < prev UNION ALL SELECT 'BEYOND_TD', 'ERROR', hole_id FROM p WHERE depth_to > td + 1e-3
 UNION ALL SELECT 'ORPHAN', 'ERROR', hole_id FROM logged WHERE hole_id NOT IN (SELECT hole_id FROM collars))"""


@query(f"WITH {V.LOGGED}, {V.COLLARS}, {_RULES} SELECT 'assays' AS table_name, rule_code, severity, count(*) AS n, count(DISTINCT hole_id) AS holes FROM v GROUP BY ALL")
def interval_validation(spark, sf_dir):
    rows, collars = V.logged(spark, sf_dir), V.collars(spark, sf_dir)
    return validation.summary(validation.intervals(rows, collars, "assays"), validation.orphans(rows, "assays", collars))


@query(f"WITH {V.SURVEYS}, {V.COLLARS}, p AS (SELECT s.*, c.length AS td, lag(depth) OVER w AS pd, lag(azimuth) OVER w AS pa, lag(dip) OVER w AS pp, max(depth) OVER (PARTITION BY s.hole_id) AS last FROM surveys s LEFT JOIN collars c USING (hole_id) WINDOW w AS (PARTITION BY s.hole_id ORDER BY depth)), v AS (SELECT 'DIP_TURN' AS rule_code, hole_id FROM p WHERE abs(dip - pp) / (depth - pd) * 10 > 10 UNION ALL SELECT 'AZIMUTH_TURN', hole_id FROM p WHERE abs(((azimuth - pa + 180) % 360 + 360) % 360 - 180) / (depth - pd) * 10 > 10 UNION ALL SELECT 'FIRST_STATION', hole_id FROM p WHERE pd IS NULL AND depth > 2 UNION ALL SELECT 'SPACING', hole_id FROM p WHERE depth - pd > 30 UNION ALL SELECT 'END_GAP', hole_id FROM p WHERE depth = last AND td - last > 5) SELECT 'surveys' AS table_name, rule_code, 'WARNING' AS severity, count(*) AS n, count(DISTINCT hole_id) AS holes FROM v GROUP BY ALL")
def survey_validation(spark, sf_dir):
    return validation.summary(validation.surveys(V.surveys(spark, sf_dir), V.collars(spark, sf_dir)))


@query(f"WITH {V.COLLARS}, {V.INTERVALS}, l AS (SELECT hole_id, max(depth_to) AS last FROM intervals GROUP BY 1) SELECT 'assays' AS table_name, 'SHORT' AS rule_code, 'WARNING' AS severity, hole_id, {r('last', 'depth')} FROM collars JOIN l USING (hole_id) WHERE length - last > 1")
def short_holes(spark, sf_dir):
    return rounded(validation.short_holes(V.intervals(spark, sf_dir), V.collars(spark, sf_dir), "assays"))


@query()
def interval_repair(spark, sf_dir):
    fixed = validation.fixed_intervals(V.logged(spark, sf_dir), V.collars(spark, sf_dir))
    return rounded(fixed.select("hole_id", "depth_from", "depth_to", "grade"))


@query()
def survey_repair(spark, sf_dir):
    return rounded(validation.fixed_surveys(V.surveys(spark, sf_dir), 15.0))


# --- positions ------------------------------------------------------------------


@query(f"""WITH {V.SURVEYS}, {V.COLLARS}, one AS (SELECT hole_id, depth, min({{'a': azimuth, 'd': dip}}) AS s FROM surveys GROUP BY 1, 2), st AS (SELECT hole_id, depth, s.a AS azimuth, s.d AS dip FROM one UNION ALL SELECT hole_id, 0, arg_min(s.a, depth), arg_min(s.d, depth) FROM one GROUP BY hole_id HAVING min(depth) > 0),
 u AS (SELECT *, cos(radians(dip)) * sin(radians(azimuth)) AS ux, cos(radians(dip)) * cos(radians(azimuth)) AS uy, sin(radians(dip)) AS uz FROM st),
 l AS (SELECT *, lag(ux) OVER w AS px, lag(uy) OVER w AS py, lag(uz) OVER w AS pz, depth - lag(depth) OVER w AS step FROM u WINDOW w AS (PARTITION BY hole_id ORDER BY depth)),
 b AS (SELECT *, acos(least(greatest(ux * px + uy * py + uz * pz, -1), 1)) AS bend FROM l), f AS (SELECT *, CASE WHEN bend > 1e-6 THEN 2 / bend * tan(bend / 2) ELSE 1 END AS rf FROM b)
 SELECT f.hole_id, {r('depth', 'depth')}, {r('x + sum(coalesce(step / 2 * (ux + px) * rf, 0)) OVER w2', 'x', 3)}, {r('y + sum(coalesce(step / 2 * (uy + py) * rf, 0)) OVER w2', 'y', 3)}, {r('z + sum(coalesce(step / 2 * (uz + pz) * rf, 0)) OVER w2', 'z', 3)} FROM f JOIN collars USING (hole_id) WINDOW w2 AS (PARTITION BY f.hole_id ORDER BY depth ROWS UNBOUNDED PRECEDING)""")
def minimum_curvature(spark, sf_dir):
    rows = survey.desurvey(V.collars(spark, sf_dir), V.surveys(spark, sf_dir))
    return rounded(rows.select("hole_id", "depth", "x", "y", "z"), 3).withColumn("depth", F.round("depth", 4))


@query()
def located_intervals(spark, sf_dir):
    collars = V.collars(spark, sf_dir)
    stations = survey.desurvey(collars, V.surveys(spark, sf_dir))
    return rounded(survey.located(V.intervals(spark, sf_dir), stations, collars).select("hole_id", "depth_from", "x", "y", "z"), 3)


# --- neighbours and variograms --------------------------------------------------

_DIST = "sqrt((t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y) + (t.z - s.z) * (t.z - s.z))"


@query(f"WITH {V.TARGETS}, {V.SAMPLES}, d AS (SELECT block_id AS target, sample_id AS point, {_DIST} AS distance, row_number() OVER (PARTITION BY block_id ORDER BY {_DIST}, sample_id) AS rank FROM targets t, samples s) SELECT target, point, {r('distance', 'distance')}, rank::INT AS rank FROM d WHERE rank <= 8")
def nearest_samples(spark, sf_dir):
    return rounded(spatial.nearest(V.targets(spark, sf_dir), V.samples(spark, sf_dir), 8, None, "block_id", "sample_id").select("target", "point", "distance", "rank"))


@query(f"WITH {V.TARGETS}, {V.SAMPLES}, d AS (SELECT block_id AS target, value, {_DIST} AS distance, row_number() OVER (PARTITION BY block_id ORDER BY {_DIST}, sample_id) AS rank FROM targets t, samples s) SELECT target, {r('sum(value * pow(greatest(distance, 1e-10), -2)) / sum(pow(greatest(distance, 1e-10), -2))', 'estimate')}, count(*) AS n, {r('min(distance)', 'nearest')} FROM d WHERE rank <= 8 GROUP BY target")
def inverse_distance_estimates(spark, sf_dir):
    near = spatial.nearest(V.targets(spark, sf_dir), V.samples(spark, sf_dir), 8, None, "block_id", "sample_id", ["value"])
    return rounded(spatial.inverse_distance(near, "value"))


@query(f"WITH {V.TARGETS}, {V.SAMPLES}, h AS (SELECT block_id, hole, min({_DIST}) AS d FROM targets t, samples s GROUP BY 1, 2), c AS (SELECT block_id, count(*) FILTER (d <= 30) AS n0, count(*) FILTER (d <= 60) AS n1, count(*) FILTER (d <= 90) AS n2, min(d) FILTER (d <= 90) AS nearest FROM h GROUP BY 1) SELECT block_id, {r('nearest', 'nearest')}, CASE WHEN n0 >= 3 THEN 'Measured' WHEN n1 >= 3 THEN 'Indicated' WHEN n2 >= 1 THEN 'Inferred' ELSE 'Unclassified' END AS class FROM c")
def spacing_classification(spark, sf_dir):
    rules = [("Measured", 30.0, 3), ("Indicated", 60.0, 3), ("Inferred", 90.0, 1)]
    return rounded(spatial.classified(V.targets(spark, sf_dir), V.samples(spark, sf_dir), rules, "block_id", "hole"))


_PAIRS = "p AS (SELECT s.sample_id AS i, t.sample_id AS j, t.x - s.x AS dx, t.y - s.y AS dy, t.z - s.z AS dz, {d} AS d, s.value AS vi, t.value AS vj FROM samples s JOIN samples t ON s.sample_id < t.sample_id AND abs(t.x - s.x) <= {R} AND abs(t.y - s.y) <= {R} AND abs(t.z - s.z) <= {R} WHERE {d} <= {R})"


@query(f"WITH {V.SAMPLES}, {_PAIRS.format(d=_DIST, R=60)} SELECT ceil(d / 10)::BIGINT AS lag, {r('avg(d)', 'distance')}, {r('avg((vi - vj) ** 2 / 2)', 'gamma')}, count(*) AS pairs FROM p WHERE d > 0 GROUP BY 1")
def omnidirectional_variogram(spark, sf_dir):
    return rounded(variograms.experimental(V.samples(spark, sf_dir), "sample_id", "value", 6, 10.0))


@query(f"WITH {V.SAMPLES}, {_PAIRS.format(d=_DIST, R=60)} SELECT ceil(d / 10)::BIGINT AS lag, {r('avg(d)', 'distance')}, {r('avg((vi - vj) ** 2 / 2)', 'gamma')}, count(*) AS pairs FROM p WHERE d > 0 AND abs(dx * sin(radians(40)) + dy * cos(radians(40))) >= d * cos(radians(30)) GROUP BY 1")
def directional_variogram(spark, sf_dir):
    return rounded(variograms.directional(V.samples(spark, sf_dir), "sample_id", "value", 6, 10.0, 40.0, angle=30.0))


@query(f"WITH {V.SAMPLES}, {_PAIRS.format(d=_DIST, R=60)}, c AS (SELECT unnest([15, 30, 45])::DOUBLE AS cutoff) SELECT ceil(d / 10)::BIGINT AS lag, count(*) AS pairs, cutoff, {r('avg(CASE WHEN (vi <= cutoff) <> (vj <= cutoff) THEN 0.5 ELSE 0 END)', 'gamma')} FROM p, c WHERE d > 0 GROUP BY 1, cutoff")
def indicator_variograms(spark, sf_dir):
    return rounded(variograms.indicator(V.samples(spark, sf_dir), "sample_id", "value", [15.0, 30.0, 45.0], 6, 10.0))


@query(f"WITH {V.INTERVALS}, m AS (SELECT hole_id, (depth_from + depth_to) / 2 AS m, grade AS v FROM intervals) SELECT ceil((b.m - a.m) / 20)::BIGINT AS lag, {r('avg(b.m - a.m)', 'distance')}, {r('avg((a.v - b.v) ** 2 / 2)', 'gamma')}, count(*) AS pairs FROM m a JOIN m b ON a.hole_id = b.hole_id AND a.m < b.m AND b.m - a.m <= 100 GROUP BY 1")
def downhole_variogram(spark, sf_dir):
    return rounded(variograms.downhole(V.intervals(spark, sf_dir), "grade", 5, 20.0))


@query("SELECT h, " + ", ".join((r("CASE WHEN h <= 0 THEN 0 ELSE 0.2 + 0.8 * CASE WHEN h >= 100 THEN 1 ELSE 1.5 * (h / 100) - 0.5 * (h / 100) ** 3 END END", "spherical"), r("CASE WHEN h <= 0 THEN 0 ELSE 0.2 + 0.8 * (1 - exp(-3 * h / 100)) END", "exponential"), r("CASE WHEN h <= 0 THEN 0 ELSE 0.2 + 0.8 * (1 - exp(-3 * (h / 100) ** 2)) END", "gaussian"))) + " FROM (SELECT (unnest(range(31)) * 5)::DOUBLE AS h)")
def variogram_models(spark, sf_dir):
    h = F.col("h")
    rows = spark.range(31).select((F.col("id") * 5.0).alias("h"))
    return rounded(rows.select("h", *(f(h, 100.0, 0.8, 0.2).alias(n) for n, f in (("spherical", variogram.spherical), ("exponential", variogram.exponential), ("gaussian", variogram.gaussian)))))


_MODEL = {"model": "spherical", "nugget": 20.0, "sill": 200.0, "range": 150.0}


@query()
def ordinary_kriging(spark, sf_dir):
    return rounded(kriging.krige(V.targets(spark, sf_dir), V.samples(spark, sf_dir), "value", _MODEL, 12))


@query()
def simple_kriging(spark, sf_dir):
    return rounded(kriging.krige(V.targets(spark, sf_dir), V.samples(spark, sf_dir), "value", _MODEL, 12, kind="simple", mean=50.0))


@query()
def universal_kriging(spark, sf_dir):
    return rounded(kriging.krige(V.targets(spark, sf_dir), V.samples(spark, sf_dir), "value", _MODEL, 16, kind="universal"))


@query()
def indicator_kriging(spark, sf_dir):
    return rounded(kriging.indicator_kriging(V.targets(spark, sf_dir), V.samples(spark, sf_dir), "value", [25.0, 45.0, 65.0], {"model": "spherical", "nugget": 0.05, "sill": 0.2, "range": 150.0}, k=10))


# --- simulation -----------------------------------------------------------------


@query()
def normal_scores(spark, sf_dir):
    return rounded(simulation.normal_scores(V.samples(spark, sf_dir), "value").select("sample_id", "normal_score"))


@query()
def gaussian_fields(spark, sf_dir):
    reals = simulation.moving_average_fields(spark, (10, 10, 4), (10.0, 10.0, 10.0), {"nugget": 0.1, "sill": 0.9, "range": 40.0}, 8)
    return rounded(aggregates.by_realisation(reals, "block_id", "value"))


@query()
def bootstrap_grades(spark, sf_dir):
    draws = simulation.bootstrap_means(V.samples(spark, sf_dir), "value", "sample_id", 100)
    return rounded(simulation.confidence(draws, "mean"))


# --- time series ----------------------------------------------------------------


@query(f"WITH w AS (SELECT floor(epoch_us(ts)::DOUBLE / 86400e6 - (SELECT min(epoch_us(ts)) FROM events)::DOUBLE / 86400e6)::BIGINT AS bin, count(*) AS n FROM events GROUP BY 1), l AS (SELECT greatest(floor((max(epoch_us(ts)) - min(epoch_us(ts)))::DOUBLE / 86400e6) - 1, 0)::BIGINT AS last FROM events) SELECT f.bin, coalesce(n, 0) AS n, {r('coalesce(n, 0)::DOUBLE', 'rate')}, (sum(coalesce(n, 0)) OVER (ORDER BY f.bin))::BIGINT AS total FROM (SELECT unnest(range(last + 1)) AS bin FROM l) f LEFT JOIN w ON w.bin = f.bin")
def event_rate(spark, sf_dir):
    return rounded(timeseries.event_rate(V.table(spark, sf_dir, "events"), "ts", 1.0))


@query(f"WITH o AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 21600e6, true) AS s FROM events), s AS (SELECT *, sum(s::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM o) SELECT user_id, run, count(*) AS n FROM s GROUP BY ALL")
def event_sessions(spark, sf_dir):
    return timeseries.sessions(V.table(spark, sf_dir, "events"), "user_id", "ts", 21600).select("user_id", "run", "n")


@query(f"WITH t AS (SELECT user_id, epoch_us(ts)::DOUBLE / 86400e6 / 365.25 AS t, value FROM events), c AS (SELECT user_id, t - avg(t) OVER (PARTITION BY user_id) AS t, value FROM t) SELECT user_id, count(value) AS n, {r('regr_slope(value, t)', 'rate', 3)}, {r('regr_r2(value, t)', 'r2', 5)} FROM c GROUP BY user_id")
def reading_trends(spark, sf_dir):
    rows = timeseries.trends(V.table(spark, sf_dir, "events"), "user_id", "ts", "value")
    return rows.select("user_id", "n", F.round("rate", 3).alias("rate"), F.round("r2", 5).alias("r2"))


@query(f"WITH m AS (SELECT *, avg(value) OVER (PARTITION BY user_id) AS m, stddev_pop(value) OVER (PARTITION BY user_id) AS s, quantile_cont(value, 0.5) OVER (PARTITION BY user_id) AS med FROM events), d AS (SELECT *, quantile_cont(abs(value - med), 0.5) OVER (PARTITION BY user_id) AS mad FROM m) SELECT event_id, abs(value - m) > 3.5 * s AS z_outlier, 0.6745 * abs(value - med) / mad > 3.5 AS mad_outlier FROM d")
def reading_outliers(spark, sf_dir):
    return timeseries.outliers(V.table(spark, sf_dir, "events"), "user_id", "value").select("event_id", "z_outlier", "mad_outlier")


@query(f"SELECT event_id, {r('avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)', 'smoothed')} FROM events")
def smoothed_readings(spark, sf_dir):
    return rounded(timeseries.smoothed(V.table(spark, sf_dir, "events"), "user_id", "ts", "value", 2).select("event_id", "smoothed"))


@query(f"WITH f AS (SELECT *, (value - first_value(value) OVER w) * 1000 AS change_mm, (value - lag(value) OVER w) * 1000 / ((epoch_us(ts)::DOUBLE / 86400e6 - lag(epoch_us(ts)::DOUBLE / 86400e6) OVER w) / 365.25) AS velocity FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT user_id, ts, {r('change_mm', 'change_mm', 2)}, {r('velocity', 'velocity', 0)} FROM f")
def subsidence_series(spark, sf_dir):
    rows = timeseries.subsidence(V.table(spark, sf_dir, "events"), "user_id", "ts", "value")
    return rows.withColumns({"change_mm": F.round("change_mm", 2), "velocity": F.round("velocity", 0)})


@query("WITH g AS (SELECT value / 100 AS g FROM events WHERE value IS NOT NULL), l AS (SELECT count(*) AS n, min(g) AS lo, (max(g) - min(g)) / 20 AS w FROM g), k AS (SELECT least(floor((g - lo) / w), 19) AS k, count(*) AS c FROM g, l GROUP BY 1), mc AS (SELECT lo + (SELECT arg_max(k, c * 100 - k) FROM k) * w AS mc, n FROM l), j AS (SELECT floor((g - mc) / 0.1::DOUBLE + 1e-9)::INT AS j, count(*) AS c FROM g, mc WHERE g >= mc GROUP BY 1), f AS (SELECT unnest(range(max(j) + 1))::INT AS j FROM j), a AS (SELECT f.j, sum(coalesce(c, 0)) OVER (ORDER BY f.j DESC) AS a FROM f LEFT JOIN j ON f.j = j.j) SELECT max(a)::BIGINT AS events, round(any_value(mc), 4) AS completeness, round(CASE WHEN any_value(n) < 10 OR max(a) < 5 OR count(*) < 3 THEN 1 ELSE least(greatest(-regr_slope(log10(a), j * 0.1::DOUBLE), 0.5), 2) END, 4) AS b FROM a, mc")
def b_value(spark, sf_dir):
    return rounded(timeseries.b_value(V.table(spark, sf_dir, "events").withColumn("m", F.col("value") / 100), "m"))


# --- money ----------------------------------------------------------------------


@query(f"WITH {V.BLOCKS}, f AS (SELECT period, sum(value) AS cf, count(*) AS n FROM blocks WHERE grade >= 2 GROUP BY 1), d AS (SELECT *, cf * pow(1.08::DOUBLE, -period) AS d FROM f) SELECT period, {r('cf', 'cash_flow', 2)}, n AS blocks, {r('d', 'discounted', 2)}, {r('sum(d) OVER (ORDER BY period)', 'npv', 2)} FROM d")
def net_present_value(spark, sf_dir):
    blocks = V.blocks(spark, sf_dir)
    schedule = blocks.select("block_id", "period", (F.col("grade") >= 2).cast("int").alias("mined"))
    return rounded(money.net_present_value(schedule, blocks, "value", 0.08), 2)


@query()
def rates_of_return(spark, sf_dir):
    flows = V.blocks(spark, sf_dir).groupBy("domain", "period").agg(F.sum(F.when(F.col("period") <= 3, -F.col("value")).otherwise(F.col("value") / 2)).alias("flow"))
    return rounded(money.rates_of_return(flows, "domain", "period", "flow"))


@query(f"WITH {V.BLOCKS} SELECT period, {r('sum(CASE WHEN grade > 0 THEN tonnes ELSE 0 END)', 'ore')}, {r('sum(CASE WHEN grade > 0 THEN 0 ELSE tonnes END)', 'waste')}, {r('sum(CASE WHEN grade > 0 THEN 0 ELSE tonnes END) / sum(CASE WHEN grade > 0 THEN tonnes END)', 'ratio')} FROM blocks GROUP BY period")
def stripping_ratio(spark, sf_dir):
    blocks = V.blocks(spark, sf_dir)
    return rounded(money.stripping_ratio(blocks.select("block_id", "period", F.lit(1).alias("mined")), blocks))


@query(f"WITH {V.BLOCKS}, l AS (SELECT min(z) AS lo, max(z) AS hi FROM blocks) SELECT least(floor((z - lo) / ((hi - lo) / 4)) + 1, 4)::INT AS phase, count(*) AS n FROM blocks, l GROUP BY 1")
def pit_phases(spark, sf_dir):
    return money.phases(V.blocks(spark, sf_dir), "z", 4).groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {V.BLOCKS}, c AS (SELECT sum(sum(tonnes)) OVER (ORDER BY grade DESC, block_id) AS c, any_value(tonnes) AS t, block_id FROM blocks GROUP BY grade, block_id) SELECT floor((c - t) / 5000 + 1)::INT AS period, count(*) AS n, {r('sum(t)', 'tonnes')} FROM c GROUP BY 1")
def greedy_schedule(spark, sf_dir):
    rows = money.greedy_schedule(V.blocks(spark, sf_dir), 5000.0, [F.desc("grade")])
    return rounded(rows.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.sum("tonnes").alias("tonnes")))


@query(f"WITH {V.BLOCKS}, p AS (SELECT x, y, z, min(block_id) AS block_id, min(period) AS period FROM blocks GROUP BY 1, 2, 3), e AS (SELECT a.block_id AS block, b.block_id AS above, a.period AS p, b.period AS q FROM p a JOIN p b ON b.z = a.z + 10 AND abs(b.x - a.x) <= 25 AND abs(b.y - a.y) <= 25) SELECT count(*) AS edges, count(*) FILTER (q > p) AS violations FROM e")
def precedence_check(spark, sf_dir):
    cells = V.blocks(spark, sf_dir).groupBy("x", "y", "z").agg(F.min("block_id").alias("block_id"), F.min("period").alias("period")).withColumn("mined", F.lit(1))
    edges = spatial.precedence(cells, "block_id", 25.0, 25.0, 10.0)
    broken = money.precedence_violations(edges, cells).agg(F.count(F.lit(1)).alias("violations"))
    return edges.agg(F.count(F.lit(1)).alias("edges")).crossJoin(broken)


@query(f"WITH {V.BLOCKS}, p AS (SELECT domain, period, sum(tonnes) AS t, sum(tonnes * grade) / sum(tonnes) AS g FROM blocks WHERE grade2 < 4 GROUP BY ALL), a AS (SELECT domain, period, sum(tonnes) AS t, sum(tonnes * grade) / sum(tonnes) AS g FROM blocks WHERE grade2 >= 4 GROUP BY ALL) SELECT domain, period, {r('p.t', 'model_tonnes')}, {r('a.t', 'actual_tonnes')}, {r('100 * (a.t - p.t) / p.t', 'tonnes_bias')}, {r('100 * (a.g - p.g) / p.g', 'grade_bias')}, {r('100 * (a.t * a.g - p.t * p.g) / (p.t * p.g)', 'metal_bias')} FROM p JOIN a USING (domain, period)")
def reconciliation(spark, sf_dir):
    blocks = V.blocks(spark, sf_dir)
    per = lambda rows: rows.groupBy("domain", "period").agg(F.sum("tonnes").alias("tonnes"), (F.sum(F.col("tonnes") * F.col("grade")) / F.sum("tonnes")).alias("grade"))
    return rounded(money.reconciled(per(blocks.where("grade2 < 4")), per(blocks.where("grade2 >= 4")), ["domain", "period"]))


@query(f"WITH {V.BLOCKS}, e AS (SELECT domain, period, tonnes, 'au' AS element, grade AS g FROM blocks UNION ALL SELECT domain, period, tonnes, 'cu', grade2 FROM blocks) SELECT domain, {r('sum(tonnes)', 'tonnes')}, element, {r('sum(tonnes * g) / sum(tonnes)', 'grade')}, {r('sum(tonnes * g)', 'metal')} FROM e GROUP BY domain, element")
def blended_grades(spark, sf_dir):
    rows = V.blocks(spark, sf_dir).select("domain", "tonnes", F.create_map(F.lit("au"), F.col("grade"), F.lit("cu"), F.col("grade2")).alias("grades"))
    return rounded(money.blended(rows, ["domain"]))


@query(f"WITH {V.BLOCKS}, {_CUTS}, t AS (SELECT cutoff, sum(tonnes) AS t, sum(tonnes * grade) / sum(tonnes) AS g FROM blocks, cutoffs WHERE grade >= cutoff GROUP BY 1), o AS (SELECT cutoff, t * 0.95 * 1.05 AS ore, g / 1.05 AS head, greatest(ceil(t * 0.95 * 1.05 / 20000), 1) AS life FROM t), f AS (SELECT *, (ore * (head * 0.9 * 12 - 20) - 100000 * 0.5) / life AS flow FROM o) SELECT cutoff, {r('ore', 'ore')}, {r('head', 'head_grade')}, life::BIGINT AS life, {r('flow', 'yearly_flow', 2)}, {r('flow * (1 - pow(1.1::DOUBLE, -life)) / 0.1', 'npv', 1)} FROM f")
def cutoff_economics(spark, sf_dir):
    curve = aggregates.grade_tonnage(V.blocks(spark, sf_dir), "grade", "tonnes", CUTOFFS)
    rows = money.cutoff_economics(curve, 100000.0, 12.0, 0.9, 0.5, 20.0, 20000.0, 0.1, 0.05, 0.05)
    return rows.select("cutoff", *(F.round(c, d).alias(c) for c, d in (("ore", 4), ("head_grade", 4))), "life", F.round("yearly_flow", 2).alias("yearly_flow"), F.round("npv", 1).alias("npv"))


@query(f"WITH {V.BLOCKS}, routes AS (SELECT unnest(['mill', 'heap', 'dump']) AS route, unnest([0.9, 0.6, 0])::DOUBLE AS recovery, unnest([10, 10, 0])::DOUBLE AS price, unnest([25, 9, 1])::DOUBLE AS cost, 1 AS factor), w AS (SELECT block_id, route, (grade * recovery * price - cost) * factor * tonnes AS worth FROM blocks, routes), b AS (SELECT route, worth, row_number() OVER (PARTITION BY block_id ORDER BY worth DESC, route DESC) AS k FROM w) SELECT route, count(*) AS n, {r('sum(worth)', 'worth')} FROM b WHERE k = 1 GROUP BY route")
def processing_routes(spark, sf_dir):
    routes = spark.createDataFrame([("mill", 0.9, 10.0, 25.0, 1.0), ("heap", 0.6, 10.0, 9.0, 1.0), ("dump", 0.0, 0.0, 1.0, 1.0)], "route string, recovery double, price double, cost double, factor double")
    best = money.best_route(V.blocks(spark, sf_dir), routes, "block_id")
    return rounded(best.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum("worth").alias("worth")))


# --- structure and rock ---------------------------------------------------------

_PLANES = "planes AS (SELECT p_partkey AS id, (p_partkey * 13 % 90)::DOUBLE AS dip, (p_partkey * 29 % 360)::DOUBLE AS dd FROM part)"


def _planes(spark, sf_dir):
    key = F.col("p_partkey")
    return V.table(spark, sf_dir, "part").select(key.alias("id"), (key * 13 % 90).cast("double").alias("dip"), (key * 29 % 360).cast("double").alias("dd"))


@query(f"WITH {_PLANES}, b AS (SELECT least(floor(dd % 180 / 15), 11)::INT AS bin, count(*) AS n FROM planes GROUP BY 1), a AS (SELECT bin, n FROM b UNION ALL SELECT bin + 12, n FROM b) SELECT f.bin::INT AS bin, (f.bin * 15)::DOUBLE AS from_degrees, coalesce(n, 0) AS n, coalesce(n, 0)::DOUBLE AS weight FROM (SELECT unnest(range(24)) AS bin) f LEFT JOIN a ON a.bin = f.bin")
def rose_histogram(spark, sf_dir):
    return structural.rose(_planes(spark, sf_dir), F.col("dd"), 24, True)


@query(f"WITH {_PLANES}, s AS (SELECT count(*) AS n, avg(cos(radians(dd * 2))) AS c, avg(sin(radians(dd * 2))) AS s FROM planes WHERE dip > 30), t AS (SELECT *, n * (c * c + s * s) AS z FROM s) SELECT n, {r('((degrees(atan2(s, c)) + 360) % 360) / 2', 'mean')}, {r('sqrt(c * c + s * s)', 'resultant')}, {r('1 - sqrt(c * c + s * s)', 'variance')}, {r('z', 'rayleigh_z')}, {r('greatest(least(exp(-z) * (1 + (2 * z - z * z) / (4 * n) - (24 * z - 132 * z ** 2 + 76 * z ** 3 - 9 * z ** 4) / (288 * n * n::DOUBLE)), 1), 0)', 'rayleigh_p')} FROM t")
def circular_statistics(spark, sf_dir):
    return rounded(structural.circular(_planes(spark, sf_dir).where("dip > 30"), F.col("dd"), True))


@query(f"""WITH {_PLANES}, v AS (SELECT -sin(radians(dip)) * sin(radians(dd)) AS x, -sin(radians(dip)) * cos(radians(dd)) AS y, -cos(radians(dip)) AS z, floor(dip / 10)::BIGINT AS k FROM planes), s AS (SELECT k, count(*) AS n, sqrt(sum(x) ** 2 + sum(y) ** 2 + sum(z) ** 2) AS big, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz FROM v GROUP BY k), b AS (SELECT *, big / n AS bar FROM s), c AS (SELECT *, bar * (3 - bar * bar) / (1 - bar * bar) AS likely FROM b)
 SELECT k, n, {r('sx / big', 'mean_x')}, {r('sy / big', 'mean_y')}, {r('sz / big', 'mean_z')}, {r('degrees(acos(least(abs(sz / big), 1)))', 'mean_dip', 3)}, {r('(degrees(atan2(-sx, -sy)) + 360) % 360', 'mean_dip_direction', 3)}, {r('big', 'resultant')}, {r('CASE WHEN n < 2 OR bar < 0.001 THEN 0 WHEN bar >= 0.9999 THEN 1000 WHEN n < 10 THEN greatest(likely - 2 / n::DOUBLE, 0) ELSE likely END', 'kappa')},
 {r('CASE WHEN n < 2 THEN 180 ELSE degrees(acos(greatest(least(1 - (n - big) / big * (pow(20::DOUBLE, 1 / (n - 1)::DOUBLE) - 1), 1), -1))) END', 'cone_95')}, {r('CASE WHEN n < 2 THEN 180 ELSE degrees(acos(greatest(least(1 - (n - big) / big * (pow(100::DOUBLE, 1 / (n - 1)::DOUBLE) - 1), 1), -1))) END', 'cone_99')}, {r('degrees(acos(least(bar, 1)))', 'dispersion')}, {r('1 - bar', 'variance')} FROM c""")
def fisher_statistics(spark, sf_dir):
    x, y, z = geometry.pole(F.col("dip"), F.col("dd"))
    rows = _planes(spark, sf_dir).select(x.alias("x"), y.alias("y"), z.alias("z"), F.floor(F.col("dip") / 10).alias("k"))
    out = structural.fisher(rows, "x", "y", "z", ["k"])
    return rounded(out.withColumns({c: F.round(c, 3) for c in ("mean_dip", "mean_dip_direction")}))


@query(f"WITH {_PLANES}, t AS (SELECT *, abs(((dd - 120 + 180) % 360 + 360) % 360 - 180) AS turn FROM planes) SELECT count(*) FILTER (turn <= 20 AND dip < 65 AND dip > 30) AS planar, count(*) FILTER (turn >= 150 AND 90 - dip + 30 <= 65) AS toppling FROM t")
def slope_kinematics(spark, sf_dir):
    planes = _planes(spark, sf_dir)
    dip, dd = F.col("dip"), F.col("dd")
    return planes.agg(F.count_if(rock.planar_sliding(dip, dd, 65.0, 120.0, 30.0)).alias("planar"), F.count_if(rock.flexural_toppling(dip, dd, 65.0, 120.0, 30.0)).alias("toppling"))


@query("SELECT p_partkey AS id, " + ", ".join((r("(p_size + 50) / 9.0::DOUBLE * 1.5 / 2 * 1 / 2.5", "q"), r("120 * pow(p_size::DOUBLE, 0.5) / pow(4::DOUBLE, 0.75)", "strength"))) + ", CASE WHEN p_size + 30 > 80 THEN 'I' WHEN p_size + 30 > 60 THEN 'II' WHEN p_size + 30 > 40 THEN 'III' WHEN p_size + 30 > 20 THEN 'IV' ELSE 'V' END AS class FROM part")
def rock_mass(spark, sf_dir):
    size = F.col("p_size").cast("double")
    one = lambda v: F.lit(float(v))
    return rounded(V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), rock.q_system(size + 50, one(9), one(1.5), one(2), one(1), one(2.5)).alias("q"), rock.pillar_strength(120, size, one(4)).alias("strength"), rock.rock_mass_class(size + 30).alias("class")))


@query(f"WITH {V.BLOCKS} SELECT block_id, {r('tonnes * grade * 0.9 * 55 - tonnes * (3.5 + 12)', 'worth')} FROM blocks")
def block_values(spark, sf_dir):
    return rounded(V.blocks(spark, sf_dir).select("block_id", economics.block_value(F.col("tonnes"), F.col("grade"), 55.0, 3.5, 12.0, 0.9).alias("worth")))


# --- processes and clusters -----------------------------------------------------


@query(f"WITH {V.BLOCKS}, p AS (SELECT period, sum(tonnes) AS tonnes FROM blocks GROUP BY 1), h AS (SELECT period, sum(tonnes) AS t FROM blocks WHERE grade >= 3 GROUP BY 1), a AS (SELECT period, sum(tonnes) AS t FROM blocks WHERE grade2 >= 5 AND period <> 4 GROUP BY 1) SELECT period, {r('tonnes', 'planned')}, {r('coalesce(h.t, 0)', 'hauled')}, {r('coalesce(a.t, 0)', 'actual')}, {r('100 * (coalesce(h.t, 0) - tonnes) / tonnes', 'hauled_variance')}, {r('100 * (coalesce(a.t, 0) - tonnes) / tonnes', 'actual_variance')} FROM p LEFT JOIN h USING (period) LEFT JOIN a USING (period)")
def production_alignment(spark, sf_dir):
    blocks = V.blocks(spark, sf_dir)
    per = lambda rows: rows.groupBy("period").agg(F.sum("tonnes").alias("tonnes"))
    return rounded(processes.aligned(per(blocks), per(blocks.where("grade >= 3")), per(blocks.where("grade2 >= 5 and period != 4"))))


@query(f"WITH {V.BLOCKS}, p AS (SELECT period, sum(tonnes) AS tonnes, avg(grade) AS risk FROM blocks GROUP BY 1) SELECT count(*) FILTER (risk >= 5) AS periods, {r('coalesce(sum(tonnes) FILTER (risk >= 5), 0)', 'tonnes')}, arg_max(period, risk) AS worst_period, {r('max(risk)', 'worst')} FROM p")
def risk_exposure(spark, sf_dir):
    profile = V.blocks(spark, sf_dir).groupBy("period").agg(F.sum("tonnes").alias("tonnes"), F.avg("grade").alias("risk"))
    return rounded(processes.exposure(profile, "risk", 5.0))


@query(f"WITH RECURSIVE {V.BLOCKS}, f AS (SELECT domain AS node, period, sum(tonnes) AS i, sum(value) / 2000 AS o FROM blocks GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY period) AS k FROM f), w AS (SELECT node, period, k, least(greatest(500 + i - o, 0), 2000) AS s, greatest(greatest(500 + i - o, 0) - 2000, 0) AS spill FROM k WHERE k = 1 UNION ALL SELECT k.node, k.period, k.k, least(greatest(w.s + i - o, 0), 2000), greatest(greatest(w.s + i - o, 0) - 2000, 0) FROM w JOIN k ON k.node = w.node AND k.k = w.k + 1) SELECT node, period, {r('s', 'stored')}, {r('spill', 'spill')} FROM w")
def water_balance(spark, sf_dir):
    flows = V.blocks(spark, sf_dir).groupBy(F.col("domain").alias("node"), "period").agg(F.sum("tonnes").alias("inflow"), (F.sum("value") / 2000).alias("outflow"))
    return rounded(processes.water_balance(flows, 500.0, 2000.0))


@query(f"WITH {V.SAMPLES} SELECT floor(x / 50)::BIGINT AS ix, min(sample_id) AS sample_id FROM samples GROUP BY floor(x / 50), floor(y / 50), floor(z / 50)")
def thinned_points(spark, sf_dir):
    rows = clustering.first_of_cell(V.samples(spark, sf_dir), "sample_id", 50.0)
    return rows.select(F.floor(F.col("x") / 50).alias("ix"), "sample_id")


@query()
def density_clusters(spark, sf_dir):
    return clustering.density_clusters(V.samples(spark, sf_dir), "sample_id", 25.0, 4)


@query()
def kmeans_clusters(spark, sf_dir):
    rows = clustering.kmeans(V.samples(spark, sf_dir), ["x", "y", "value"], 5)
    return rounded(clustering.cluster_quality(rows, ["x", "y", "value"]))

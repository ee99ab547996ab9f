"""Queries of the column expressions, each with the same in SQL for DuckDB; they register beside those of :mod:`queries`."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import economics, geometry, metallurgy, rock, variogram
from . import tables as V
from .queries import query, r, rounded

_LINES = "lines AS (SELECT p_partkey AS id, (p_partkey * 13 % 90)::DOUBLE AS dip, (p_partkey * 29 % 360)::DOUBLE AS dd, p_size::DOUBLE AS size, (p_partkey * 7 % 101)::DOUBLE AS share FROM part)"


def _lines(spark, sf_dir):
    key = F.col("p_partkey")
    return V.table(spark, sf_dir, "part").select(key.alias("id"), (key * 13 % 90).cast("double").alias("dip"), (key * 29 % 360).cast("double").alias("dd"), F.col("p_size").cast("double").alias("size"), (key * 7 % 101).cast("double").alias("share"))


def _named(columns, names):
    return [c.alias(n) for c, n in zip(columns, names)]


_POLE = "v AS (SELECT *, -sin(radians(dip)) * sin(radians(dd)) AS x, -sin(radians(dip)) * cos(radians(dd)) AS y, -cos(radians(dip)) AS z FROM lines)"


@query("SELECT h, " + ", ".join((r("CASE WHEN h <= 0 THEN 0 ELSE 0.2 + 0.8 * least(h / 100, 1) END", "linear", 8), r("CASE WHEN h <= 0 THEN 0 ELSE 0.3 END::DOUBLE", "nugget", 8), r("CASE WHEN h <= 0 THEN 0 ELSE 0.1 + 0.05 * pow(h, 1.2::DOUBLE) END", "power", 8), r("1 - CASE WHEN h <= 0 THEN 0 ELSE 0.2 + 0.8 * CASE WHEN h >= 100 THEN 1 ELSE 1.5 * (h / 100) - 0.5 * (h / 100) ** 3 END END", "covariance", 8), r("sqrt((h / 50) ** 2 + (2 * h / 80) ** 2 + (3 * h / 20) ** 2)", "scaled", 8))) + " FROM (SELECT (unnest(range(31)) * 5)::DOUBLE AS h)")
def further_variogram_models(spark, sf_dir):
    h = F.col("h")
    rows = spark.range(31).select((F.col("id") * 5.0).alias("h"))
    return rounded(rows.select("h", variogram.linear(h, 100, 0.8, 0.2).alias("linear"), variogram.pure_nugget(h, 0.3).alias("nugget"), variogram.power(h, 0.05, 1.2, 0.1).alias("power"), variogram.covariance(h, "spherical", 100, 0.8, 0.2).alias("covariance"), variogram.anisotropic_distance(h, 2 * h, 3 * h, 50, 80, 20).alias("scaled")), 8)


@query(f"WITH {_LINES} SELECT id, {r('dip', 'dip')}, {r('CASE WHEN dip > 0 THEN dd ELSE 0 END', 'dip_direction')}, {r('dip', 'plunge')}, {r('dd', 'trend')}, {r('(dd + 270) % 360', 'strike')}, {r('dd % 180', 'axial')}, {r('(dd + 12.5) % 360', 'declined')}, {r('degrees(acos(greatest(least(cos(radians(dip)), 1), -1)))', 'from_vertical')} FROM lines WHERE dip > 0 AND dd > 0")
def orientation_conversions(spark, sf_dir):
    dip, dd = F.col("dip"), F.col("dd")
    normal = geometry.pole(dip, dd)
    up = [-c for c in normal]
    lower = geometry.lower_hemisphere(*up)
    rows = _lines(spark, sf_dir).where("dip > 0 and dd > 0")
    back, line = geometry.dip_and_direction(*lower), geometry.plunge_and_trend(*geometry.line(dip, dd))
    down = [F.lit(0.0), F.lit(0.0), F.lit(-1.0)]
    return rounded(rows.select("id", *_named(back, ("dip", "dip_direction")), *_named(line, ("plunge", "trend")), geometry.strike(dd).alias("strike"), geometry.axial(dd).alias("axial"), geometry.declined(dd, 12.5).alias("declined"), geometry.angle_between(normal, down).alias("from_vertical")))


@query(f"WITH {_LINES}, {_POLE} SELECT id, {r('x * sqrt(1 / (1 - z))', 'area_x')}, {r('y * sqrt(1 / (1 - z))', 'area_y')}, {r('x / (1 - z)', 'angle_x')}, {r('y / (1 - z)', 'angle_y')}, {r('x', 'back_area_x')}, {r('z', 'back_area_z')}, {r('y', 'back_angle_y')}, {r('z', 'back_angle_z')} FROM v")
def stereonet_projections(spark, sf_dir):
    area, angle = geometry.schmidt(F.col("x"), F.col("y"), F.col("z")), geometry.wulff(F.col("x"), F.col("y"), F.col("z"))
    rows = _lines(spark, sf_dir).select("id", *_named(geometry.pole(F.col("dip"), F.col("dd")), "xyz")).select("id", *_named(area, ("area_x", "area_y")), *_named(angle, ("angle_x", "angle_y")))
    a, b = geometry.from_schmidt(F.col("area_x"), F.col("area_y")), geometry.from_wulff(F.col("angle_x"), F.col("angle_y"))
    return rounded(rows.select("*", a[0].alias("back_area_x"), a[2].alias("back_area_z"), b[1].alias("back_angle_y"), b[2].alias("back_angle_z")))


def _turn(a: float, d: float) -> list[list[str]]:
    a, d = math.radians(a), math.radians(d)
    return [[repr(v) + "::DOUBLE" for v in row] for row in ((math.sin(a) * math.cos(d), math.cos(a) * math.cos(d), -math.sin(d)), (math.cos(a), -math.sin(a), 0.0), (math.sin(a) * math.sin(d), math.cos(a) * math.sin(d), math.cos(d)))]


_ROWS = _turn(30.0, 20.0)
_ON = [" + ".join(f"({m}) * ({c} - {o})" for m, c, o in zip(row, "xyz", (100, 50, 10))) for row in _ROWS]
_FLAT = [" + ".join(f"({m}) * {c}" for m, c in zip(row, "xyz")) for row in _ROWS]


@query(f"WITH {V.SAMPLES} SELECT sample_id, {r(_ON[0], 'u')}, {r(_ON[1], 'v')}, {r(_ON[2], 'w')}, {r('x', 'x')}, {r('y', 'y')}, {r('z', 'z')}, {r('sqrt(((' + _FLAT[0] + ') / 100) ** 2 + ((' + _FLAT[1] + ') / 50) ** 2 + ((' + _FLAT[2] + ') / 20) ** 2)', 'scaled')} FROM samples")
def rotated_points(spark, sf_dir):
    x, y, z = (F.col(c) for c in "xyz")
    matrix, origin = geometry.rotation(30.0, 20.0), (100.0, 50.0, 10.0)
    rows = V.samples(spark, sf_dir)
    scaled = geometry.anisotropic(x, y, z, 30.0, 20.0, 100.0, 50.0, 20.0)
    rows = rows.select("sample_id", *_named(geometry.rotated(x, y, z, matrix, origin), "uvw"), F.sqrt(sum((c * c for c in scaled), F.lit(0.0))).alias("scaled"))
    return rounded(rows.select("sample_id", "u", "v", "w", *_named(geometry.unrotated(F.col("u"), F.col("v"), F.col("w"), matrix, origin), "xyz"), "scaled"))


@query(f"""WITH {_LINES}, h AS (SELECT id, radians(20 + size / 2) AS al, radians(dd) AS be, radians(30::DOUBLE) AS a, radians(20 + share / 2) AS d, size, dd FROM lines),
 f AS (SELECT *, sin(d) * sin(a) AS hx, sin(d) * cos(a) AS hy, -cos(d) AS hz FROM h), u AS (SELECT *, -hz * hx AS ux, -hz * hy AS uy, 1 - hz * hz AS uz FROM f), n AS (SELECT *, sqrt(ux * ux + uy * uy + uz * uz) AS l FROM u),
 g AS (SELECT *, ux / l AS gx, uy / l AS gy, uz / l AS gz FROM n), t AS (SELECT *, hy * gz - hz * gy AS tx, hz * gx - hx * gz AS ty, hx * gy - hy * gx AS tz FROM g)
 SELECT id, {r('sin(al) * cos(be) * gx + sin(al) * sin(be) * tx + cos(al) * hx', 'nx')}, {r('sin(al) * cos(be) * gy + sin(al) * sin(be) * ty + cos(al) * hy', 'ny')}, {r('sin(al) * cos(be) * gz + sin(al) * sin(be) * tz + cos(al) * hz', 'nz')}, {r('20 + size / 2', 'alpha')}, {r('dd', 'beta')} FROM t""")
def oriented_core(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumns({"azimuth": F.lit(30.0), "hole_dip": -20 - F.col("share") / 2})
    normal = geometry.from_core(20 + F.col("size") / 2, F.col("dd"), F.col("azimuth"), F.col("hole_dip"))
    rows = rows.select("id", "azimuth", "hole_dip", *_named(normal, ("nx", "ny", "nz")))
    back = geometry.to_core(F.col("nx"), F.col("ny"), F.col("nz"), F.col("azimuth"), F.col("hole_dip"))
    out = rows.select("id", "nx", "ny", "nz", *_named(back, ("alpha", "beta")))
    return rounded(out).withColumn("beta", F.col("beta") % 360)


@query(f"WITH {_LINES}, t AS (SELECT id, radians(dip) AS d, radians(dd) AS a, unnest(range(5)) AS k FROM lines WHERE id % 10 = 0) SELECT id, k::INT AS k, {r('cos(k * pi() / 4) * cos(a) + sin(k * pi() / 4) * cos(d) * sin(a)', 'x')}, {r('-cos(k * pi() / 4) * sin(a) + sin(k * pi() / 4) * cos(d) * cos(a)', 'y')}, {r('-sin(k * pi() / 4) * sin(d)', 'z')} FROM t")
def great_circles(spark, sf_dir):
    rows = _lines(spark, sf_dir).where("id % 10 = 0").select("id", F.posexplode(geometry.great_circle(F.col("dip"), F.col("dd"), 5)).alias("k", "v"))
    return rounded(rows.select("id", "k", "v.x", "v.y", "v.z"))


@query(f"WITH {_LINES}, t AS (SELECT id, radians(dip) AS p, radians(dd) AS t, radians(25::DOUBLE) AS c, unnest(range(6)) AS k FROM lines WHERE id % 10 = 0), w AS (SELECT *, k * 2 * pi() / 6 AS w FROM t) SELECT id, k::INT AS k, {r('cos(c) * cos(p) * sin(t) + sin(c) * (cos(w) * cos(t) + sin(w) * sin(p) * sin(t))', 'x')}, {r('cos(c) * cos(p) * cos(t) + sin(c) * (-cos(w) * sin(t) + sin(w) * sin(p) * cos(t))', 'y')}, {r('-cos(c) * sin(p) + sin(c) * sin(w) * cos(p)', 'z')} FROM w")
def small_circles(spark, sf_dir):
    rows = _lines(spark, sf_dir).where("id % 10 = 0").select("id", F.posexplode(geometry.small_circle(F.col("dip"), F.col("dd"), F.lit(25.0), 6)).alias("k", "v"))
    return rounded(rows.select("id", "k", "v.x", "v.y", "v.z"))


@query(f"WITH {_LINES} SELECT id, {r('8.5 + size / 10 / 30::DOUBLE * 60 + size / 10 / 45::DOUBLE * 60', 'cycle')}, {r('10 * (10 + size / 10) * (1 / sqrt(80::DOUBLE) - 1 / sqrt(12000::DOUBLE))', 'energy')}, {r('size * 1500 / 0.75::DOUBLE', 'fan')}, {r('greatest(5000 - size * 120, 0) / (size + 10)', 'freeboard')}, {r('size * share / (2 * (size + share))', 'hydraulic_radius')}, {r('size * 0.5 * 0.8 * share', 'stability')} FROM lines")
def haulage_and_workings(spark, sf_dir):
    size, share = F.col("size"), F.col("share")
    one = lambda v: F.lit(float(v))
    return rounded(_lines(spark, sf_dir).select("id", rock.cycle_time(size / 10, 30.0, 45.0, 4.0, 2.5, 2.0).alias("cycle"), rock.bond_energy(10 + size / 10, 12000.0, 80.0).alias("energy"), rock.fan_power(size, one(1500), 0.75).alias("fan"), rock.freeboard(size * 120, one(5000), size + 10).alias("freeboard"), rock.hydraulic_radius(size, share).alias("hydraulic_radius"), rock.stability_number(size, one(0.5), one(0.8), share).alias("stability")))


@query(f"WITH {V.BLOCKS} SELECT block_id, {r('grade * (0.9 * 0.95 * 50)::DOUBLE + grade2 * (0.02 * 0.8 * 0.9 * 7000)::DOUBLE - greatest(density - 2.4, 0) * 10 - 3', 'nsr')}, {r('(grade * tonnes + 0.2 * grade2) / (tonnes + grade2)', 'diluted')}, {r('tonnes * grade * 0.9 * 50 + tonnes * grade2 * 0.8 * 7 - tonnes * 14', 'worth')}, {r('density / tonnes', 'cv')} FROM blocks")
def metal_values(spark, sf_dir):
    nsr = economics.net_smelter_return({"grade": {"recovery": 0.9, "payable": 0.95, "price": 50}, "grade2": {"factor": 0.02, "recovery": 0.8, "payable": 0.9, "price": 7000}}, {"density": {"limit": 2.4, "cost": 10}}, 3.0)
    t, g, g2 = F.col("tonnes"), F.col("grade"), F.col("grade2")
    worth = metallurgy.element_value(t, {"au": g, "cu": g2, "ag": g}, {"au": F.lit(0.9), "cu": F.lit(0.8)}, {"au": 50.0, "cu": 7.0, "ag": 1.0}, 4.0, 10.0)
    return rounded(V.blocks(spark, sf_dir).select("block_id", nsr.alias("nsr"), economics.diluted_grade(g, t, F.lit(0.2), g2).alias("diluted"), worth.alias("worth"), economics.coefficient_of_variation(t, F.col("density")).alias("cv")))


@query(f"""WITH {_LINES} SELECT id, {r('least(greatest(0.1 * sqrt(size * 200), 5), 25)', 'work_index')}, {r('least(greatest(0.6 + 0.01 * size, 0), 1)', 'linear')}, {r('least(greatest(0.5 + 0.02 * size - 0.0001 * size * size, 0), 1)', 'curved')}, {r('900 * least(greatest(1 - 0.3 * (size / 5 - 5) / 5, 0.1), 1)', 'rate')}, {r('900 / (1 + (size / 5 - 5) * 0.1)', 'limited')},
 {r('list_sum([CASE WHEN share = 0 THEN 0 ELSE 0.9 END, CASE WHEN size = 0 THEN 0 ELSE 0.7 END, 0, 0.5])', 'freed')} FROM lines""")
def plant_response(spark, sf_dir):
    size, share = F.col("size"), F.col("share")
    freed = metallurgy.liberation(F.array(share, size, F.lit(0.0), F.lit(1.0)), [0.9, 0.7, 0.5])
    return rounded(_lines(spark, sf_dir).select("id", metallurgy.work_index(size * 200).alias("work_index"), metallurgy.recovery(size, "linear", 0.6, 0.01).alias("linear"), metallurgy.recovery(size, "polynomial", 0.5, 0.02, -0.0001).alias("curved"), metallurgy.throughput(size / 5, 900.0, penalty=0.3).alias("rate"), metallurgy.throughput(size / 5, 900.0, "energy_limit").alias("limited"), F.aggregate(freed, F.lit(0.0), lambda a, v: a + v).alias("freed")))


@query(f"""WITH {_LINES}, m AS (SELECT id, unnest(['magnetic', 'gravity', 'flotation', 'sorting']) AS method, 20 + size / 2 AS feed, share / 100 AS freed FROM lines),
 c AS (SELECT *, CASE method WHEN 'magnetic' THEN least(0.85 + 0.15 * freed + least(0.1 * (feed / 60), 0.1), 0.98) WHEN 'gravity' THEN least(0.7 + 0.25 * freed, 0.95) WHEN 'flotation' THEN least(0.8 + 0.2 * freed - least(0.1 * (5 / 10 + 2 / 5)::DOUBLE, 0.15), 0.95) ELSE 0.75 END AS recovery,
  CASE method WHEN 'magnetic' THEN least(feed * (1 + 0.3 * freed), 68) WHEN 'gravity' THEN least(feed * (1 + 0.4 * freed), 65) WHEN 'flotation' THEN least(feed * (1 + 0.35 * freed), 67) ELSE feed * 1.2 END AS concentrate FROM m),
 p AS (SELECT *, least(recovery * (feed / concentrate), 0.5) AS pull FROM c) SELECT id, method, {r('recovery', 'recovery', 6)}, {r('concentrate', 'concentrate_grade', 6)}, {r('pull', 'mass_pull', 6)}, {r('greatest((feed - recovery * concentrate * pull) / (1 - pull), 0)', 'tailings_grade', 6)} FROM p""")
def separation_response(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    one = lambda m: rows.select("id", F.lit(m).alias("method"), *(c.alias(n) for n, c in metallurgy.separation(20 + F.col("size") / 2, F.col("share") / 100, m).items()))
    out = one("magnetic")
    for m in ("gravity", "flotation", "sorting"):
        out = out.unionByName(one(m))
    return rounded(out, 6)


@query(f"""WITH {V.BLOCKS} SELECT block_id, {r('ln(greatest(grade + 1, 2.220446049250313e-16::DOUBLE))', 'log')}, {r('log10(greatest(grade, 2.220446049250313e-16::DOUBLE))', 'log10')}, {r('sqrt(grade)', 'root')}, {r('(pow(greatest(value, 1e-300), 0.25::DOUBLE) - 1) / 0.25', 'boxcox')}, {r('pow(grade2, 0.5::DOUBLE)', 'power')} FROM blocks""")
def transformed_values(spark, sf_dir):
    g = F.col("grade")
    f = metallurgy.transformed
    return rounded(V.blocks(spark, sf_dir).select("block_id", f(g, "log", 1.0).alias("log"), f(g, "log10").alias("log10"), f(g, "sqrt").alias("root"), f(F.col("value"), "boxcox", exponent=0.25).alias("boxcox"), f(F.col("grade2"), "power", exponent=0.5).alias("power")))


@query(f"""WITH {_LINES}, a AS (SELECT id, share AS rmr, 30 + size AS angle, 5 + size / 4 AS height, id % 2 = 0 AS water, id % 3 = 0 AS faults FROM lines),
 b AS (SELECT *, CASE WHEN rmr >= 80 THEN 70 WHEN rmr >= 60 THEN 60 WHEN rmr >= 40 THEN 50 WHEN rmr >= 20 THEN 40 ELSE 30 END AS aa, CASE WHEN rmr >= 80 THEN 15 WHEN rmr >= 60 THEN 12 WHEN rmr >= 40 THEN 10 WHEN rmr >= 20 THEN 8 ELSE 5 END AS ah FROM a),
 c AS (SELECT *, least(greatest((100 - rmr) / 100 * 40 + least(30, greatest(angle - aa, 0) / 10 * 30) + least(20, greatest(height - ah, 0) / 5 * 20) + CASE WHEN water THEN 10 ELSE 0 END, 0), 100) AS i FROM b)
 SELECT id, {r('i', 'risk_index')}, CASE WHEN i < 25 THEN 'Low' WHEN i < 50 THEN 'Moderate' WHEN i < 75 THEN 'High' ELSE 'Very High' END AS risk_class, {r('CASE WHEN faults THEN least(0.95, 0.2 + CASE WHEN i < 25 THEN 0.05 WHEN i < 50 THEN 0.15 WHEN i < 75 THEN 0.4 ELSE 0.7 END) ELSE CASE WHEN i < 25 THEN 0.05 WHEN i < 50 THEN 0.15 WHEN i < 75 THEN 0.4 ELSE 0.7 END END::DOUBLE', 'failure_probability')},
 CASE WHEN rmr >= 81 THEN 'Spot bolts' WHEN rmr >= 61 THEN 'Systematic bolts' ELSE 'Systematic bolts + mesh' END AS bolts, CASE WHEN rmr >= 81 THEN '2.5m' WHEN rmr >= 61 THEN '1.5-2.0m' WHEN rmr >= 21 THEN '1.0-1.5m' ELSE '1.0m' END AS spacing, CASE WHEN rmr >= 81 THEN 'No' WHEN rmr >= 61 THEN 'Optional' ELSE 'Yes' END AS mesh FROM c""")
def slope_risk(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    rating = F.col("share")
    risk = rock.slope_risk(rating, 30 + F.col("size"), 5 + F.col("size") / 4, F.col("id") % 2 == 0, F.col("id") % 3 == 0)
    return rounded(rows.select("id", *(c.alias(n) for n, c in {**risk, **rock.support(rating)}.items())))


@query(f"WITH {_LINES} SELECT id, {r('size * 100 * 1.15', 'tonnes')}, {r('(size * 100 * share + size * 15 * 0.4) / (size * 115)', 'grade')}, {r('least(greatest((share / 100 * 0.6 + CASE WHEN size < 30 THEN size / 30 ELSE 0.5 END * 0.3 + 0.5 * 0.1) / 1.0, 0), 1)', 'burst')} FROM lines")
def diluted_stopes(spark, sf_dir):
    tonnes, grade = rock.diluted(F.col("size") * 100, F.col("share"), 1.5, 0.4)
    return rounded(_lines(spark, sf_dir).select("id", tonnes.alias("tonnes"), grade.alias("grade"), rock.rockburst_index(F.col("share") / 100, F.col("size"), F.lit(0.5), threshold=30.0).alias("burst")))

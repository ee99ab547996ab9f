"""Queries of planning, reporting, modelling and simulation, each with the same in SQL for DuckDB; they register beside those of :mod:`queries`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import aggregates, economics as money, intervals, kriging, modelling, planning, processes, reporting, selection, simulation, spatial, structural, survey, timeseries, validation, variograms
from . import tables as V
from .queries import _DIST, _PAIRS, _PLANES, ORACLE_SQL, _planes, query, r, rounded

# --- planning -------------------------------------------------------------------


@query(f"WITH {V.BLOCKS}, l AS (SELECT min(z) AS lo, max(z) AS hi FROM blocks), s AS (SELECT block_id, period, least(floor((z - lo) / ((hi - lo) / 4)) + 1, 4)::INT AS phase FROM blocks, l), k AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY period) - 1 AS k, count(*) OVER (PARTITION BY phase) AS n FROM s), st AS (SELECT phase + 1 AS phase, period AS st FROM k WHERE k = floor(n * 0.75)), p AS (SELECT s.phase, greatest(period, coalesce(st, 0)) AS period FROM s LEFT JOIN st USING (phase)) SELECT phase, period, count(*) AS n FROM p GROUP BY ALL")
def phased_schedule(spark, sf_dir):
    blocks = V.blocks(spark, sf_dir)
    rows = planning.phased_schedule(blocks.select("block_id", "period"), money.phases(blocks, "z", 4))
    return rows.groupBy("phase", "period").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {V.BLOCKS}, p AS (SELECT domain, period, class, count(*) AS n, sum(tonnes) AS t, sum(tonnes * grade) AS m, sum(tonnes * grade2) AS m2 FROM blocks GROUP BY ALL) SELECT domain, period, sum(n)::BIGINT AS blocks, {r('sum(t)', 'tonnes')}, arg_max(class, t) AS material, {r('sum(m) / sum(t)', 'grade')}, {r('sum(m2) / sum(t)', 'grade2')} FROM p GROUP BY domain, period")
def scheduling_units(spark, sf_dir):
    return rounded(planning.scheduling_units(V.blocks(spark, sf_dir), ["domain", "period"], ["grade", "grade2"], "class"))


@query(f"WITH {V.BLOCKS}, w AS (SELECT *, grade * 60 * 0.85::DOUBLE - 25 AS w FROM blocks) SELECT floor(x / 50)::BIGINT AS ix, floor(y / 50)::BIGINT AS iy, floor(z / 30)::BIGINT AS iz, count(*) AS blocks, {r('count(*) * 25 * 25 * 10 * 2.7::DOUBLE', 'tonnes')}, {r('avg(grade)', 'grade')}, {r('avg(w)', 'worth')} FROM w WHERE w >= 100 GROUP BY 1, 2, 3")
def grid_stopes(spark, sf_dir):
    return rounded(planning.grid_stopes(V.blocks(spark, sf_dir), "grade", 100.0, (50.0, 50.0, 30.0), (25.0, 25.0, 10.0)))


@query(f"WITH {V.BLOCKS} SELECT floor(x / 100)::BIGINT AS ix, floor(y / 100)::BIGINT AS iy, floor(z / 20)::BIGINT AS level, count(*) AS blocks, {r('sum(tonnes)', 'tonnes')}, {r('sum(tonnes * grade) / sum(tonnes)', 'grade')} FROM blocks WHERE x BETWEEN 100 AND 700 AND y BETWEEN 50 AND 400 GROUP BY 1, 2, 3")
def cave_footprint(spark, sf_dir):
    inside = selection.box({"x": (100, 700), "y": (50, 400)})
    return rounded(planning.cave_footprint(V.blocks(spark, sf_dir), inside, 100.0, 20.0))


_SHELLS = "shells AS (SELECT s_nationkey AS shell, sum(s_suppkey * 100)::DOUBLE AS tonnes, sum(s_acctbal) AS value FROM supplier GROUP BY 1)"


def _shells(spark, sf_dir):
    return V.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("shell")).agg((F.sum("s_suppkey") * 100).cast("double").alias("tonnes"), F.sum("s_acctbal").alias("value"))


@query(f"WITH RECURSIVE {_SHELLS}, k AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN tonnes > 0 THEN value / tonnes ELSE 0 END DESC, shell) AS k, sum(tonnes) OVER () / 4 AS most FROM shells), g AS (SELECT k, shell, 1 AS p, tonnes AS used, tonnes, value FROM k WHERE k = 1 UNION ALL SELECT k.k, k.shell, CASE WHEN g.used >= most AND p < 4 THEN p + 1 ELSE p END, CASE WHEN g.used >= most AND p < 4 THEN 0 ELSE g.used END + k.tonnes, k.tonnes, k.value FROM g JOIN k ON k.k = g.k + 1) SELECT p AS pushback, count(*) AS shells, {r('sum(tonnes)', 'tonnes')}, {r('sum(value)', 'value')} FROM g GROUP BY 1")
def pushbacks_by_value(spark, sf_dir):
    shells = _shells(spark, sf_dir)
    return rounded(planning.pushback_totals(shells, planning.pushbacks_by_value(shells, 4)))


@query(f"WITH RECURSIVE {_SHELLS}, k AS (SELECT *, row_number() OVER (ORDER BY shell) AS k FROM shells WHERE tonnes > 0), g AS (SELECT 0::BIGINT AS k, 0::BIGINT AS shell, 1 AS p, 60000::DOUBLE AS room, 0::DOUBLE AS t, false AS used UNION ALL SELECT k.k, k.shell::BIGINT, CASE WHEN g.room >= k.tonnes OR p >= 6 THEN p ELSE p + 1 END, CASE WHEN g.room >= k.tonnes THEN g.room - k.tonnes WHEN p >= 6 THEN g.room ELSE 60000 - least(k.tonnes, 60000) END, CASE WHEN g.room >= k.tonnes THEN k.tonnes ELSE least(k.tonnes, 60000) END, g.room >= k.tonnes OR p < 6 FROM g JOIN k ON k.k = g.k + 1) SELECT shell, p AS period, {r('t', 'tonnes')} FROM g WHERE used")
def shells_in_periods(spark, sf_dir):
    return rounded(planning.shells_in_periods(_shells(spark, sf_dir), 60000.0, 6))


@query(f"WITH {_SHELLS}, s AS (SELECT shell::BIGINT AS shell, tonnes, 0.5::DOUBLE + shell / 20.0::DOUBLE AS factor FROM shells), p AS (SELECT unnest(range(12)) * 7 + 40::DOUBLE AS price), f AS (SELECT price, greatest(least(price / 80, (SELECT max(factor) FROM s)), (SELECT min(factor) FROM s)) AS f FROM p), ab AS (SELECT price, f, (SELECT max(factor) FROM s WHERE factor <= f) AS fa, (SELECT min(factor) FROM s WHERE factor >= f) AS fb FROM f) SELECT price, {r('f', 'factor')}, a.shell AS floor_shell, CASE WHEN f - fa <= fb - f THEN a.shell ELSE b.shell END AS nearest_shell, {r('a.tonnes + CASE WHEN fb > fa THEN (f - fa) / (fb - fa) ELSE 0 END * (b.tonnes - a.tonnes)', 'tonnes')} FROM ab JOIN s a ON a.factor = fa JOIN s b ON b.factor = fb")
def chosen_shells(spark, sf_dir):
    shells = _shells(spark, sf_dir).withColumn("factor", 0.5 + F.col("shell") / 20.0)
    prices = spark.range(12).select((F.col("id") * 7 + 40).cast("double").alias("price"))
    return rounded(planning.chosen_shells(prices, shells, 80.0))


@query(f"WITH {V.BLOCKS}, p AS (SELECT period, sum(tonnes) AS t FROM blocks GROUP BY 1), a AS (SELECT period, unnest(['PB1', 'PB2']) AS unit, t / 3 AS t FROM p) SELECT period, unit, unnest(['B1', 'B2', 'B3', 'B4', 'B5']) AS bench, {r('t / 5', 'tonnes')} FROM a")
def tactical_split(spark, sf_dir):
    per = V.blocks(spark, sf_dir).groupBy("period").agg(F.sum("tonnes").alias("tonnes"))
    units = planning.split_over(per, "unit", ["PB1", "PB2"], 3)
    return rounded(planning.split_over(units, "bench", [f"B{k}" for k in range(1, 6)]).select("period", "unit", "bench", "tonnes"))


@query(f"WITH {V.BLOCKS}, routes AS (SELECT unnest(['A', 'N']) AS source, unnest(['plant', 'dump']) AS destination, unnest([22, 35])::DOUBLE AS cycle), s AS (SELECT period, domain AS source, CASE WHEN domain = 'N' THEN 'dump' ELSE 'plant' END AS destination, sum(tonnes) AS t FROM blocks GROUP BY ALL), h AS (SELECT period, sum(t) AS t, coalesce(sum(t / 90 * cycle / 60), 0) AS need, count(cycle) AS routes FROM s LEFT JOIN routes USING (source, destination) GROUP BY 1) SELECT period, {r('t', 'scheduled_tonnes')}, {r('CASE WHEN need > 800 THEN t * 800 / need ELSE t END', 'effective_tonnes')}, {r('need', 'required_hours')}, {r('need / 800 * 100', 'utilisation')}, {r('greatest(need - 800, 0)', 'shortfall_hours')}, {r('t - CASE WHEN need > 800 THEN t * 800 / need ELSE t END', 'shortfall_tonnes')}, routes FROM h")
def haulage_capacity(spark, sf_dir):
    schedule = V.blocks(spark, sf_dir).select("period", F.col("domain").alias("source"), F.when(F.col("domain") == "N", "dump").otherwise("plant").alias("destination"), "tonnes")
    routes = spark.createDataFrame([("A", "plant", 22.0), ("N", "dump", 35.0)], "source string, destination string, cycle_minutes double")
    return rounded(planning.haulage(schedule, routes, 90.0, 800.0))


@query(f"WITH {_SHELLS}, s AS (SELECT shell, CASE WHEN shell % 3 = 0 THEN 'draft' ELSE 'completed' END AS status, CASE WHEN shell % 4 <> 1 THEN value END AS npv FROM shells), c AS (SELECT * FROM s WHERE status = 'completed') SELECT shell::BIGINT AS scenario, status, {r('npv', 'npv')}, {r('(SELECT max(npv) FROM c)', 'best_npv')}, {r('(SELECT min(npv) FROM c)', 'worst_npv')}, {r('(SELECT avg(npv) FROM c)', 'mean_npv')} FROM c")
def compared_scenarios(spark, sf_dir):
    shells = _shells(spark, sf_dir)
    scenarios = shells.select(F.col("shell").alias("scenario"), F.when(F.col("shell") % 3 == 0, "draft").otherwise("completed").alias("status"))
    results = shells.where("shell % 4 != 1").select(F.col("shell").alias("scenario"), F.col("value").alias("npv"))
    return rounded(planning.compared_scenarios(scenarios, results))


@query("WITH a AS (SELECT unnest([40, 50, 60]) AS price, unnest([0, 1, 2]) AS i), b AS (SELECT unnest([0.08, 0.1])::DOUBLE AS rate, unnest([0, 1]) AS j), c AS (SELECT unnest(['low', 'high']) AS cost, unnest([0, 1]) AS k) SELECT (i * 4 + j * 2 + k)::BIGINT AS instance, price, rate, cost FROM a, b, c")
def scenario_grid(spark, sf_dir):
    return planning.scenario_grid({"price": [40, 50, 60], "rate": [0.08, 0.1], "cost": ["low", "high"]}, spark)


@query(f"WITH {V.BLOCKS}, p AS (SELECT period, sum(tonnes) AS ore FROM blocks GROUP BY 1) SELECT period, {r('ore / 1000 * 0.1 + ore * 3 / 1000 * 0.3', 'area', 6)} FROM p")
def disturbed_area(spark, sf_dir):
    per = V.blocks(spark, sf_dir).groupBy("period").agg(F.sum("tonnes").alias("ore"))
    return rounded(planning.disturbance(per), 6)


@query(f"WITH {V.BLOCKS}, c AS (SELECT unnest(range(10))::DOUBLE AS cutoff), a AS (SELECT cutoff, sum(CASE WHEN grade >= cutoff THEN tonnes ELSE 0 END) AS a, sum(CASE WHEN grade2 >= cutoff THEN tonnes ELSE 0 END) AS b FROM blocks, c GROUP BY 1), n AS (SELECT abs(a - b) AS d, lead(abs(a - b)) OVER (ORDER BY cutoff) AS n FROM a), v AS (SELECT value / 100000 AS v FROM blocks) SELECT {r('sum((d + n) / 2)', 'loss')}, {r('(SELECT -ln(avg(exp(-0.5 * v))) / 0.5 FROM v)', 'certain')} FROM n")
def curve_loss(spark, sf_dir):
    blocks = V.blocks(spark, sf_dir)
    cuts = [float(c) for c in range(10)]
    loss = planning.curve_loss(aggregates.grade_tonnage(blocks, "grade", "tonnes", cuts), aggregates.grade_tonnage(blocks, "grade2", "tonnes", cuts))
    sure = planning.certainty_equivalent(blocks.select((F.col("value") / 100000).alias("v")), "v", 0.5)
    return rounded(loss.crossJoin(sure.withColumnRenamed("value", "certain")))


@query(f"WITH {V.SAMPLES}, f AS (SELECT hole % 5 AS k, value / 50 AS f FROM samples) SELECT k, count(*) AS n, {r('avg((f < 1)::INT)', 'failure_probability')} FROM f GROUP BY k")
def failure_shares(spark, sf_dir):
    rows = V.samples(spark, sf_dir).select((F.col("hole") % 5).alias("k"), (F.col("value") / 50).alias("f"))
    return rounded(planning.failure_share(rows, "f", ["k"]))


@query(f"WITH {_SHELLS} SELECT shell, {r('tonnes', 'tonnes')}, {r('value', 'value')}, {r('abs(value - tonnes)', 'swing')}, row_number() OVER (ORDER BY abs(value - tonnes) DESC, shell) AS rank FROM (SELECT shell::BIGINT AS shell, tonnes, value FROM shells)")
def tornado(spark, sf_dir):
    return rounded(planning.tornado(_shells(spark, sf_dir), "shell", "tonnes", "value"))


@query("WITH t AS (SELECT s_suppkey AS id, s_suppkey % 7 * 20 + 60 AS payload, 0.8 + s_suppkey % 10 / 100.0::DOUBLE AS a, 0.7 + s_suppkey % 20 / 100.0::DOUBLE AS u FROM supplier) SELECT " + r("sum(payload * a * u * 2)", "capacity", 3) + " FROM t")
def fleet_capacity(spark, sf_dir):
    key = F.col("s_suppkey")
    rows = V.table(spark, sf_dir, "supplier").select((key % 7 * 20 + 60).alias("payload"), (0.8 + key % 10 / 100.0).alias("availability"), (0.7 + key % 20 / 100.0).alias("utilisation"))
    return rounded(planning.fleet_capacity(rows), 3)


@query(f"WITH {V.SAMPLES}, s AS (SELECT hole AS route, sum(value) AS required FROM samples GROUP BY 1), b AS (SELECT *, coalesce(sum(required) OVER (ORDER BY required DESC, route ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s) SELECT route, {r('required', 'required')}, {r('greatest(least(required, 20000 - b), 0)', 'allocated')} FROM b")
def allocated_hours(spark, sf_dir):
    routes = V.samples(spark, sf_dir).groupBy(F.col("hole").alias("route")).agg(F.sum("value").alias("required"))
    return rounded(planning.allocated_hours(routes, 20000.0))


@query(f"WITH {V.BLOCKS}, c AS (SELECT x, y, z, min(block_id) AS id FROM blocks GROUP BY 1, 2, 3), e AS (SELECT a.id AS block, b.id AS above, degrees(atan2(b.x - a.x, b.y - a.y)) AS az, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS d, b.z - a.z AS h FROM c a JOIN c b ON b.z > a.z AND b.z <= a.z + 20 AND abs(b.x - a.x) <= 60 AND abs(b.y - a.y) <= 60) SELECT count(*) AS edges, (sum(block % 1009) + sum(above % 1013))::BIGINT AS mark FROM e WHERE d <= h / tan(radians(CASE WHEN (az + 360) % 360 >= 300 OR (az + 360) % 360 < 60 THEN 30 ELSE 45 END)) + 1e-9")
def sloped_precedence(spark, sf_dir):
    cells = V.blocks(spark, sf_dir).groupBy("x", "y", "z").agg(F.min("block_id").alias("block_id"))
    edges = planning.sloped_precedence(cells, (25.0, 25.0, 10.0), [(300.0, 60.0, 30.0)], 45.0, 2)
    return edges.agg(F.count(F.lit(1)).alias("edges"), (F.sum(F.col("block") % 1009) + F.sum(F.col("above") % 1013)).alias("mark"))


def _u(*keys) -> str:
    """SQL of the hashed uniform of the simulation operators."""
    return f"((('0x' || substr(md5(concat_ws('|', {', '.join(map(str, keys))})), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496)"


def _normal(seed: int, *keys) -> str:
    return f"(sqrt(-2 * ln({_u(seed, *keys)})) * cos({_u(seed + 7919, *keys)} * 6.283185307179586::DOUBLE))"


def _poly(x: str, k) -> str:
    out = repr(float(k[0])) + "::DOUBLE"
    for v in k[1:]:
        out = f"({out} * {x} + {float(v)!r}::DOUBLE)"
    return out


def _quantile(p: str) -> str:
    """SQL of the inverse normal."""
    a, b, c, d = simulation.QUANTILE
    q, t = f"({p} - 0.5)", f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    edge = f"({_poly(t, c)} / {_poly(t, d)})"
    return f"(CASE WHEN {p} < 0.02425 THEN {edge} WHEN {p} > 1 - 0.02425 THEN -{edge} ELSE {q} * {_poly(f'({q} * {q})', a)} / {_poly(f'({q} * {q})', b)} END)"


_DRAWS = f"draws AS (SELECT draw, 40 + {_u(1, 'draw')} * 20 AS price, 3 + {_u(2, 'draw')} AS mining, 8 + {_u(3, 'draw')} * 4 AS processing, 0.8 + {_u(4, 'draw')} * 0.15 AS recovery FROM (SELECT unnest(range(50)) AS draw))"


def _draws(spark):
    u = lambda k: simulation.uniform(k, F.col("draw"))
    return spark.range(50).select(F.col("id").alias("draw")).select("draw", (40 + u(1) * 20).alias("price"), (3 + u(2)).alias("mining"), (8 + u(3) * 4).alias("processing"), (0.8 + u(4) * 0.15).alias("recovery"))


@query(f"WITH {V.BLOCKS}, {_DRAWS}, p AS (SELECT period, sum(tonnes) AS t, sum(tonnes * grade) / 100 AS m FROM blocks GROUP BY 1) SELECT draw, {r('sum((m * recovery * price - t * (mining + processing)) * pow(1.08::DOUBLE, -period))', 'npv', 2)} FROM draws, p GROUP BY draw")
def simulated_values(spark, sf_dir):
    return rounded(planning.simulated_values(V.blocks(spark, sf_dir), _draws(spark), 0.08), 2)


# --- simulation -----------------------------------------------------------------

_SCORES = f"o AS (SELECT sample_id, value, row_number() OVER (ORDER BY value, sample_id) AS k, count(*) OVER () AS n FROM samples), sc AS (SELECT sample_id, value, k, n, {_quantile('((k - 0.5::DOUBLE) / n)')} AS g FROM o)"


@query(f"""WITH {V.SAMPLES}, {_SCORES},
 h AS (SELECT k, n, g, value AS v, g - lag(g) OVER w AS h0, lead(g) OVER w - g AS h1, (value - lag(value) OVER w) / (g - lag(g) OVER w) AS m0, (lead(value) OVER w - value) / (lead(g) OVER w - g) AS m1, (lead(value, 2) OVER w - lead(value) OVER w) / (lead(g, 2) OVER w - lead(g) OVER w) AS m2, lead(g, 2) OVER w - lead(g) OVER w AS h2, (lag(value) OVER w - lag(value, 2) OVER w) / (lag(g) OVER w - lag(g, 2) OVER w) AS mm, lag(g) OVER w - lag(g, 2) OVER w AS hh FROM sc WINDOW w AS (ORDER BY k)),
 e AS (SELECT *, ((2 * h1 + h2) * m1 - h1 * m2) / (h1 + h2) AS da, ((2 * h0 + hh) * m0 - h0 * mm) / (h0 + hh) AS dz FROM h),
 d AS (SELECT g, v, CASE WHEN k = 1 THEN CASE WHEN sign(da) <> sign(m1) THEN 0 WHEN sign(m1) <> sign(m2) AND abs(da) > 3 * abs(m1) THEN 3 * m1 ELSE da END WHEN k = n THEN CASE WHEN sign(dz) <> sign(m0) THEN 0 WHEN sign(m0) <> sign(mm) AND abs(dz) > 3 * abs(m0) THEN 3 * m0 ELSE dz END WHEN m0 * m1 <= 0 THEN 0 ELSE (3 * h0 + 3 * h1) / ((2 * h1 + h0) / m0 + (h1 + 2 * h0) / m1) END AS d FROM e),
 q AS (SELECT i AS id, i / 40.0::DOUBLE - 5 AS s FROM (SELECT unnest(range(401)) AS i)),
 f AS (SELECT id, s, a.g AS ga, a.v AS va, a.d AS dga FROM q ASOF LEFT JOIN d a ON q.s >= a.g), b AS (SELECT id, z.g AS gb, z.v AS vb, z.d AS dgb FROM q ASOF LEFT JOIN d z ON q.s <= z.g),
 t AS (SELECT f.*, gb, vb, dgb, gb - ga AS w, (s - ga) / nullif(gb - ga, 0) AS t FROM f JOIN b USING (id))
 SELECT id, {r('CASE WHEN ga IS NULL THEN vb WHEN gb IS NULL THEN va WHEN w = 0 THEN va ELSE (1 + 2 * t) * (1 - t) ** 2 * va + t * (1 - t) ** 2 * w * dga + t * t * (3 - 2 * t) * vb + t * t * (t - 1) * w * dgb END', 'value')} FROM t""")
def back_transformed_scores(spark, sf_dir):
    fitted = simulation.normal_scores(V.samples(spark, sf_dir), "value")
    wanted = spark.range(401).select("id", (F.col("id") / 40.0 - 5).alias("s"))
    return rounded(simulation.back_transformed(wanted, "s", fitted, "value").select("id", "value"))


_BALL = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if i * i + j * j + k * k <= 4]


@query(f"WITH o AS (SELECT unnest({[b[0] for b in _BALL]}) AS i, unnest({[b[1] for b in _BALL]}) AS j, unnest({[b[2] for b in _BALL]}) AS k), n AS (SELECT id // 80 AS realisation, id % 80 AS block_id, id % 80 % 5 AS x, id % 80 // 5 % 4 AS y, id % 80 // 20 AS z FROM (SELECT unnest(range(320)) AS id)), s AS (SELECT realisation, block_id, sum({_normal(1, 'realisation', 'x + i', 'y + j', 'z + k')}) * sqrt(0.9::DOUBLE / {len(_BALL)}) AS v FROM n, o GROUP BY ALL) SELECT realisation, block_id, {r('v + ' + _normal(2, 'realisation', 'block_id') + ' * sqrt(0.1::DOUBLE)', 'value', 6)} FROM s")
def moving_average_values(spark, sf_dir):
    return rounded(simulation.moving_average_fields(spark, (5, 4, 4), (10.0, 10.0, 10.0), {"nugget": 0.1, "sill": 0.9, "range": 40.0}, 4), 6)


def _poisson(u: str) -> str:
    total, term, out = 0.0, 0.36787944117144233, []
    for k in range(1, simulation.MOST_DRAWS + 1):
        total += term
        out.append(f"CASE WHEN {u} > {total!r}::DOUBLE THEN 1 ELSE 0 END")
        term /= k
    return "(" + " + ".join(out) + ")"


_RESAMPLED = f"d AS (SELECT i AS iteration, sample_id, value, z, hole, {_poisson('u')} AS n FROM (SELECT *, {_u(1, 'i', 'sample_id')} AS u FROM samples, (SELECT unnest(range(1, 41)) AS i)))"


@query(f"WITH {V.SAMPLES}, {_RESAMPLED} SELECT iteration::INT AS iteration, {r('sum(n * value) / sum(n)', 'mean')}, {r('sum(n * value) / sum(n * z)', 'ratio')} FROM d GROUP BY 1")
def resampled_means(spark, sf_dir):
    samples = V.samples(spark, sf_dir)
    means = simulation.bootstrap_means(samples, "value", "sample_id", 40)
    return rounded(means.join(simulation.bootstrap_ratios(samples, "value", "z", "sample_id", 40), "iteration"))


@query(f"WITH {V.SAMPLES}, {_RESAMPLED}, g AS (SELECT hole % 3 AS k, iteration, sum(n * value) / sum(n) AS m FROM d GROUP BY ALL) SELECT k, {r('avg(m)', 'mean')}, {r('stddev_samp(m)', 'std')}, {r('quantile_cont(m, 0.05)', 'low')}, {r('quantile_cont(m, 0.95)', 'high')} FROM g GROUP BY k")
def resampled_groups(spark, sf_dir):
    draws = simulation.bootstrap_means(V.samples(spark, sf_dir).withColumn("k", F.col("hole") % 3), "value", "sample_id", 40, by=["k"])
    return rounded(simulation.confidence(draws, "mean", by=["k"]))


@query(f"WITH {V.SAMPLES}, s AS (SELECT sample_id, value, hole % 2 = 0 AS f FROM samples), o AS (SELECT avg(value) FILTER (f) - avg(value) FILTER (NOT f) AS d, avg(f::INT) AS share FROM s), c AS (SELECT i, avg(value) FILTER (u < share) - avg(value) FILTER (NOT u < share) AS c FROM (SELECT s.*, i, share, {_u(1, 'i', 'sample_id')} AS u FROM s, o, (SELECT unnest(range(1, 61)) AS i)) GROUP BY i) SELECT {r('any_value(d)', 'difference')}, {r('avg((abs(c) >= abs(d))::INT)', 'p_value')} FROM c, o")
def permuted_difference(spark, sf_dir):
    return rounded(simulation.permuted_difference(V.samples(spark, sf_dir), "value", F.col("hole") % 2 == 0, "sample_id", 60))


@query(f"WITH d AS (SELECT unnest(range(500)) AS draw), a AS (SELECT draw, (row_number() OVER (ORDER BY {_u(1, 0, 'draw')}, draw) - {_u(2, 'draw')}) / 500 AS u0, (row_number() OVER (ORDER BY {_u(1, 1, 'draw')}, draw) - {_u(3, 'draw')}) / 500 AS u1, (row_number() OVER (ORDER BY {_u(1, 2, 'draw')}, draw) - {_u(4, 'draw')}) / 500 AS u2 FROM d) SELECT draw, {r('10 + u0 * 5', 'cost')}, {r('CASE WHEN u1 < 0.3 THEN 40 + sqrt(u1 * 50 * 15) ELSE 90 - sqrt((1 - u1) * 50 * 35) END', 'price')}, {r('3 + 0.5 * ' + _quantile('u2'), 'grade')} FROM a")
def latin_hypercube(spark, sf_dir):
    return rounded(simulation.latin_hypercube(spark, 500, {"cost": ("uniform", 10.0, 15.0), "price": ("triangular", 40.0, 90.0, 55.0), "grade": ("normal", 3.0, 0.5)}))


@query(f"WITH RECURSIVE p AS (SELECT id, 0 AS period, 50::DOUBLE AS price FROM (SELECT unnest(range(30)) AS id) UNION ALL SELECT id, period + 1, greatest(price * exp(0.01 + 0.2 * (50 - price) / 50 + 0.1 * {_normal(1, 'id', 'period + 1')}), 0.01) FROM p WHERE period < 10) SELECT id AS scenario, period, {r('price', 'price')} FROM p")
def price_paths(spark, sf_dir):
    return rounded(simulation.price_paths(spark, 30, 10, 50.0, 0.01, 0.2, 0.1))


@query(f"WITH {V.TARGETS}, t AS (SELECT block_id, i AS realisation, 0.2 + block_id % 5 / 20.0::DOUBLE AS a, 0.6 + block_id % 7 / 20.0::DOUBLE AS b, {_u(1, 'i', 'block_id')} AS u FROM targets, (SELECT unnest(range(4))::INT AS i)), v AS (SELECT *, CASE WHEN u <= a THEN u / a * 25 WHEN u <= b THEN 25 + (u - a) / (b - a) * 20 ELSE 45 + (u - b) / (1 - b) * 55 END AS v FROM t), m AS (SELECT block_id, avg((v > 30)::INT) AS p FROM v GROUP BY 1) SELECT v.block_id, realisation, {r('v', 'value')}, {r('p', 'p_mined')}, CASE WHEN p >= 0.8 THEN 'robust' WHEN p <= 0.2 THEN 'fringe' ELSE 'marginal' END AS class FROM v JOIN m USING (block_id)")
def drawn_grades(spark, sf_dir):
    blocks = V.targets(spark, sf_dir).select("block_id", (0.2 + F.col("block_id") % 5 / 20.0).alias("p0"), (0.6 + F.col("block_id") % 7 / 20.0).alias("p1"))
    reals = simulation.from_distribution(blocks, ["p0", "p1"], [25.0, 45.0], 0.0, 100.0, 4)
    shells = simulation.shell_probability(reals.withColumn("mined", F.col("value") > 30), "block_id", "mined")
    return rounded(reals.join(shells, "block_id"))


_REALS = f"reals AS (SELECT block_id, i AS realisation, 20 + {_u(5, 'block_id', 'i')} * 60 AS value FROM targets, (SELECT unnest(range(10)) AS i))"


def _reals(spark, sf_dir):
    rows = V.targets(spark, sf_dir).withColumn("realisation", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    return rows.select("block_id", "realisation", (20 + simulation.uniform(5, F.col("block_id"), F.col("realisation")) * 60).alias("value"))


@query(f"WITH {V.TARGETS}, {_REALS} SELECT block_id, count(*) AS n, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'std')}, {r('min(value)', 'min')}, {r('max(value)', 'max')}, {r('quantile_cont(value, 0.1)', 'p10')}, {r('quantile_cont(value, 0.5)', 'p50')}, {r('quantile_cont(value, 0.9)', 'p90')}, {r('stddev_pop(value) / avg(value)', 'cv')}, {r('avg((value > 40)::INT)', 'p_40_0')}, {r('avg((value > 60)::INT)', 'p_60_0')} FROM reals GROUP BY block_id")
def realisation_summary(spark, sf_dir):
    reals = _reals(spark, sf_dir)
    return rounded(aggregates.by_realisation(reals, "block_id", "value").join(aggregates.exceedance(reals, "block_id", "value", [40.0, 60.0]), "block_id"))


@query(f"WITH {V.TARGETS}, {_REALS}, c AS (SELECT unnest([30, 50, 70])::DOUBLE AS cutoff), g AS (SELECT realisation, cutoff, sum(CASE WHEN value >= cutoff THEN 1000 ELSE 0 END)::DOUBLE AS t, sum(CASE WHEN value >= cutoff THEN 1000 * value ELSE 0 END) AS m FROM reals, c GROUP BY ALL), h AS (SELECT *, coalesce(m / nullif(t, 0), 0) AS g FROM g) SELECT cutoff, {r('avg(t)', 'tonnes_mean')}, {r('quantile_cont(t, 0.1)', 'tonnes_p10')}, {r('quantile_cont(t, 0.9)', 'tonnes_p90')}, {r('avg(m)', 'metal_mean', 2)}, {r('quantile_cont(m, 0.1)', 'metal_p10', 2)}, {r('quantile_cont(m, 0.9)', 'metal_p90', 2)}, {r('avg(g)', 'grade_mean')}, {r('quantile_cont(g, 0.1)', 'grade_p10')}, {r('quantile_cont(g, 0.9)', 'grade_p90')} FROM h GROUP BY cutoff")
def global_uncertainty(spark, sf_dir):
    out = rounded(aggregates.global_uncertainty(_reals(spark, sf_dir), "realisation", "value", 1000.0, [30.0, 50.0, 70.0]))
    return out.withColumns({f"metal_{n}": F.round(f"metal_{n}", 2) for n in ("mean", "p10", "p90")})


@query(f"WITH {V.TARGETS}, {V.SAMPLES}, {_REALS}, t AS (SELECT avg(value) AS m, var_pop(value) AS v FROM samples) SELECT realisation, {r('avg(value)', 'mean')}, {r('var_pop(value)', 'variance')}, {r('avg(value) / any_value(m)', 'mean_ratio')}, {r('var_pop(value) / any_value(v)', 'variance_ratio')} FROM reals, t GROUP BY realisation")
def reproduction(spark, sf_dir):
    return rounded(reporting.reproduction(V.samples(spark, sf_dir), _reals(spark, sf_dir), "value", "realisation"))


# --- reporting ------------------------------------------------------------------


@query(f"WITH {V.BLOCKS}, d AS (SELECT count(*) - count(DISTINCT (x, y, z)) AS duplicates FROM blocks) SELECT c AS \"column\", n AS rows, 0::BIGINT AS missing, neg AS negative, varies, duplicates FROM (SELECT unnest(['grade', 'value', 'tonnes']) AS c, count(*) AS n, unnest([0, 0, count(*) FILTER (tonnes < 0)])::BIGINT AS neg, unnest([min(grade) <> max(grade), min(value) <> max(value), min(tonnes) <> max(tonnes)]) AS varies FROM blocks), d")
def data_quality(spark, sf_dir):
    return reporting.quality(V.blocks(spark, sf_dir), ["grade", "value", "tonnes"], ("tonnes",), ["x", "y", "z"])


@query(f"WITH {V.BLOCKS} SELECT class, count(*) AS n, {r('sum(tonnes)', 'weight')}, {r('100 * sum(tonnes) / sum(sum(tonnes)) OVER ()', 'percent')} FROM blocks GROUP BY class")
def class_shares(spark, sf_dir):
    return rounded(reporting.shares(V.blocks(spark, sf_dir), "class", "tonnes"))


@query(f"WITH {V.BLOCKS}, a AS (SELECT count(*) AS n, avg(value) AS m, stddev_pop(value) AS s, median(value) AS d FROM blocks WHERE domain = 'A'), b AS (SELECT count(*) AS n, avg(value) AS m, stddev_pop(value) AS s, median(value) AS d FROM blocks WHERE domain = 'N') SELECT a.n AS n_1, {r('a.m', 'mean_1')}, {r('a.s', 'std_1')}, {r('a.d', 'median_1')}, b.n AS n_2, {r('b.m', 'mean_2')}, {r('b.s', 'std_2')}, {r('b.d', 'median_2')}, {r('a.m - b.m', 'mean_difference')}, {r('a.d - b.d', 'median_difference')}, {r('a.s - b.s', 'std_difference')}, {r('100 * (a.m - b.m) / b.m', 'mean_percent')}, {r('100 * (a.d - b.d) / b.d', 'median_percent')} FROM a, b")
def compared_datasets(spark, sf_dir):
    rows = V.blocks(spark, sf_dir)
    return rounded(reporting.compared(rows.where("domain = 'A'"), rows.where("domain = 'N'"), "value"))


@query(f"WITH {V.BLOCKS}, {V.SAMPLES}, s AS (SELECT 'blocks' AS source, value AS v FROM blocks UNION ALL SELECT 'samples', value FROM samples) SELECT source, count(*) AS n, {r('avg(v)', 'mean')}, {r('stddev_pop(v)', 'std')}, {r('min(v)', 'min')}, {r('max(v)', 'max')} FROM s GROUP BY source")
def statistics_by_source(spark, sf_dir):
    return rounded(reporting.by_source({"blocks": V.blocks(spark, sf_dir), "samples": V.samples(spark, sf_dir)}, "value"))


@query("SELECT 'all' AS key, NULL::VARCHAR AS entry, count(*) AS n FROM events UNION ALL SELECT 'event_type', event_type, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'user_id', user_id::VARCHAR, count(*) FROM events GROUP BY 2")
def log_counts(spark, sf_dir):
    return reporting.log_counts(V.table(spark, sf_dir, "events"), ["event_type", "user_id"])


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 25")
def latest_entries(spark, sf_dir):
    return reporting.log_entries(V.table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "user_id"), {"event_type": "click", "user_id": None}, "ts", latest=25).select("event_id", "user_id")


@query(f"SELECT event_type, count(*) AS n, {r('avg((value > 20)::INT)', 'success_rate')}, {r('avg(value)', 'mean')}, {r('max(value)', 'longest')}, {r('quantile_cont(value, 0.95)', 'p95')} FROM events GROUP BY 1")
def run_timings(spark, sf_dir):
    return rounded(reporting.timings(V.table(spark, sf_dir, "events"), ["event_type"], "value", F.col("value") > 20))


@query("WITH o AS (SELECT user_id, ts < lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM events) SELECT user_id, count(*) FILTER (f) AS falls, count(*) FILTER (f) = 0 AS monotonic FROM o GROUP BY 1")
def time_order(spark, sf_dir):
    return reporting.monotonic(V.table(spark, sf_dir, "events").withColumn("row", F.col("event_id")), "user_id", "ts")


@query(f"WITH {V.SAMPLES}, k AS (SELECT z, value, rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS b FROM samples), c AS (SELECT count(*) AS n, corr(z, value) AS p, corr(a, b) AS s FROM k) SELECT n, {r('p', 'pearson')}, {r('s', 'spearman')}, CASE WHEN abs(p) >= 0.7 THEN 'strong' WHEN abs(p) >= 0.5 THEN 'moderate' WHEN abs(p) >= 0.3 THEN 'weak' ELSE 'none' END AS strength, abs(p) >= 0.3 AS usable FROM c")
def correlation(spark, sf_dir):
    return rounded(reporting.correlation(V.samples(spark, sf_dir), "z", "value"))


@query(f"WITH {V.SAMPLES}, d AS (SELECT (hole % 6)::VARCHAR AS name, avg(value) AS m FROM samples GROUP BY 1 HAVING count(*) >= 5), t AS (SELECT unnest(['x', 'y', 'z']) AS name, unnest([regr_r2(value, x), regr_r2(value, y), regr_r2(value, z)]) AS s FROM samples) SELECT 'domain' AS kind, name, {r('100 * abs(m - 40) / 40', 'statistic')}, CASE WHEN 100 * abs(m - 40) / 40 > 15 THEN 'mean differs' END AS issue FROM d UNION ALL SELECT 'trend', name, {r('s', 'statistic')}, CASE WHEN s > 0.3 THEN 'strong trend' WHEN s > 0.15 THEN 'moderate trend' END FROM t")
def stationarity(spark, sf_dir):
    rows = V.samples(spark, sf_dir).withColumn("k", F.col("hole") % 6)
    return rounded(reporting.stationarity(rows, "value", "k", 40.0))


@query(f"WITH {V.SAMPLES}, g AS (SELECT DISTINCT hole % 6 AS k FROM samples), v AS (SELECT DISTINCT value AS v FROM samples), c AS (SELECT k, v, (SELECT avg((s.value <= v)::INT) FROM samples s WHERE s.hole % 6 = k) AS a, (SELECT avg((s.value <= v)::INT) FROM samples s) AS b FROM g, v) SELECT k, (SELECT count(*) FROM samples s WHERE s.hole % 6 = k) AS n, {r('max(abs(a - b))', 'distance')} FROM c GROUP BY k")
def distribution_distance(spark, sf_dir):
    rows = V.samples(spark, sf_dir).withColumn("k", F.col("hole") % 6)
    return rounded(reporting.distribution_distance(rows, "value", "k"))


@query(f"WITH {V.SAMPLES}, f AS (SELECT regr_slope(value, z) AS b, regr_intercept(value, z) AS a FROM samples) SELECT sample_id, {r('a + b * z', 'drift')}, {r('value - a - b * z', 'residual')} FROM samples, f")
def drift_residuals(spark, sf_dir):
    return rounded(reporting.drift(V.samples(spark, sf_dir), "value", ("z",))[1].select("sample_id", "drift", "residual"))


@query(f"WITH {V.BLOCKS}, a AS (SELECT avg(grade) AS e, avg(grade2) AS s, sum(grade * tonnes) / sum(tonnes) AS w FROM blocks), u AS (SELECT e, unnest(['samples', 'weighted']) AS \"check\", unnest([s, w]) AS reference FROM a) SELECT \"check\", {r('reference', 'reference')}, {r('100 * (e - reference) / reference', 'percent')}, abs(100 * (e - reference) / reference) <= 5 AS passed FROM u")
def estimate_checks(spark, sf_dir):
    g, t = F.col("grade"), F.col("tonnes")
    return rounded(reporting.checks(F.avg("grade"), {"samples": F.avg("grade2"), "weighted": F.sum(g * t) / F.sum(t)}, 5.0, V.blocks(spark, sf_dir)))


@query(f"WITH {V.BLOCKS} SELECT domain, count(*) AS n, {r('avg(abs(grade - grade2))', 'mean')}, {r('quantile_cont(abs(grade - grade2), 0.5)', 'p50')}, {r('quantile_cont(abs(grade - grade2), 0.9)', 'p90')}, CASE WHEN quantile_cont(abs(grade - grade2), 0.9) <= 1 THEN 'good' WHEN quantile_cont(abs(grade - grade2), 0.9) <= 3 THEN 'fair' ELSE 'poor' END AS class FROM blocks GROUP BY domain")
def misfit_classes(spark, sf_dir):
    return rounded(reporting.misfit(V.blocks(spark, sf_dir), "grade", "grade2", "domain"))


_CONTACTS = "contacts AS (SELECT hole_id, -(depth_to + nf) / 2 AS z, above AS formation FROM (SELECT hole_id, depth_to, lith_code AS above, lead(lith_code) OVER w AS below, lead(depth_from) OVER w AS nf FROM intervals WINDOW w AS (PARTITION BY hole_id ORDER BY depth_from, depth_to)) WHERE above <> below)"


def _contacts(spark, sf_dir):
    rows = intervals.contacts(V.intervals(spark, sf_dir), "lith_code")
    return rows.select("hole_id", (-F.col("depth")).alias("z"), F.col("above").alias("formation"))


@query(f"WITH {V.INTERVALS}, {_CONTACTS}, m AS (SELECT hole_id, formation, avg(z) AS z FROM contacts GROUP BY ALL), d AS (SELECT formation, m.z - c.z AS d FROM contacts c JOIN m USING (hole_id, formation)) SELECT formation, count(*) AS n, {r('avg(d)', 'mean')}, {r('avg(abs(d))', 'mean_absolute')}, {r('max(abs(d))', 'greatest')} FROM d WHERE abs(d) >= 0.01 GROUP BY 1")
def contact_deviations(spark, sf_dir):
    rows = _contacts(spark, sf_dir)
    modelled = rows.groupBy("hole_id", "formation").agg(F.avg("z").alias("z"))
    return rounded(reporting.deviations(rows, modelled, ["hole_id", "formation"], 0.01, ["formation"]))


@query(f"WITH {V.INTERVALS}, {_CONTACTS}, n AS (SELECT *, lead(formation) OVER w AS nf, lead(z) OVER w AS nz FROM contacts WINDOW w AS (PARTITION BY hole_id ORDER BY z DESC)), f AS (SELECT *, row_number() OVER (PARTITION BY hole_id ORDER BY z DESC) AS k FROM n WHERE formation = 'N' AND nf = 'A'), t AS (SELECT abs(z - nz) AS t FROM f WHERE k = 1 AND abs(z - nz) > 0) SELECT count(*) AS holes, {r('avg(t)', 'mean')}, {r('min(t)', 'least')}, {r('max(t)', 'greatest')}, {r('avg(t) / 12', 'voxels')}, CASE WHEN avg(t) / 12 < 1 THEN 'CRITICAL' WHEN avg(t) / 12 < 3 THEN 'WARNING' END AS warning FROM t")
def unit_thickness(spark, sf_dir):
    return rounded(reporting.unit_thickness(_contacts(spark, sf_dir), "N", "A", 12.0))


@query(f"WITH {V.SAMPLES}, b AS (SELECT hole, count(*) AS points, max(x) - min(x) AS dx, max(y) - min(y) AS dy, max(z) - min(z) AS dz FROM samples GROUP BY 1) SELECT hole, points, dx, dy, dz, {r('dx * dy * dz', 'volume')}, {r('pow(6 * dx * dy * dz / 3.141592653589793::DOUBLE, 1 / 3.0::DOUBLE)', 'diameter')}, {r('least(dx, dy, dz) / greatest(dx, dy, dz)', 'flatness')} FROM b")
def fragment_metrics(spark, sf_dir):
    return rounded(reporting.grouped_fragments(V.samples(spark, sf_dir), "hole"))


# --- modelling ------------------------------------------------------------------


@query(f"WITH {V.SAMPLES}, t AS (SELECT id AS block_id, id % 8 * 125 + 62.5::DOUBLE AS x, id // 8 % 6 * 120 + 60::DOUBLE AS y, id // 48 * 60 + 30::DOUBLE AS z FROM (SELECT unnest(range(144)) AS id)), k AS (SELECT block_id, value, {_DIST} AS d, row_number() OVER (PARTITION BY block_id ORDER BY {_DIST}, sample_id) AS k FROM t, samples s) SELECT t.block_id, x, y, z, value, {r('d', 'distance')}, (125 * 120 * 60)::DOUBLE AS volume, {r('125 * 120 * 60 * 2.7::DOUBLE', 'tonnes')} FROM t JOIN k ON k.block_id = t.block_id AND k = 1")
def built_block_model(spark, sf_dir):
    return rounded(modelling.block_model(V.samples(spark, sf_dir), "value", (8, 6, 3), (125.0, 120.0, 60.0)))


@query(f"WITH {V.SAMPLES}, e AS (SELECT max(x) - min(x) AS ex, max(y) - min(y) AS ey, max(z) - min(z) AS ez FROM samples), n AS (SELECT *, pow(ex * ey * ez / 5000, 1 / 3.0::DOUBLE) AS s FROM e) SELECT floor(ex / s)::BIGINT AS nx, floor(ey / s)::BIGINT AS ny, floor(ez / s)::BIGINT AS nz, {r('ex / floor(ex / s)', 'dx')}, {r('ey / floor(ey / s)', 'dy')}, {r('ez / floor(ez / s)', 'dz')} FROM n")
def suggested_blocks(spark, sf_dir):
    return rounded(modelling.suggested_counts(V.samples(spark, sf_dir), 5000))


@query(f"WITH {V.BLOCKS} SELECT class, count(*) AS n FROM (SELECT CASE WHEN grade2 / 40 < 0.05 THEN 'Measured' WHEN grade2 / 40 < 0.15 THEN 'Indicated' ELSE 'Inferred' END AS class FROM blocks) GROUP BY 1")
def variance_classes(spark, sf_dir):
    rows = modelling.variance_classes(V.blocks(spark, sf_dir).withColumn("v", F.col("grade2") / 40), "v")
    return rows.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


_COARSE = "coarse AS (SELECT block_id, x, y, z, 40 + block_id % 3 * 10 AS dx, 50::DOUBLE AS dy, 30::DOUBLE AS dz, (block_id % 11)::DOUBLE AS grade FROM targets)"
_FINE = "fine AS (SELECT id AS target_id, id % 20 * 50::DOUBLE AS x, id // 20 % 14 * 50::DOUBLE AS y, id // 280 * 40::DOUBLE AS z FROM (SELECT unnest(range(1400)) AS id))"


def _coarse(spark, sf_dir):
    key = F.col("block_id")
    coarse = V.targets(spark, sf_dir).select("block_id", "x", "y", "z", (40 + key % 3 * 10).cast("double").alias("dx"), F.lit(50.0).alias("dy"), F.lit(30.0).alias("dz"), (key % 11).cast("double").alias("grade"))
    i = F.col("id")
    return coarse, spark.range(1400).select(i.alias("target_id"), (i % 20 * 50).cast("double").alias("x"), (F.floor(i / 20) % 14 * 50).cast("double").alias("y"), (F.floor(i / 280) * 40).cast("double").alias("z"))


@query(f"WITH {V.TARGETS}, {_COARSE}, {_FINE}, o AS (SELECT target_id, sum(least(10 * 10 * 10, dx * dy * dz) * grade) / sum(least(10 * 10 * 10, dx * dy * dz)) AS g FROM fine f JOIN coarse c ON abs(f.x - c.x) <= (10 + dx) / 2 AND abs(f.y - c.y) <= (10 + dy) / 2 AND abs(f.z - c.z) <= (10 + dz) / 2 GROUP BY 1), m AS (SELECT target_id, avg(grade) AS m FROM fine t JOIN coarse s ON {_DIST} <= 60 GROUP BY 1) SELECT f.target_id, {r('g', 'grade')}, {r('m', 'mean')} FROM fine f LEFT JOIN o USING (target_id) LEFT JOIN m USING (target_id)")
def resampled_blocks(spark, sf_dir):
    coarse, fine = _coarse(spark, sf_dir)
    own = modelling.resampled(coarse, fine, ["grade"], (10.0, 10.0, 10.0))
    mean = modelling.around_mean(fine, coarse, "grade", 60.0, "target_id", "block_id").withColumnRenamed("grade", "mean")
    return rounded(own.join(mean, "target_id"))


@query(f"WITH {V.SAMPLES} SELECT sample_id FROM samples WHERE x / 800 + y / 600 + z / 180 < 1 AND x > 0 AND y > 0 AND z > 0")
def inside_solid(spark, sf_dir):
    o, a, b, c = (0.0, 0.0, 0.0), (800.0, 0.0, 0.0), (0.0, 600.0, 0.0), (0.0, 0.0, 180.0)
    faces = [(o, b, a), (o, a, c), (o, c, b), (a, b, c)]
    names = ", ".join(f"{v}{d} double" for v in "abc" for d in "xyz")
    triangles = spark.createDataFrame([tuple(x for p in f for x in p) for f in faces], names)
    points = V.samples(spark, sf_dir).where("x > 0 and y > 0 and z > 0 and x / 800 + y / 600 + z / 180 != 1")
    return modelling.inside_solid(points, triangles, "sample_id", 200.0).select("sample_id")


_MARKS = "marks AS (SELECT hole_id, min(depth_from) AS depth_from, max(depth_to) AS depth_to, lith_code || '1' AS code FROM intervals GROUP BY hole_id, lith_code)"


@query(f"WITH {V.INTERVALS}, {_MARKS}, d AS (SELECT i.hole_id, i.depth_from, i.grade, m.code, row_number() OVER (PARTITION BY i.hole_id, i.depth_from ORDER BY abs((i.depth_from + i.depth_to) / 2 - (m.depth_from + m.depth_to) / 2), m.depth_from + m.depth_to, m.code) AS k FROM intervals i JOIN marks m USING (hole_id)) SELECT hole_id, depth_from, grade, code FROM d WHERE k = 1 AND hole_id NOT IN (SELECT a.hole_id FROM marks a JOIN marks b ON a.hole_id = b.hole_id AND a.code < b.code AND a.depth_from + a.depth_to = b.depth_from + b.depth_to)")
def nearest_codes(spark, sf_dir):
    rows = V.intervals(spark, sf_dir)
    marks = rows.groupBy("hole_id", "lith_code").agg(F.min("depth_from").alias("depth_from"), F.max("depth_to").alias("depth_to")).withColumn("code", F.concat("lith_code", F.lit("1")))
    found = modelling.nearest_code(rows.select("hole_id", "depth_from", "depth_to", "grade"), marks, "code")
    tied = marks.groupBy("hole_id", (F.col("depth_from") + F.col("depth_to")).alias("m")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hole_id").distinct()
    return found.join(tied, "hole_id", "left_anti").select("hole_id", "depth_from", "grade", "code")


_TRUE = "f AS (SELECT hole_id, depth_from, depth_to, grade, abs(cos(radians(grade * 5)))::DECIMAL(18,6) AS f FROM intervals), d AS (SELECT *, (depth_to::DECIMAL(18,6) - depth_from::DECIMAL(18,6))::DECIMAL(18,6) * f AS dm FROM f), s AS (SELECT *, sum(dm) OVER (PARTITION BY hole_id ORDER BY depth_from, depth_to ROWS UNBOUNDED PRECEDING) AS de FROM d), m AS (SELECT *, de::DOUBLE AS e, (de - dm)::DOUBLE AS st FROM s), b AS (SELECT *, unnest(range(floor(st / 15)::BIGINT, ceil(e / 15)::BIGINT)) AS bin FROM m), c AS (SELECT *, greatest(st, bin * 15) AS a, least(e, (bin + 1) * 15) AS z FROM b)"


@query(f"WITH {V.INTERVALS}, {_TRUE} SELECT hole_id, bin, {r('sum(z - a)', 'thickness', 7)}, {r('sum(grade * (z - a)) / sum(z - a)', 'grade', 7)} FROM c WHERE z > a GROUP BY hole_id, bin")
def true_thickness_composites(spark, sf_dir):
    rows = modelling.true_thickness(V.intervals(spark, sf_dir), ["grade"], 15.0, F.col("grade") * 5)
    return rounded(rows.select("hole_id", "bin", "thickness", "grade"), 7)


@query(f"WITH {V.INTERVALS}, o AS (SELECT *, min(depth_from) OVER (PARTITION BY hole_id) AS o FROM intervals WHERE lith_code <> 'R' AND grade >= 2), b AS (SELECT *, unnest(range(floor((depth_from - o) / 10::DOUBLE)::BIGINT, ceil((depth_to - o) / 10::DOUBLE)::BIGINT)) AS bin FROM o), c AS (SELECT *, greatest(depth_from, o + bin * 10) AS a, least(depth_to, o + (bin + 1) * 10) AS z FROM b) SELECT hole_id, bin, {r('sum(z - a)', 'length')}, {r('sum(density * (z - a)) / sum(z - a)', 'density')} FROM c WHERE z > a GROUP BY ALL")
def filtered_composites(spark, sf_dir):
    rows = modelling.filtered_composites(V.intervals(spark, sf_dir), ["density"], 10.0, F.col("lith_code") == "R", "grade", 2.0)
    return rounded(rows.select("hole_id", "bin", "length", "density"))


@query("WITH c AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN ' ' || lower(c_name) ELSE upper(c_name) END AS h FROM customer) SELECT 'COLLAR_HOLEID_NORMALISED' AS rule_code, h AS old, upper(trim(h)) AS \"new\", 'Normalised hole_id to stripped uppercase.' AS reason, 1::DOUBLE AS confidence FROM c WHERE h <> upper(trim(h))")
def normalised_ids(spark, sf_dir):
    rows = V.table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), F.lower("c_name"))).otherwise(F.upper("c_name")).alias("hole_id"))
    return modelling.normalised_ids(rows)[1]


@query(f"WITH {V.BLOCKS}, k AS (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY grade DESC, block_id) AS k FROM blocks) SELECT block_id, x, y, z, grade FROM k WHERE k = 1")
def most_confident(spark, sf_dir):
    return modelling.most_confident(V.blocks(spark, sf_dir), ["x", "y", "z"], "grade", "block_id").select("block_id", "x", "y", "z", "grade")


@query(f"WITH {V.BLOCKS}, t AS (SELECT CASE WHEN grade >= 9 THEN 'rich' WHEN grade2 >= 8 THEN 'mixed' WHEN domain = 'A' THEN 'oxide' WHEN domain = 'N' THEN 'sulphide' ELSE 'UNKNOWN' END AS ore_type, tonnes FROM blocks) SELECT ore_type, count(*) AS n, {r('sum(tonnes)', 'tonnes')} FROM t GROUP BY 1")
def mapped_types(spark, sf_dir):
    types = spark.createDataFrame([("A", "oxide"), ("N", "sulphide")], "domain string, ore_type string")
    rows = modelling.mapped_types(V.blocks(spark, sf_dir), types, "domain", [(F.col("grade") >= 9, "rich"), (F.col("grade2") >= 8, "mixed")])
    return rounded(rows.groupBy("ore_type").agg(F.count(F.lit(1)).alias("n"), F.sum("tonnes").alias("tonnes")))


@query(f"WITH t AS (SELECT i, j, k, sqrt((i * 10) ** 2 + (j * 10) ** 2 + (k * 5) ** 2) AS d FROM (SELECT unnest(range(-2, 3))::INT AS i), (SELECT unnest(range(-2, 3))::INT AS j), (SELECT unnest(range(-5, 6))::INT AS k)) SELECT i, j, k, {r('d', 'distance')}, row_number() OVER (ORDER BY d, i, j, k) AS rank FROM t WHERE d <= 25")
def search_template(spark, sf_dir):
    return rounded(modelling.search_template(spark, 25.0, (10.0, 10.0, 5.0)))


@query(f"WITH {V.TARGETS}, {V.SAMPLES}, d AS (SELECT block_id, {_DIST} AS d, row_number() OVER (PARTITION BY block_id ORDER BY {_DIST}, sample_id) AS k FROM targets t, samples s), p AS (SELECT max(d) FILTER (k = 1) AS a, max(d) FILTER (k = 3) AS c FROM d WHERE k <= 3 GROUP BY block_id) SELECT {r('quantile_cont(c, 0.2)', 'measured')}, {r('quantile_cont(c, 0.5)', 'indicated')}, {r('quantile_cont(a, 0.9)', 'inferred')} FROM p")
def spacing_thresholds(spark, sf_dir):
    near = spatial.nearest(V.targets(spark, sf_dir), V.samples(spark, sf_dir), 3, None, "block_id", "sample_id")
    rows = near.groupBy("target").agg(F.max(F.when(F.col("rank") == 1, F.col("distance"))).alias("first"), F.max(F.when(F.col("rank") == 3, F.col("distance"))).alias("third"))
    return rounded(modelling.spacing_thresholds(rows, "first", "third"))


@query(f"WITH {V.BLOCKS} SELECT block_id, 1 AS realisation, grade AS value FROM blocks UNION ALL SELECT block_id, 2, grade2 FROM blocks")
def listed_realisations(spark, sf_dir):
    rows = V.blocks(spark, sf_dir).select("block_id", F.col("grade").alias("AU_SIM_001"), F.col("grade2").alias("AU_SIM_002"), "tonnes")
    return modelling.unpivoted(rows, "block_id", r"AU_SIM_(\d+)")


# --- operators that had no query ------------------------------------------------


@query(f"WITH {V.INTERVALS}, b AS (SELECT *, unnest(range(floor((depth_from - 3) / 12::DOUBLE)::BIGINT, ceil((depth_to - 3) / 12::DOUBLE)::BIGINT)) AS bin FROM intervals), c AS (SELECT *, greatest(depth_from, 3 + bin * 12) AS a, least(depth_to, 3 + (bin + 1) * 12) AS z FROM b) SELECT hole_id, bin, {r('sum(z - a)', 'length')}, {r('sum(grade * (z - a)) / sum(z - a)', 'grade')} FROM c WHERE z > a GROUP BY ALL")
def bench_composites(spark, sf_dir):
    return rounded(intervals.bench(V.intervals(spark, sf_dir), ["grade"], 12.0, 3.0).select("hole_id", "bin", "length", "grade"))


@query(f"WITH {V.COLLARS}, c AS (SELECT *, count(*) OVER (PARTITION BY hole_id) AS n FROM (SELECT * FROM collars UNION ALL SELECT * FROM collars WHERE hole_id % 50 = 3)), v AS (SELECT 'DUPLICATE' AS rule_code, 'ERROR' AS severity, hole_id FROM c WHERE n > 1 UNION ALL SELECT 'LOW_ELEVATION', 'WARNING', hole_id FROM c WHERE z < 105) SELECT 'collars' AS table_name, rule_code, severity, count(*) AS n, count(DISTINCT hole_id) AS holes FROM v GROUP BY ALL")
def collar_validation(spark, sf_dir):
    rows = V.collars(spark, sf_dir)
    return validation.summary(validation.collars(rows.unionByName(rows.where("hole_id % 50 = 3")), lowest=105.0))


@query(f"WITH {V.LOGGED}, {V.COLLARS}, p AS (SELECT *, lag(depth_to) OVER (PARTITION BY hole_id ORDER BY depth_from, depth_to) AS prev FROM logged), v AS (SELECT 'LENGTH' AS rule_code, hole_id FROM p WHERE depth_to <= depth_from UNION ALL SELECT 'GAP', hole_id FROM p WHERE depth_from - prev > 0.1 UNION ALL SELECT 'OVERLAP', hole_id FROM p WHERE depth_from < prev UNION ALL SELECT 'BEYOND_TD', p.hole_id FROM p JOIN collars c USING (hole_id) WHERE depth_to > length + 1e-3), g AS (SELECT *, rule_code = 'OVERLAP' OR (rule_code = 'GAP' AND hole_id = 3) OR rule_code = 'GAP' AS ignored FROM v) SELECT rule_code, ignored, count(*) AS n FROM g GROUP BY ALL")
def ignored_violations(spark, sf_dir):
    found = validation.intervals(V.logged(spark, sf_dir), V.collars(spark, sf_dir), "assays").withColumn("hole_id", F.col("hole_id").cast("string"))
    rules = spark.createDataFrame([("OVERLAP", None, "assays"), ("GAP", "3", None)], "rule_code string, hole_id string, table_name string")
    shown, hidden = selection.without_ignored(found, rules, ("WARNING",))
    both = shown.withColumn("ignored", F.lit(False)).unionByName(hidden.withColumn("ignored", F.lit(True)))
    return both.groupBy("rule_code", "ignored").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey AS sample_id, CASE WHEN d IS NULL THEN 'PENDING' WHEN d <= 0.2 THEN 'PASS' WHEN d <= 0.3 THEN 'WARNING' ELSE 'FAIL' END AS status FROM (SELECT a.s_suppkey, abs(a.s_suppkey % 17 + 5 - (b.s_suppkey % 17 + 5)) / ((a.s_suppkey % 17 + 5 + b.s_suppkey % 17 + 5) / 2::DOUBLE) AS d FROM supplier a LEFT JOIN supplier b ON b.s_suppkey = a.s_suppkey - 8 WHERE a.s_suppkey % 3 = 0)")
def duplicate_checks(spark, sf_dir):
    key = F.col("s_suppkey")
    rows = V.table(spark, sf_dir, "supplier").select(key.alias("sample_id"), (key - 8).alias("parent_sample_id"), (key % 17 + 5).cast("double").alias("au"), F.when(key % 3 == 0, "DUP").otherwise("ORIGINAL").alias("qaqc_type"))
    return validation.duplicates_check(rows, "au", 0.2).select("sample_id", "status")


@query("SELECT status FROM (SELECT 'WARN' AS status)")
def validation_verdict(spark, sf_dir):
    return validation.verdict(validation.surveys(V.surveys(spark, sf_dir), V.collars(spark, sf_dir)))


@query("WITH RECURSIVE e AS (SELECT p_partkey + 1 AS child, (p_partkey + 1) // 3 AS parent FROM part), a AS (SELECT child AS node, parent AS ancestor, 1 AS distance FROM e UNION ALL SELECT a.node, e.parent, distance + 1 FROM a JOIN e ON e.child = a.ancestor) SELECT node, ancestor, min(distance) AS distance FROM a GROUP BY ALL")
def lineages(spark, sf_dir):
    key = F.col("p_partkey")
    return survey.lineages(V.table(spark, sf_dir, "part").select((key + 1).alias("child"), F.floor((key + 1) / 3).alias("parent")))


@query(f"WITH {V.SAMPLES}, {_PAIRS.format(d=_DIST, R=60).replace('t.value AS vj', 't.value AS vj, s.z AS zi, t.z AS zj')} SELECT ceil(d / 10)::BIGINT AS lag, {r('avg(d)', 'distance')}, {r('avg((vi - vj) * (zi - zj) / 2)', 'gamma')}, count(*) AS pairs FROM p WHERE d > 0 GROUP BY 1")
def cross_variogram(spark, sf_dir):
    rows = V.samples(spark, sf_dir).withColumn("height", F.col("z"))
    return rounded(variograms.cross(rows, "sample_id", "value", "height", 6, 10.0))


@query(f"WITH {V.SAMPLES}, c AS (SELECT hole, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM samples GROUP BY 1), d AS (SELECT s.hole, {_DIST} AS d, row_number() OVER (PARTITION BY s.hole ORDER BY {_DIST}, t.hole) AS k FROM c s JOIN c t ON s.hole <> t.hole) SELECT count(*) AS holes, {r('avg(d)', 'spacing')} FROM d WHERE k = 3")
def hole_spacing(spark, sf_dir):
    return rounded(spatial.hole_spacing(V.samples(spark, sf_dir), "hole", 3, 20.0))


@query(f"WITH {V.TARGETS}, {V.SAMPLES}, n AS (SELECT block_id, sum(value / ({_DIST} + 1e-6) ** 2) AS v FROM targets t JOIN samples s ON {_DIST} <= 60 GROUP BY 1) SELECT t.block_id, {r('coalesce(v / (SELECT max(v) FROM n), 0)', 'hazard', 8)} FROM targets t LEFT JOIN n USING (block_id)")
def hazard_volume(spark, sf_dir):
    return rounded(spatial.kernel_sum(V.targets(spark, sf_dir), V.samples(spark, sf_dir), 60.0, "block_id", "sample_id", "value"), 8)


@query("WITH i AS (SELECT unnest(range(60)) AS id) SELECT id AS block_id, 100 + (id % 5 + 0.5::DOUBLE) * 10 AS x, 200 + (id // 5 % 4 + 0.5::DOUBLE) * 20 AS y, (id // 20 + 0.5::DOUBLE) * 5 AS z FROM i")
def generated_grid(spark, sf_dir):
    return spatial.grid(spark, (5, 4, 3), (10.0, 20.0, 5.0), (100.0, 200.0, 0.0))


@query(f"WITH {V.SAMPLES} SELECT hole, {r('max(abs(value - 45))', 'greatest')}, CASE WHEN max(abs(value - 45)) <= 24 THEN 'Stable' WHEN max(abs(value - 45)) <= 48 THEN 'Suspect' ELSE 'Failed' END AS status FROM samples GROUP BY hole")
def control_stability(spark, sf_dir):
    return rounded(timeseries.stability(V.samples(spark, sf_dir).withColumn("change", F.col("value") - 45), "hole", "change", 8.0))


@query("WITH a AS (SELECT user_id, ts::DATE AS d, value FROM events WHERE event_type = 'click'), b AS (SELECT user_id % 7 AS w, ts::DATE AS d, avg(value) AS v FROM events GROUP BY ALL) SELECT a.user_id, w AS well, " + r("corr(a.value, b.v)", "r") + ", count(*) AS n FROM a JOIN b ON b.w = a.user_id % 7 AND b.d = a.d GROUP BY ALL HAVING count(*) > 2")
def coupled_series(spark, sf_dir):
    events = V.table(spark, sf_dir, "events")
    levels = events.where("event_type = 'click'").select("user_id", "ts", F.col("value").alias("change_mm"))
    wells = events.groupBy((F.col("user_id") % 7).alias("well"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("water_level")).select("well", F.col("day").alias("ts"), "water_level")
    links = events.select("user_id", (F.col("user_id") % 7).alias("well")).distinct()
    return rounded(timeseries.coupled(levels, wells, "user_id", "well", links).where("n > 2").select("user_id", "well", "r", "n"))


@query(f"WITH {V.SAMPLES}, m AS (SELECT hole, max(value) AS a, avg(z) AS b FROM samples GROUP BY 1), i AS (SELECT hole, 0.7 * (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) + 0.3 * (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) AS i FROM m) SELECT hole, {r('i', 'index')}, row_number() OVER (ORDER BY round(i, 10) DESC, hole) AS rank FROM i")
def deformation_index(spark, sf_dir):
    metrics = V.samples(spark, sf_dir).groupBy("hole").agg(F.max("value").alias("a"), F.avg("z").alias("b"))
    return rounded(timeseries.deformation_index(metrics, "hole", {"a": 0.7, "b": 0.3}))


@query(f"WITH {V.BLOCKS}, p AS (SELECT period, sum(tonnes) AS t FROM blocks GROUP BY 1) SELECT period, {r('t * 2.5', 'waste')}, {r('t * 2.5 / 2.2', 'volume')}, {r('t * 2.5 * 0.3', 'acid_forming')}, {r('t * 2.5 * 0.7', 'benign')}, {r('sum(t * 0.4 - coalesce(CASE WHEN period % 2 = 0 THEN t * 0.3 END, 0)) OVER (ORDER BY period)', 'void')} FROM p")
def waste_and_voids(spark, sf_dir):
    per = V.blocks(spark, sf_dir).groupBy("period").agg(F.sum("tonnes").alias("ore"))
    waste = processes.waste_rock(per, 2.5, 2.2, 0.3)
    void = processes.void_series(per.select("period", (F.col("ore") * 0.4).alias("volume")), per.where("period % 2 = 0").select("period", (F.col("ore") * 0.3).alias("volume")))
    return rounded(waste.join(void.select("period", "void"), "period"))


@query(f"WITH {_SHELLS}, d AS (SELECT shell::BIGINT AS id, unnest(range(1, 9))::INT AS period, tonnes FROM shells) SELECT id, period, {r('least(9000, tonnes - (period - 1) * 9000)', 'drawn')} FROM d WHERE tonnes > (period - 1) * 9000")
def cave_draw(spark, sf_dir):
    return rounded(processes.cave_draw(_shells(spark, sf_dir).select(F.col("shell").alias("id"), "tonnes"), 8, 9000.0))


@query(f"WITH {V.BLOCKS}, p AS (SELECT period, sum(tonnes) AS t FROM blocks GROUP BY 1) SELECT period, unnest(range(1, 4))::INT AS shift, truck, {r('t / 6', 'tonnes')} FROM (SELECT period, t, unnest([1, 2])::INT AS truck FROM p)")
def shift_plan(spark, sf_dir):
    per = V.blocks(spark, sf_dir).groupBy("period").agg(F.sum("tonnes").alias("tonnes"))
    return rounded(processes.shifts(per, 3, 2))


@query(f"WITH {_SHELLS}, k AS (SELECT shell::BIGINT AS shell, tonnes AS depth, row_number() OVER (ORDER BY tonnes, shell) AS k, count(*) OVER () AS n FROM shells) SELECT shell, {r('depth', 'depth')}, (floor((k * 4 - 1) / n::DOUBLE) + 1)::INT AS pushback FROM k")
def pushbacks_by_depth(spark, sf_dir):
    shells = _shells(spark, sf_dir).select("shell", F.col("tonnes").alias("depth"))
    return rounded(processes.pushbacks_by_depth(shells, 4))


@query(f"WITH {V.BLOCKS}, c AS (SELECT grade AS cutoff, sum(tonnes) AS t FROM blocks GROUP BY 1) SELECT arg_max(cutoff, t * cutoff) AS cutoff, {r('max(t * cutoff)', 'worth')} FROM c")
def best_cutoff(spark, sf_dir):
    curve = V.blocks(spark, sf_dir).groupBy(F.col("grade").alias("cutoff")).agg((F.sum("tonnes") * F.first("grade")).alias("worth"))
    return rounded(money.best_cutoff(curve, "worth"))


@query(f"WITH {V.BLOCKS}, m AS (SELECT period::VARCHAR AS period, 'au' AS element, sum(tonnes * grade) / sum(tonnes) AS grade FROM blocks GROUP BY 1 UNION ALL SELECT period::VARCHAR, 'cu', sum(tonnes * grade2) / sum(tonnes) FROM blocks GROUP BY 1) SELECT period, element, {r('grade', 'grade')}, {r('grade * CASE WHEN element = $$au$$ AND period = $$4$$ THEN 0.9 WHEN element = $$au$$ THEN 0.85 ELSE 1 END', 'recovered_grade')} FROM m")
def recovered_grades(spark, sf_dir):
    rows = V.blocks(spark, sf_dir).groupBy(F.col("period").cast("string").alias("period")).agg((F.sum(F.col("tonnes") * F.col("grade")) / F.sum("tonnes")).alias("au"), (F.sum(F.col("tonnes") * F.col("grade2")) / F.sum("tonnes")).alias("cu"))
    mined = rows.select("period", F.lit("au").alias("element"), F.col("au").alias("grade")).unionByName(rows.select("period", F.lit("cu").alias("element"), F.col("cu").alias("grade")))
    recovery = spark.createDataFrame([("4", "au", 0.9), ("all", "au", 0.85)], "period string, element string, recovery double")
    return rounded(money.recovered(mined, recovery).select("period", "element", "grade", "recovered_grade"))


@query(f"WITH {V.BLOCKS}, a AS (SELECT period, domain, sum(tonnes) AS t FROM blocks GROUP BY ALL) SELECT period, {r('sum(t * CASE domain WHEN $$A$$ THEN 2.7 WHEN $$N$$ THEN 0.5 ELSE 0 END)', 'co2e')} FROM a GROUP BY 1")
def emissions(spark, sf_dir):
    rows = V.blocks(spark, sf_dir).groupBy("period", F.col("domain").alias("kind")).agg(F.sum("tonnes").alias("amount"))
    factors = spark.createDataFrame([("A", 2.7), ("N", 0.5)], "kind string, factor double")
    return rounded(money.emissions(rows, factors))


@query(f"WITH {_PLANES}, v AS (SELECT -sin(radians(dip)) * sin(radians(dd)) AS x, -sin(radians(dip)) * cos(radians(dd)) AS y, -cos(radians(dip)) AS z FROM planes), g AS (SELECT dip * 1000 + dd AS id, -sin(radians(dip)) * sin(radians(dd)) AS x, -sin(radians(dip)) * cos(radians(dd)) AS y, -cos(radians(dip)) AS z FROM (SELECT unnest(range(0, 90, 30)) AS dip), (SELECT unnest(range(0, 360, 60)) AS dd)) SELECT id::BIGINT AS id, {r('avg(20 / (4 * pi() * sinh(20::DOUBLE)) * exp(20 * abs(v.x * g.x + v.y * g.y + v.z * g.z)))', 'density')} FROM v, g GROUP BY id")
def pole_density(spark, sf_dir):
    dip, dd = F.col("dip").cast("double"), F.col("dd").cast("double")
    rows = _planes(spark, sf_dir)
    poles = rows.select(*(c.alias(n) for c, n in zip(geometry.pole(F.col("dip"), F.col("dd")), "xyz")))
    net = spark.range(0, 90, 30).select(F.col("id").alias("dip")).crossJoin(spark.range(0, 360, 60).select(F.col("id").alias("dd")))
    grid = net.select((F.col("dip") * 1000 + F.col("dd")).alias("id"), *(c.alias(f"g{n}") for c, n in zip(geometry.pole(dip, dd), "xyz")))
    return rounded(structural.density(poles, grid, 20.0))


@query("WITH p AS (SELECT p_partkey % 40 AS id, radians(40 + avg(p_partkey * 7 % 45)) AS d, radians(avg(p_partkey % 40 * 37 % 360 + p_partkey % 7)) AS a FROM part GROUP BY 1), n AS (SELECT id, -sin(d) * sin(a) AS x, -sin(d) * cos(a) AS y, -cos(d) AS z FROM p), c AS (SELECT a.id AS i, b.id AS j, a.y * b.z - a.z * b.y AS x, a.z * b.x - a.x * b.z AS y, a.x * b.y - a.y * b.x AS z FROM n a JOIN n b ON a.id < b.id), l AS (SELECT *, CASE WHEN z > 0 THEN -1 ELSE 1 END AS f, sqrt(x * x + y * y + z * z) AS l FROM c WHERE x * x + y * y + z * z > 1e-12), t AS (SELECT i, j, degrees(asin(least(abs(z) / l, 1))) AS plunge, (degrees(atan2(f * x, f * y)) + 360) % 360 AS trend FROM l) SELECT i, j, " + r("plunge", "plunge") + ", " + r("trend", "trend", 3) + ", cos(radians(trend - 120)) > 0 AND plunge > 30 AND plunge < degrees(atan(tan(radians(65::DOUBLE)) * cos(radians(trend - 120)))) AS feasible FROM t")
def wedges(spark, sf_dir):
    key = F.col("p_partkey")
    sets = V.table(spark, sf_dir, "part").groupBy((key % 40).alias("id")).agg((40 + F.avg(key * 7 % 45)).alias("dip"), F.avg(key % 40 * 37 % 360 + key % 7).alias("dip_direction"))  # the means of forty sets
    return rounded(structural.wedges(sets, "id", 65.0, 120.0, 30.0).withColumn("trend", F.round("trend", 3)))


@query(f"WITH {V.INTERVALS}, k AS (SELECT hole_id, depth_to AS depth, CASE lith_code WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 END AS rank FROM intervals), n AS (SELECT hole_id, lead(rank) OVER (PARTITION BY hole_id ORDER BY depth) < rank AS i FROM k), s AS (SELECT hole_id, count(*) FILTER (i) AS inversions FROM n GROUP BY 1) SELECT hole_id, inversions, CASE WHEN inversions > 1 THEN 'ERROR' WHEN inversions > 0 THEN 'WARNING' ELSE 'OK' END AS severity FROM s")
def stratigraphy_order(spark, sf_dir):
    contacts = V.intervals(spark, sf_dir).select("hole_id", F.col("depth_to").alias("depth"), F.col("lith_code").alias("unit"))
    ranks = spark.createDataFrame([("A", 1), ("N", 2), ("R", 3)], "unit string, rank int")
    return structural.stratigraphy(contacts, ranks, 1)


# --- kriging of few neighbours, whose systems have closed solutions --------------

_MODEL = {"model": "spherical", "nugget": 20.0, "sill": 200.0, "range": 150.0}


def _cov(h: str, nugget: float = 20.0, sill: float = 200.0, reach: float = 150.0) -> str:
    return f"(CASE WHEN {h} <= 1e-12 THEN {nugget + sill}::DOUBLE WHEN {h} < {reach} THEN {sill} * (1 - 1.5 * ({h} / {reach}::DOUBLE) + 0.5 * ({h} / {reach}::DOUBLE) ** 3) ELSE 0 END)"


def _between(a: str, b: str) -> str:
    return f"sqrt(({a}.x - {b}.x) ** 2 + ({a}.y - {b}.y) ** 2 + ({a}.z - {b}.z) ** 2)"


_NEAR = f"near AS (SELECT block_id, s.x, s.y, s.z, value, {_DIST} AS d, row_number() OVER (PARTITION BY block_id ORDER BY {_DIST}, sample_id) AS k FROM targets t, samples s)"
_TWO = f"two AS (SELECT a.block_id, a.value AS v1, b.value AS v2, {_cov('a.d')} AS c1, {_cov('b.d')} AS c2, {_cov(_between('a', 'b'))} AS c12, 220 * (1 + 1e-10) AS c0 FROM near a JOIN near b ON a.block_id = b.block_id AND a.k = 1 AND b.k = 2), w AS (SELECT *, 0.5 + (c1 - c2) / (2 * (c0 - c12)) AS w1 FROM two), o AS (SELECT *, 1 - w1 AS w2, c1 - c0 * w1 - c12 * (1 - w1) AS mu FROM w)"


@query(f"WITH {V.TARGETS}, {V.SAMPLES}, {_NEAR}, three AS (SELECT a.block_id, a.value AS v1, b.value AS v2, c.value AS v3, {_cov('a.d')} AS r1, {_cov('b.d')} AS r2, {_cov('c.d')} AS r3, {_cov(_between('a', 'b'))} AS p, {_cov(_between('a', 'c'))} AS q, {_cov(_between('b', 'c'))} AS s, 220 * (1 + 1e-10) AS o FROM near a JOIN near b ON a.block_id = b.block_id AND b.k = 2 JOIN near c ON a.block_id = c.block_id AND c.k = 3 WHERE a.k = 1), d AS (SELECT *, o * (o * o - s * s) - p * (p * o - s * q) + q * (p * s - o * q) AS det FROM three), w AS (SELECT *, (r1 * (o * o - s * s) - p * (r2 * o - s * r3) + q * (r2 * s - o * r3)) / det AS w1, (o * (r2 * o - s * r3) - r1 * (p * o - s * q) + q * (p * r3 - r2 * q)) / det AS w2, (o * (o * r3 - r2 * s) - p * (p * r3 - r2 * q) + r1 * (p * s - o * q)) / det AS w3 FROM d) SELECT block_id, {r('50 + w1 * (v1 - 50) + w2 * (v2 - 50) + w3 * (v3 - 50)', 'estimate', 3)}, {r('greatest(220 - w1 * r1 - w2 * r2 - w3 * r3, 0)', 'variance', 3)}, 3 AS n FROM w")
def simple_kriging_of_three(spark, sf_dir):
    return rounded(kriging.krige(V.targets(spark, sf_dir), V.samples(spark, sf_dir), "value", _MODEL, 3, kind="simple", mean=50.0), 3)


@query(f"WITH {V.TARGETS}, {V.SAMPLES}, {_NEAR}, {_TWO} SELECT block_id, {r('w1 * v1 + w2 * v2', 'estimate')}, {r('greatest(220 - w1 * c1 - w2 * c2 - mu, 0)', 'variance')}, 2 AS n FROM o")
def ordinary_kriging_of_two(spark, sf_dir):
    return rounded(kriging.krige(V.targets(spark, sf_dir), V.samples(spark, sf_dir), "value", _MODEL, 2, least=2))


@query(f"WITH {V.TARGETS}, {V.SAMPLES}, {_NEAR}, {_TWO}, p AS (SELECT block_id, least(greatest(w1 * (v1 <= 25)::INT + w2 * (v2 <= 25)::INT, 0), 1) AS a, least(greatest(w1 * (v1 <= 45)::INT + w2 * (v2 <= 45)::INT, 0), 1) AS b, least(greatest(w1 * (v1 <= 65)::INT + w2 * (v2 <= 65)::INT, 0), 1) AS c FROM o), f AS (SELECT block_id, (a + least(a, b, c)) / 2 AS a, (greatest(a, b) + least(b, c)) / 2 AS b, (greatest(a, b, c) + c) / 2 AS c FROM p) SELECT block_id, {r('a', 'p0')}, {r('b', 'p1')}, {r('c', 'p2')}, {r('a * 25 + (b - a) * 35 + (c - b) * 55 + (1 - c) * 65', 'mean')} FROM f")
def indicator_kriging_of_two(spark, sf_dir):
    return rounded(kriging.indicator_kriging(V.targets(spark, sf_dir), V.samples(spark, sf_dir), "value", [25.0, 45.0, 65.0], _MODEL, k=2, least=2))


_OTHERS = f"near AS (SELECT t.sample_id AS block_id, s.x, s.y, s.z, s.value, {_DIST} AS d, row_number() OVER (PARTITION BY t.sample_id ORDER BY {_DIST}, s.sample_id) AS k FROM samples t, samples s WHERE s.sample_id <> t.sample_id)"


@query(f"WITH {V.SAMPLES}, {_OTHERS}, {_TWO} SELECT block_id AS sample_id, {r('w1 * v1 + w2 * v2', 'estimate')}, {r('greatest(220 - w1 * c1 - w2 * c2 - mu, 0)', 'variance')}, 2 AS n, value AS actual FROM o JOIN samples ON sample_id = block_id")
def cross_validation_of_two(spark, sf_dir):
    return rounded(kriging.cross_validated(V.samples(spark, sf_dir), "value", _MODEL, k=2, least=2))


# --- SQL of queries registered without it ----------------------------------------

ORACLE_SQL["normal_scores"] = f"WITH {V.SAMPLES}, {_SCORES} SELECT sample_id, {r('g', 'normal_score')} FROM sc"
ORACLE_SQL["bootstrap_grades"] = f"WITH {V.SAMPLES}, {_RESAMPLED.replace('range(1, 41)', 'range(1, 101)')}, m AS (SELECT iteration, sum(n * value) / sum(n) AS m FROM d GROUP BY 1) SELECT {r('avg(m)', 'mean')}, {r('stddev_samp(m)', 'std')}, {r('quantile_cont(m, 0.05)', 'low')}, {r('quantile_cont(m, 0.95)', 'high')} FROM m"
ORACLE_SQL["gaussian_fields"] = f"WITH o AS (SELECT unnest({[b[0] for b in _BALL]}) AS i, unnest({[b[1] for b in _BALL]}) AS j, unnest({[b[2] for b in _BALL]}) AS k), n AS (SELECT id // 400 AS realisation, id % 400 AS block_id, id % 400 % 10 AS x, id % 400 // 10 % 10 AS y, id % 400 // 100 AS z FROM (SELECT unnest(range(3200)) AS id)), s AS (SELECT realisation, block_id, sum({_normal(1, 'realisation', 'x + i', 'y + j', 'z + k')}) * sqrt(0.9::DOUBLE / {len(_BALL)}) AS v FROM n, o GROUP BY ALL), f AS (SELECT block_id, v + {_normal(2, 'realisation', 'block_id')} * sqrt(0.1::DOUBLE) AS v FROM s) SELECT block_id, count(*) AS n, {r('avg(v)', 'mean')}, {r('stddev_pop(v)', 'std')}, {r('min(v)', 'min')}, {r('max(v)', 'max')}, {r('quantile_cont(v, 0.1)', 'p10')}, {r('quantile_cont(v, 0.5)', 'p50')}, {r('quantile_cont(v, 0.9)', 'p90')}, {r('stddev_pop(v) / avg(v)', 'cv')} FROM f GROUP BY block_id"
_WORTH = "list_sum(list_transform(f, lambda v, i: v * pow(1 + {r}, -(i - 1))))"
ORACLE_SQL["rates_of_return"] = f"WITH RECURSIVE {V.BLOCKS}, p AS (SELECT domain, period, sum(CASE WHEN period <= 3 THEN -value ELSE value / 2 END) AS v FROM blocks GROUP BY ALL), l AS (SELECT domain, list(v ORDER BY period) AS f FROM p GROUP BY 1), b AS (SELECT domain, f, 0 AS step, -0.9::DOUBLE AS a, 10::DOUBLE AS z FROM l UNION ALL SELECT domain, f, step + 1, CASE WHEN sign({_WORTH.format(r='(a + z) / 2')}) = sign({_WORTH.format(r='-0.9::DOUBLE')}) THEN (a + z) / 2 ELSE a END, CASE WHEN sign({_WORTH.format(r='(a + z) / 2')}) = sign({_WORTH.format(r='-0.9::DOUBLE')}) THEN z ELSE (a + z) / 2 END FROM b WHERE step < 60), c AS (SELECT domain, count(*) FILTER (sign(v) <> sign(pv))::INT AS sign_changes FROM (SELECT domain, v, lag(v) OVER (PARTITION BY domain ORDER BY period) AS pv FROM p WHERE abs(v) > 1e-9) GROUP BY 1) SELECT domain, {r('CASE WHEN sign(' + _WORTH.format(r='-0.9::DOUBLE') + ') <> sign(' + _WORTH.format(r='10::DOUBLE') + ') THEN (a + z) / 2 END', 'irr')}, sign_changes, {r(_WORTH.format(r='0.1::DOUBLE'), 'npv10')} FROM b JOIN c USING (domain) WHERE step = 60"
_STATIONS = f"""one AS (SELECT hole_id, depth, min({{'a': azimuth, 'd': dip}}) AS s FROM surveys GROUP BY 1, 2), st AS (SELECT hole_id, depth, s.a AS azimuth, s.d AS dip FROM one UNION ALL SELECT hole_id, 0, arg_min(s.a, depth), arg_min(s.d, depth) FROM one GROUP BY hole_id HAVING min(depth) > 0),
 u AS (SELECT *, cos(radians(dip)) * sin(radians(azimuth)) AS ux, cos(radians(dip)) * cos(radians(azimuth)) AS uy, sin(radians(dip)) AS uz FROM st),
 l AS (SELECT *, lag(ux) OVER w AS px, lag(uy) OVER w AS py, lag(uz) OVER w AS pz, depth - lag(depth) OVER w AS step FROM u WINDOW w AS (PARTITION BY hole_id ORDER BY depth)),
 b AS (SELECT *, acos(least(greatest(ux * px + uy * py + uz * pz, -1), 1)) AS bend FROM l), f AS (SELECT *, CASE WHEN bend > 1e-6 THEN 2 / bend * tan(bend / 2) ELSE 1 END AS rf FROM b),
 stations AS (SELECT f.hole_id, depth, x + sum(coalesce(step / 2 * (ux + px) * rf, 0)) OVER w2 AS x, y + sum(coalesce(step / 2 * (uy + py) * rf, 0)) OVER w2 AS y, z + sum(coalesce(step / 2 * (uz + pz) * rf, 0)) OVER w2 AS z FROM f JOIN collars USING (hole_id) WINDOW w2 AS (PARTITION BY f.hole_id ORDER BY depth ROWS UNBOUNDED PRECEDING))"""
_AT = "CASE WHEN a.{c} IS NOT NULL AND b.{c} IS NOT NULL AND b.depth > a.depth THEN a.{c} + (m - a.depth) / (b.depth - a.depth) * (b.{c} - a.{c}) ELSE coalesce(a.{c}, b.{c}, {d}) END"
ORACLE_SQL["located_intervals"] = f"WITH {V.SURVEYS}, {V.COLLARS}, {_STATIONS}, i AS (SELECT hole_id, depth_from, (depth_from + depth_to) / 2 AS m FROM intervals), lo AS (SELECT i.hole_id, i.depth_from, i.m, s.depth, s.x, s.y, s.z FROM i ASOF LEFT JOIN stations s ON i.hole_id = s.hole_id AND i.m >= s.depth), up AS (SELECT i.hole_id, i.depth_from, s.depth, s.x, s.y, s.z FROM i ASOF LEFT JOIN stations s ON i.hole_id = s.hole_id AND i.m < s.depth) SELECT a.hole_id, a.depth_from, {r(_AT.format(c='x', d='c.x'), 'x', 3)}, {r(_AT.format(c='y', d='c.y'), 'y', 3)}, {r(_AT.format(c='z', d='c.z - m'), 'z', 3)} FROM lo a JOIN up b USING (hole_id, depth_from) LEFT JOIN collars c USING (hole_id)"
ORACLE_SQL["interval_repair"] = f"WITH RECURSIVE {V.LOGGED}, {V.COLLARS}, k AS (SELECT l.*, c.length AS td, row_number() OVER (PARTITION BY l.hole_id ORDER BY depth_from, depth_to, grade, density, lith_code) AS k FROM logged l LEFT JOIN collars c USING (hole_id)), f AS (SELECT hole_id, k, grade, depth_from AS s, least(CASE WHEN depth_to <= depth_from THEN depth_from + 0.01::DOUBLE ELSE depth_to END, CASE WHEN td IS NULL THEN 1e300 ELSE greatest(td, depth_from) END) AS e FROM k WHERE k = 1 UNION ALL SELECT hole_id, k, grade, s, least(CASE WHEN depth_to <= s THEN s + 0.01::DOUBLE ELSE depth_to END, CASE WHEN td IS NULL THEN 1e300 ELSE greatest(td, s) END) AS e FROM (SELECT k.*, CASE WHEN k.depth_from - f.e <= 0.1::DOUBLE THEN f.e ELSE k.depth_from END AS s FROM f JOIN k ON k.hole_id = f.hole_id AND k.k = f.k + 1)) SELECT hole_id, {r('s', 'depth_from')}, {r('e', 'depth_to')}, {r('grade', 'grade')} FROM f"
ORACLE_SQL["survey_repair"] = f"WITH {V.SURVEYS}, s AS (SELECT hole_id, depth, (azimuth % 360 + 360) % 360 AS azimuth, least(greatest(dip, -90), 90) AS dip FROM surveys), g AS (SELECT *, lead(depth) OVER w - depth AS gap, ((lead(azimuth) OVER w - azimuth + 180) % 360 + 360) % 360 - 180 AS turn, lead(dip) OVER w - dip AS fall FROM s WINDOW w AS (PARTITION BY hole_id ORDER BY depth)), n AS (SELECT *, greatest(coalesce(ceil(gap / 15::DOUBLE), 1), 1)::BIGINT AS n FROM g), k AS (SELECT *, unnest(range(n)) AS k FROM n) SELECT hole_id, {r('CASE WHEN k = 0 THEN depth ELSE depth + k / n::DOUBLE * gap END', 'depth')}, {r('CASE WHEN k = 0 THEN azimuth ELSE ((azimuth + k / n::DOUBLE * turn) % 360 + 360) % 360 END', 'azimuth')}, {r('CASE WHEN k = 0 THEN dip ELSE dip + k / n::DOUBLE * fall END', 'dip')}, k > 0 AS inserted FROM k"
ORACLE_SQL["density_clusters"] = f"WITH RECURSIVE {V.SAMPLES}, near AS (SELECT t.sample_id AS a, s.sample_id AS b FROM samples t JOIN samples s ON {_DIST} <= 25), core AS (SELECT a AS c FROM near GROUP BY 1 HAVING count(*) >= 4), e AS (SELECT a, b FROM near WHERE a IN (SELECT c FROM core) AND b IN (SELECT c FROM core)), reached AS (SELECT a, b FROM e UNION SELECT reached.a, e.b FROM reached JOIN e ON e.a = reached.b), own AS (SELECT a, min(b) AS k FROM reached GROUP BY 1), border AS (SELECT b, arg_min(k, n.a) AS k FROM near n JOIN own USING (a) GROUP BY 1) SELECT sample_id, coalesce(own.k, border.k, -1) AS cluster FROM samples LEFT JOIN own ON own.a = sample_id LEFT JOIN border ON border.b = sample_id"
ORACLE_SQL["economic_composites"] = f"WITH {V.INTERVALS}, o AS (SELECT *, (grade >= 5)::INT AS ore FROM intervals), s AS (SELECT *, CASE WHEN lag(ore) OVER w = ore AND depth_from - lag(depth_to) OVER w < 1e-3 THEN 0 ELSE 1 END AS s FROM o WINDOW w AS (PARTITION BY hole_id ORDER BY depth_from, depth_to)), i AS (SELECT *, sum(s) OVER (PARTITION BY hole_id ORDER BY depth_from, depth_to ROWS UNBOUNDED PRECEDING) AS i FROM s), g AS (SELECT hole_id, i, any_value(ore) AS ore, min(depth_from) AS a, max(depth_to) AS b, sum(depth_to - depth_from) AS l, sum(grade * (depth_to - depth_from)) AS m FROM i GROUP BY ALL), n AS (SELECT *, ore = 1 OR coalesce(l <= 20 AND (lag(m) OVER w + m + lead(m) OVER w) / (lag(l) OVER w + l + lead(l) OVER w) >= 5, false) AS inn FROM g WINDOW w AS (PARTITION BY hole_id ORDER BY a)), u AS (SELECT *, sum((NOT inn)::INT) OVER (PARTITION BY hole_id ORDER BY a ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM n) SELECT hole_id, run, {r('min(a)', 'depth_from')}, {r('max(b)', 'depth_to')}, {r('sum(l)', 'length')}, {r('sum(m) / sum(l)', 'grade')}, {r('sum(CASE WHEN ore = 0 THEN l ELSE 0 END)', 'waste_length')} FROM u WHERE inn GROUP BY hole_id, run HAVING sum(l) >= 5"

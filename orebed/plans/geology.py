"""Queries of fields, orientations, contacts, octrees, patterns, development and risk, each with the same in SQL for DuckDB; they register beside those of :mod:`queries`."""

from __future__ import annotations

import math
from itertools import combinations


from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import economics, fields, octree, patterns, planes, planning, reporting, structural, validation, variograms
from . import tables as V
from .queries import _DIST, _PAIRS, query, r, rounded
from .workflows import _DRAWS, _draws, _u


def _plain(df):
    """Without negative zeros, which a round leaves."""
    return df.select(*(F.col(c) + 0.0 if t == "double" else F.col(c) for c, t in df.dtypes)).toDF(*df.columns)


# --- random fields ------------------------------------------------------------------

_MODEL, _BANDS, _MEAN = {"model": "spherical", "nugget": 0.0, "sill": 200.0, "range": 200.0}, 16, 50.0


def _bands(table: str, key: str) -> str:
    """SQL of two realisations of turning bands of range 200 at a table's places."""
    return f"""{table}_b AS (SELECT a.{key}, k AS realisation, b, (a.y / 200) * sqrt(1 - z1 * z1) * cos(b * {fields.GOLDEN}::DOUBLE) + (a.x / 200) * sqrt(1 - z1 * z1) * sin(b * {fields.GOLDEN}::DOUBLE) + (a.z / 200) * z1 - {_u(1, 'k', 'b')} AS u FROM {table} a, range(2) t(k), (SELECT b, 1 - (b + 0.5::DOUBLE) / {_BANDS} AS z1 FROM range({_BANDS}) t(b))),
 {table}_f AS (SELECT {key}, realisation, sum(sqrt(12::DOUBLE) * CASE WHEN {_u(2, 'realisation', 'b', 'floor(u)::BIGINT')} < 0.5 THEN -1 ELSE 1 END * (u - floor(u) - 0.5::DOUBLE)) * sqrt(200 / {_BANDS}::DOUBLE) AS value FROM {table}_b GROUP BY ALL)"""


@query(f"WITH {V.TARGETS}, {_bands('targets', 'block_id')} SELECT realisation::INT AS realisation, block_id, {r('value', 'value')} FROM targets_f")
def turning_bands_fields(spark, sf_dir):
    return rounded(fields.turning_bands(V.targets(spark, sf_dir), "block_id", _MODEL, 2, _BANDS))


_NEAR = "sqrt((t.y / 200 - s.y / 200) * (t.y / 200 - s.y / 200) + (t.x / 200 - s.x / 200) * (t.x / 200 - s.x / 200) + (t.z / 200 - s.z / 200) * (t.z / 200 - s.z / 200))"
_COV = "CASE WHEN {h} < 1 THEN 200 * (1 - 1.5::DOUBLE * {h} + 0.5::DOUBLE * pow({h}, 3)) ELSE 0 END"


@query(
    f"""WITH {V.TARGETS}, {V.SAMPLES}, {_bands('targets', 'block_id')}, {_bands('samples', 'sample_id')},
 n AS (SELECT block_id, sample_id, {_NEAR} AS h, row_number() OVER (PARTITION BY block_id ORDER BY {_NEAR}, sample_id) AS k FROM targets t, samples s QUALIFY k <= 2),
 w AS (SELECT a.block_id, a.sample_id AS one, b.sample_id AS two, {_COV.format(h='a.h')} AS c1, {_COV.format(h='b.h')} AS c2, {_COV.format(h=_NEAR)} AS c12 FROM n a JOIN n b ON a.block_id = b.block_id AND a.k = 1 AND b.k = 2 JOIN samples t ON t.sample_id = a.sample_id JOIN samples s ON s.sample_id = b.sample_id),
 e AS (SELECT f.sample_id, realisation, s.value - {_MEAN} - f.value AS e FROM samples_f f JOIN samples s USING (sample_id)),
 c AS (SELECT block_id, one, two, (200 * (1 + 1e-10) * c1 - c12 * c2) / (pow(200 * (1 + 1e-10), 2) - c12 * c12) AS w1, (200 * (1 + 1e-10) * c2 - c12 * c1) / (pow(200 * (1 + 1e-10), 2) - c12 * c12) AS w2 FROM w)
 SELECT f.realisation::INT AS realisation, f.block_id, {r(f'f.value + {_MEAN} + w1 * a.e + w2 * b.e', 'value')} FROM targets_f f JOIN c USING (block_id) JOIN e a ON a.sample_id = one AND a.realisation = f.realisation JOIN e b ON b.sample_id = two AND b.realisation = f.realisation"""
)
def conditioned_turning_bands(spark, sf_dir):
    return rounded(fields.conditioned_turning_bands(V.targets(spark, sf_dir), V.samples(spark, sf_dir), "value", _MODEL, _MEAN, 2, _BANDS, k=2))


@query()
def fourier_simulation(spark, sf_dir):
    """Two realisations over the samples' box that meet the samples."""
    model = {"model": "spherical", "nugget": 20.0, "sill": 180.0, "range": 150.0}
    return rounded(fields.conditioned_fourier(spark, V.samples(spark, sf_dir), "value", (20, 14, 5), (50.0, 50.0, 45.0), (0.0, 0.0, 0.0), model, _MEAN, 2, k=8))


# --- nested variograms --------------------------------------------------------------


def _nested_sql(tries: int) -> str:
    """SQL of the same grid of ranges: all sets of nugget and two structures that come out positive, by Cramer's rule."""
    det = {1: lambda m: m[0][0], 2: lambda m: f"({m[0][0]} * {m[1][1]} - {m[0][1]} * {m[1][0]})"}
    det[3] = lambda m: "(" + " + ".join(f"{m[0][i]} * ({m[1][(i + 1) % 3]} * {m[2][(i + 2) % 3]} - {m[1][(i + 2) % 3]} * {m[2][(i + 1) % 3]})" for i in range(3)) + ")"
    cell = lambda i, j: f"m{min(i, j)}{max(i, j)}"
    parts = ["SELECT a1, a2, gg, 0::DOUBLE AS x0, 0::DOUBLE AS x1, 0::DOUBLE AS x2, gg AS error FROM sums"]
    for size in (1, 2, 3):
        for some in combinations(range(3), size):
            own = [[cell(i, j) for j in some] for i in some]
            whole = det[size](own)
            x = {c: f"({det[size]([[f'b{some[i]}' if k == at else own[i][k] for k in range(size)] for i in range(size)])} / {whole})" for at, c in enumerate(some)}
            left = " - ".join(["gg", *(f"{x[c]} * b{c}" for c in some)])
            ok = " AND ".join([f"{whole} > 1e-10 * {' * '.join(cell(c, c) for c in some)}", *(f"{v} >= 0" for v in x.values())])
            parts.append(f"SELECT a1, a2, gg, {', '.join(x.get(c, '0::DOUBLE') + f' AS x{c}' for c in range(3))}, {left} AS error FROM sums WHERE {ok}")
    shape = lambda a: f"CASE WHEN distance < {a} THEN 1.5::DOUBLE * distance / {a} - 0.5::DOUBLE * pow(distance / {a}, 3) ELSE 1 END"
    return f"""tries AS (SELECT 1.5::DOUBLE * (SELECT max(distance) FROM curve) * (k + 1) / {tries} AS a FROM range({tries}) t(k)),
 f AS (SELECT t1.a AS a1, t2.a AS a2, pairs::DOUBLE AS w, gamma AS g, {shape('t1.a')} AS f1, {shape('t2.a')} AS f2 FROM curve, tries t1, tries t2 WHERE t1.a < t2.a),
 sums AS (SELECT a1, a2, sum(w) AS m00, sum(w * f1) AS m01, sum(w * f2) AS m02, sum(w * f1 * f1) AS m11, sum(w * f1 * f2) AS m12, sum(w * f2 * f2) AS m22, sum(w * g) AS b0, sum(w * g * f1) AS b1, sum(w * g * f2) AS b2, sum(w * g * g) AS gg FROM f GROUP BY ALL),
 solved AS ({' UNION ALL '.join(parts)}),
 best AS (SELECT * FROM solved ORDER BY round(error / gg, 8), (x0 > 0)::INT + (x1 > 0)::INT + (x2 > 0)::INT, a1, a2 LIMIT 1)"""


_WAVE = "(20 * sin(x / 60) + 30 * cos(y / 110) + value / 10)"


@query(
    f"WITH s0 AS ({V.SAMPLES.split(' AS (', 1)[1][:-1]}), samples AS (SELECT sample_id, x, y, z, {_WAVE} AS value FROM s0), {_PAIRS.format(d=_DIST, R=150)}, curve AS (SELECT ceil(d / 10) AS lag, avg(d) AS distance, avg((vi - vj) ** 2 / 2) AS gamma, count(*) AS pairs FROM p WHERE d > 0 GROUP BY 1), {_nested_sql(12)} SELECT unnest([0, 1, 2]) AS structure, unnest(['nugget', 'spherical', 'spherical']) AS model, {r('unnest([0::DOUBLE, a1, a2])', 'range', 3)}, {r('unnest([x0, x1, x2])', 'sill', 3)} FROM best"
)
def nested_variogram(spark, sf_dir):
    rows = V.samples(spark, sf_dir).withColumn("value", 20 * F.sin(F.col("x") / 60) + 30 * F.cos(F.col("y") / 110) + F.col("value") / 10)
    curve = variograms.experimental(rows, "sample_id", "value", 15, 10.0)
    return rounded(spark.createDataFrame([tuple(s.values()) for s in variograms.fitted_nested(curve, tries=12)], "structure int, model string, range double, sill double"), 3)


# --- orientations -------------------------------------------------------------------


def _axes(spark, sf_dir):
    key = F.col("p_partkey")
    normal = geometry.pole((key * 13 % 90).cast("double"), ((key * 29 % 360) / 3 + F.when(key % 3 == 0, 0).when(key % 3 == 1, 100).otherwise(220)).cast("double"))
    return V.table(spark, sf_dir, "part").select(key.alias("id"), *((c * F.when(key % 2 == 0, -1.0).otherwise(1.0)).alias(n) for c, n in zip(normal, ("nx", "ny", "nz"))))


_AXES = "planes AS (SELECT p_partkey AS id, radians(p_partkey * 13 % 90) AS d, radians((p_partkey * 29 % 360) / 3::DOUBLE + [0, 100, 220][(p_partkey % 3 + 1)::INT]) AS a FROM part), axes AS (SELECT id, -sin(d) * sin(a) AS x, -sin(d) * cos(a) AS y, -cos(d) AS z FROM planes)"


def _sets_sql(k: int, rounds: int) -> str:
    """Axial k-means: furthest-first starts, leading axes by squaring the orientation matrix eight times."""
    dot = lambda c: f"round(abs(a.x * {c}.x + a.y * {c}.y + a.z * {c}.z), 12)"
    steps = ["s0 AS (SELECT x, y, z FROM axes ORDER BY id LIMIT 1)"]
    for i in range(1, k):
        near = ", ".join(dot(f"s{j}") for j in range(i))
        near = f"greatest({near})" if i > 1 else near
        steps.append(f"s{i} AS (SELECT a.x, a.y, a.z FROM axes a, {', '.join(f's{j}' for j in range(i))} ORDER BY {near}, id LIMIT 1)")
    steps.append("c0 AS (" + " UNION ALL ".join(f"SELECT {i} AS j, x, y, z FROM s{i}" for i in range(k)) + ")")
    names = ("xx", "xy", "xz", "yy", "yz", "zz")
    at = lambda i, j: names[{(0, 0): 0, (0, 1): 1, (0, 2): 2, (1, 1): 3, (1, 2): 4, (2, 2): 5}[min(i, j), max(i, j)]]
    cells = [(i, j) for i in range(3) for j in range(i, 3)]
    for t in range(rounds + 1):
        steps.append(f"a{t} AS (SELECT a.id, a.x, a.y, a.z, c.j, abs(a.x * c.x + a.y * c.y + a.z * c.z) AS dot FROM axes a, c{t} c QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {dot('c')} DESC, c.j) = 1)")
        if t == rounds:
            break
        steps.append(f"m{t}_0 AS (SELECT j, " + ", ".join(f"sum({'xyz'[i]} * {'xyz'[q]}) / count(*) AS {at(i, q)}" for i, q in cells) + f" FROM a{t} GROUP BY j)")
        for p in range(9):
            square = ", ".join(f"({' + '.join(f'{at(i, s)} * {at(s, q)}' for s in range(3))}) / pow(xx + yy + zz, 2) AS {at(i, q)}" for i, q in cells)
            steps.append(f"m{t}_{p + 1} AS (SELECT j, {square} FROM m{t}_{p})")
        big = f"m{t}_9"
        steps.append(f"c{t + 1} AS (SELECT j, CASE WHEN xx >= yy AND xx >= zz THEN xx WHEN yy >= zz THEN xy ELSE xz END / sqrt(greatest(xx, yy, zz) * (xx + yy + zz)) AS x, CASE WHEN xx >= yy AND xx >= zz THEN xy WHEN yy >= zz THEN yy ELSE yz END / sqrt(greatest(xx, yy, zz) * (xx + yy + zz)) AS y, CASE WHEN xx >= yy AND xx >= zz THEN xz WHEN yy >= zz THEN yz ELSE zz END / sqrt(greatest(xx, yy, zz) * (xx + yy + zz)) AS z FROM {big})")
    return ", ".join(steps)


@query(f"WITH {_AXES}, {_sets_sql(3, 3)} SELECT id, j::INT AS cluster, {r('degrees(acos(least(dot, 1)))', 'angle', 3)} FROM a3")
def orientation_sets(spark, sf_dir):
    rows, _ = structural.axial_clusters(_axes(spark, sf_dir), "id", ("nx", "ny", "nz"), 3, rounds=3)
    return rounded(rows, 3)


@query(
    f"WITH RECURSIVE {_AXES}, near AS (SELECT a.id AS a, b.id AS b FROM axes a, axes b WHERE least(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)), sqrt(pow(a.x + b.x, 2) + pow(a.y + b.y, 2) + pow(a.z + b.z, 2))) <= {2 * math.sin(math.radians(1.1) / 2)!r}), core AS (SELECT a AS c FROM near GROUP BY 1 HAVING count(*) >= 4), e AS (SELECT a, b FROM near WHERE a IN (SELECT c FROM core) AND b IN (SELECT c FROM core)), reached AS (SELECT a, b FROM e UNION SELECT reached.a, e.b FROM reached JOIN e ON e.a = reached.b), own AS (SELECT a, min(b) AS k FROM reached GROUP BY 1), border AS (SELECT b, arg_min(k, n.a) AS k FROM near n JOIN own USING (a) GROUP BY 1) SELECT id, coalesce(own.k, border.k, -1) AS cluster FROM axes LEFT JOIN own ON own.a = id LEFT JOIN border ON border.b = id"
)
def orientation_density_sets(spark, sf_dir):
    return structural.axial_density_clusters(_axes(spark, sf_dir), "id", ("nx", "ny", "nz"), 1.1, 4)


# --- planes -------------------------------------------------------------------------


def _planes_sql(name: str, source: str) -> str:
    """SQL of upward normal and planarity from columns xx, xy, ... of a source: the closed form of a symmetric matrix's eigenvalues."""
    return f"""{name}_1 AS (SELECT *, (xx + yy + zz) / 3 AS q FROM {source}),
 {name}_2 AS (SELECT *, sqrt((pow(xx - q, 2) + pow(yy - q, 2) + pow(zz - q, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM {name}_1),
 {name}_3 AS (SELECT *, acos(greatest(least(((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / nullif(p * p * p, 0) / 2, 1), -1)) / 3 AS f FROM {name}_2),
 {name}_4 AS (SELECT *, q + 2 * p * cos(f) AS l1, q + 2 * p * cos(f + 2 * pi() / 3) AS l3 FROM {name}_3),
 {name}_5 AS (SELECT *, 3 * q - l1 - l3 AS l2, [[xy * yz - xz * (yy - l3), xz * xy - (xx - l3) * yz, (xx - l3) * (yy - l3) - xy * xy], [xy * (zz - l3) - xz * yz, xz * xz - (xx - l3) * (zz - l3), (xx - l3) * yz - xy * xz], [(yy - l3) * (zz - l3) - yz * yz, yz * xz - xy * (zz - l3), xy * yz - (yy - l3) * xz]] AS v FROM {name}_4),
 {name}_6 AS (SELECT *, list_sort(list_transform(v, lambda c: [c[1] * c[1] + c[2] * c[2] + c[3] * c[3], c[1], c[2], c[3]]))[3] AS u FROM {name}_5),
 {name} AS (SELECT *, u[2] / sqrt(u[1]) * CASE WHEN u[4] < 0 THEN -1 ELSE 1 END AS gx, u[3] / sqrt(u[1]) * CASE WHEN u[4] < 0 THEN -1 ELSE 1 END AS gy, abs(u[4]) / sqrt(u[1]) AS gz, CASE WHEN l2 > 1e-10 * 3 * q THEN greatest(least(1 - l3 / l2, 1), 0) ELSE 0 END AS confidence FROM {name}_6)"""


_COVARIANCES = "covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz"


def _contacts(spark, sf_dir):
    """Samples as contacts of five formations, each near a dipping plane."""
    key = F.col("sample_id")
    rows = V.samples(spark, sf_dir).withColumn("f", key % 5)
    return rows.select("sample_id", "x", "y", (F.col("f") * 300 + F.col("x") * (F.col("f") - 2) / 8 + F.col("y") / (F.col("f") + 3) + F.col("value") / 2).alias("z"), F.concat(F.lit("F"), "f").alias("formation"), F.col("hole").alias("hole_id"))


_CONTACTS = V.SAMPLES + ", contacts AS (SELECT sample_id, x, y, (sample_id % 5) * 300 + x * (sample_id % 5 - 2) / 8 + y / (sample_id % 5 + 3) + value / 2 AS z, 'F' || (sample_id % 5) AS formation, hole AS hole_id FROM samples)"


def _ranks(spark, sf_dir):
    return _contacts(spark, sf_dir).select("formation").distinct().withColumn("rank", F.substring("formation", 2, 1).cast("int"))


@query(
    f"""WITH {_CONTACTS}, fc AS (SELECT formation, {_COVARIANCES} FROM contacts GROUP BY 1 HAVING count(*) >= 3), {_planes_sql('fp', 'fc')},
 one AS (SELECT x, y, z, gx, gy, gz, formation, confidence, 1 AS turn, 'boundary' AS source FROM contacts JOIN fp USING (formation) WHERE confidence >= 0.25),
 steps AS (SELECT *, substr(formation, 2, 1)::INT AS rank, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1, lead(formation) OVER w AS f1, lead(substr(formation, 2, 1)::INT) OVER w AS r1 FROM contacts WINDOW w AS (PARTITION BY hole_id ORDER BY z, x, y, formation)),
 far AS (SELECT *, sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y) + (z1 - z) * (z1 - z)) AS d FROM steps),
 two AS (SELECT x + (x1 - x) * t AS x, y + (y1 - y) * t AS y, z + (z1 - z) * t AS z, (x1 - x) / d * sign(r1 - rank) AS gx, (y1 - y) / d * sign(r1 - rank) AS gy, (z1 - z) / d * sign(r1 - rank) AS gz, f1 AS formation, 0.5 + 0.5::DOUBLE * abs(z1 - z) / d AS confidence, 2 AS turn, 'hole' AS source FROM far, (SELECT unnest([0, 0.5, 1])::DOUBLE AS t) WHERE d >= 1e-6 AND r1 <> rank),
 means AS (SELECT formation, hole_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM contacts GROUP BY ALL),
 mc AS (SELECT formation, {_COVARIANCES} FROM means GROUP BY 1 HAVING count(*) >= 3), {_planes_sql('mp', 'mc')},
 three AS (SELECT x, y, z, gx, gy, gz, formation, confidence * 0.8 AS confidence, 3 AS turn, 'cross hole' AS source FROM means JOIN mp USING (formation) WHERE confidence >= 0.2 AND (SELECT count(DISTINCT hole_id) FROM contacts) >= 3),
 every AS (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three)
 SELECT {', '.join(f'round({c}, 3) + 0 AS {c}' for c in ('x', 'y', 'z', 'gx', 'gy', 'gz'))}, formation, {r('confidence', 'confidence', 3)}, source FROM every QUALIFY row_number() OVER (PARTITION BY x, y, z ORDER BY confidence DESC, turn, formation, gx, gy, gz) = 1"""
)
def contact_gradients(spark, sf_dir):
    return _plain(rounded(planes.contact_gradients(_contacts(spark, sf_dir), _ranks(spark, sf_dir), "sample_id"), 3))


@query(
    f"""WITH {_CONTACTS}, near AS (SELECT t.sample_id, t.formation, s.x, s.y, s.z FROM contacts t JOIN contacts s ON s.formation = t.formation AND s.sample_id <> t.sample_id QUALIFY row_number() OVER (PARTITION BY t.sample_id ORDER BY {_DIST}, s.sample_id) <= 9),
 nc AS (SELECT sample_id, {_COVARIANCES} FROM near GROUP BY 1), {_planes_sql('np', 'nc')}
 SELECT sample_id, x, y, {r('z', 'z')}, {', '.join(f'round({c}, 3) + 0 AS {c}' for c in ('gx', 'gy', 'gz'))}, formation, {r('confidence', 'confidence', 3)} FROM np JOIN contacts USING (sample_id) WHERE confidence >= 0.25"""
)
def local_gradients(spark, sf_dir):
    out = planes.local_gradients(_contacts(spark, sf_dir), "sample_id", 9)
    return _plain(rounded(out.withColumn("z", F.round("z", 4)), 3).drop("z").join(out.select("sample_id", F.round("z", 4).alias("z")), "sample_id"))


@query(
    f"""WITH RECURSIVE {V.SAMPLES}, high AS (SELECT * FROM samples WHERE value > 60), near AS (SELECT t.sample_id AS a, s.sample_id AS b FROM high t JOIN high s ON {_DIST} <= 55), core AS (SELECT a AS c FROM near GROUP BY 1 HAVING count(*) >= 4), e AS (SELECT a, b FROM near WHERE a IN (SELECT c FROM core) AND b IN (SELECT c FROM core)), reached AS (SELECT a, b FROM e UNION SELECT reached.a, e.b FROM reached JOIN e ON e.a = reached.b), own AS (SELECT a, min(b) AS k FROM reached GROUP BY 1), border AS (SELECT b, arg_min(k, n.a) AS k FROM near n JOIN own USING (a) GROUP BY 1),
 c AS (SELECT high.*, coalesce(own.k, border.k) AS cluster FROM high LEFT JOIN own ON own.a = sample_id LEFT JOIN border ON border.b = sample_id), k AS (SELECT cluster, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, avg(value) AS m, {_COVARIANCES} FROM c WHERE cluster IS NOT NULL GROUP BY 1 HAVING count(*) >= 3), {_planes_sql('kp', 'k')}
 SELECT row_number() OVER (ORDER BY cluster)::INT AS fault, cluster, n, {r('cx', 'cx', 2)}, {r('cy', 'cy', 2)}, {r('cz', 'cz', 2)}, {r('degrees(acos(least(gz, 1)))', 'dip', 2)}, {r('(degrees(atan2(gx, gy)) + 360) % 360', 'dip_direction', 2)}, {r('confidence', 'confidence', 2)}, {r('m', 'mean_misfit', 2)} FROM kp WHERE confidence >= 0.3"""
)
def potential_faults(spark, sf_dir):
    return rounded(planes.potential_faults(V.samples(spark, sf_dir), "sample_id", "value", 60.0, 55.0, 4, 0.3), 2)


# --- octrees and patterns ------------------------------------------------------------

_TREE = f"""WITH {V.BLOCKS}, box AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM blocks),
 levels AS (SELECT unnest(range(6)) AS level), placed AS (SELECT block_id, level, {', '.join(f'coalesce(least(floor(({a} - {a}0) / nullif({a}1 - {a}0, 0) * 32), 31), 0)::BIGINT >> (5 - level)::BIGINT AS i{a}' for a in 'xyz')} FROM blocks, box, levels),
 counts AS (SELECT level, ix, iy, iz, count(*) AS n FROM placed GROUP BY ALL),
 leaf AS (SELECT block_id, min(level) AS level FROM placed JOIN counts USING (level, ix, iy, iz) WHERE n <= 400 OR level = 5 GROUP BY 1),
 bits AS (SELECT unnest(range(5)) AS b), leaves AS (SELECT DISTINCT level, ix, iy, iz, n FROM leaf JOIN placed USING (block_id, level) JOIN counts USING (level, ix, iy, iz)),
 coded AS (SELECT level, ix, iy, iz, n, sum((((ix >> b) & 1) << (3 * b)) + (((iy >> b) & 1) << (3 * b + 1)) + (((iz >> b) & 1) << (3 * b + 2)))::BIGINT AS cell FROM leaves, bits GROUP BY ALL)"""


@query(_TREE + " SELECT level::INT AS level, cell, n, " + ", ".join(f"{r(f'{a}0 + i{a} * ({a}1 - {a}0) / pow(2, level)', f'lo_{a}')}, {r(f'{a}0 + (i{a} + 1) * ({a}1 - {a}0) / pow(2, level)', f'hi_{a}')}" for a in "xyz") + " FROM coded, box")
def octree_leaves(spark, sf_dir):
    return rounded(octree.octree(V.blocks(spark, sf_dir), 5, 400))


@query(_TREE + " SELECT block_id, level::INT AS level, cell FROM leaf JOIN placed USING (block_id, level) JOIN coded USING (level, ix, iy, iz)")
def octree_points(spark, sf_dir):
    return octree.in_leaves(V.blocks(spark, sf_dir).select("block_id", "x", "y", "z"), 5, 400).select("block_id", "level", "cell")


_TEMPLATE = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, 0, -1)]


def _training(spark, sf_dir):
    rows = V.blocks(spark, sf_dir).groupBy(*((F.col(a) / s).cast("long").alias(c) for a, s, c in (("x", 25, "i"), ("y", 25, "j"), ("z", 10, "k")))).agg(F.sum("tonnes").cast("long").alias("t"))
    return rows.select("i", "j", "k", (F.col("t") % 3).cast("int").alias("category"))


_TRAINING = V.BLOCKS + ", training AS (SELECT (x / 25)::BIGINT AS i, (y / 25)::BIGINT AS j, (z / 10)::BIGINT AS k, (sum(tonnes)::BIGINT % 3)::INT AS category FROM blocks GROUP BY 1, 2, 3)"
_EVENTS = _TRAINING + ", seen AS (SELECT t.*, " + ", ".join(f"n{m}.category AS e{m}" for m in range(4)) + " FROM training t " + " ".join(f"LEFT JOIN training n{m} ON n{m}.i = t.i + {a} AND n{m}.j = t.j + {b} AND n{m}.k = t.k + {c}" for m, (a, b, c) in enumerate(_TEMPLATE)) + "), prefixes AS (" + " UNION ALL ".join("SELECT i, j, k, category, " + f"{n} AS length, " + (" || ',' || ".join(f"e{m}" for m in range(n)) if n else "''") + " AS prefix FROM seen WHERE " + (" AND ".join(f"e{m} IS NOT NULL" for m in range(n)) if n else "true") for n in range(5)) + "), counts AS (SELECT length, prefix::VARCHAR AS prefix, category, count(*) AS n FROM prefixes GROUP BY ALL)"


@query(f"WITH {_EVENTS} SELECT length, prefix, category, n FROM counts")
def pattern_counts(spark, sf_dir):
    return patterns.pattern_counts(_training(spark, sf_dir), "category", _TEMPLATE)


@query(f"WITH {_EVENTS}, totals AS (SELECT length, prefix, sum(n) AS total FROM counts GROUP BY ALL HAVING sum(n) >= 25), best AS (SELECT i, j, k, max(p.length) AS length, arg_max(p.prefix, p.length) AS prefix, arg_max(total, p.length) AS total FROM prefixes p JOIN totals t ON t.length = p.length AND t.prefix = p.prefix GROUP BY ALL) SELECT (k * 1000000 + j * 1000 + i) AS node, c.category, {r('coalesce(n, 0) / total', 'probability')}, b.length, total::BIGINT AS replicates FROM best b, (SELECT unnest([0, 1, 2]) AS category) c LEFT JOIN counts x ON x.length = b.length AND x.prefix = b.prefix AND x.category = c.category")
def pattern_probabilities(spark, sf_dir):
    """The distributions at the training grid's own nodes, of their neighbours."""
    grid = _training(spark, sf_dir)
    asked = patterns.events(grid, "category", _TEMPLATE).withColumn("node", F.col("k") * 1000000 + F.col("j") * 1000 + F.col("i"))
    return rounded(patterns.conditional(asked, "node", "event", patterns.pattern_counts(grid, "category", _TEMPLATE), [0, 1, 2], 25))


# --- development and risk -------------------------------------------------------------


@query(
    """WITH RECURSIVE tasks AS (SELECT p_partkey + 1 AS task, (p_size + 5)::DOUBLE AS length FROM part), links AS (SELECT task, task // 2 AS before FROM tasks WHERE task // 2 IN (SELECT task FROM tasks) UNION SELECT task, task // 3 FROM tasks WHERE task // 3 IN (SELECT task FROM tasks)),
 w AS (SELECT task, 0 AS wave FROM tasks WHERE task NOT IN (SELECT task FROM links) UNION SELECT l.task, wave + 1 FROM w JOIN links l ON l.before = w.task), waves AS (SELECT task, max(wave) AS wave FROM w GROUP BY 1),
 o AS (SELECT task, length, wave, row_number() OVER (ORDER BY wave, task) AS turn FROM tasks JOIN waves USING (task)),
 f AS (SELECT 0::BIGINT AS turn, 1 AS period, 0::DOUBLE AS held UNION ALL SELECT o.turn, CASE WHEN held + length > 900 THEN period + 1 ELSE period END, CASE WHEN held + length > 900 THEN length ELSE held + length END FROM f JOIN o ON o.turn = f.turn + 1)
 SELECT task, length, wave::INT AS wave, turn, CASE WHEN period <= 40 THEN period END::INT AS period FROM o JOIN f USING (turn)"""
)
def development_schedule(spark, sf_dir):
    key = F.col("p_partkey")
    tasks = V.table(spark, sf_dir, "part").select((key + 1).alias("task"), (F.col("p_size") + 5).cast("double").alias("length"))
    links = tasks.select("task", F.floor(F.col("task") / 2).alias("before")).unionByName(tasks.select("task", F.floor(F.col("task") / 3).alias("before")))
    return planning.development_schedule(tasks, links, 900.0, 40).select("task", "length", "wave", "turn", F.col("period").cast("int").alias("period"))


_HALVINGS = 60


@query(
    f"""WITH RECURSIVE {V.BLOCKS}, {_DRAWS}, p AS (SELECT period, sum(tonnes) AS t, sum(tonnes * grade) / 100 AS m FROM blocks GROUP BY 1), f AS (SELECT draw, period, m * recovery * price - t * (mining + processing) AS v FROM draws, p UNION ALL SELECT draw, 0, -0.9::DOUBLE * (SELECT sum(m * 50 * 0.87 - t * 13.5) FROM p) * (0.6 + {_u(9, 'draw')}) FROM draws),
 n AS (SELECT draw, v, row_number() OVER (PARTITION BY draw ORDER BY period) - 1 AS k FROM f), lo AS (SELECT draw, sum(v * pow(0.1::DOUBLE, -k)) AS at_low, sum(v * pow(11::DOUBLE, -k)) AS at_high, sum(v * pow(1.1::DOUBLE, -k)) AS npv FROM n GROUP BY 1),
 h AS (SELECT draw, 0 AS step, -0.9::DOUBLE AS a, 10::DOUBLE AS b FROM lo UNION ALL SELECT h.draw, step + 1, CASE WHEN sign(w) = sign(at_low) THEN (a + b) / 2 ELSE a END, CASE WHEN sign(w) = sign(at_low) THEN b ELSE (a + b) / 2 END FROM (SELECT h.draw, any_value(step) AS step, any_value(a) AS a, any_value(b) AS b, sum(v * pow(1 + (a + b) / 2, -k)) AS w FROM h JOIN n ON n.draw = h.draw WHERE step < {_HALVINGS} GROUP BY h.draw) h JOIN lo USING (draw)),
 i AS (SELECT draw, npv, CASE WHEN sign(at_low) <> sign(at_high) THEN (a + b) / 2 END AS irr FROM h JOIN lo USING (draw) WHERE step = {_HALVINGS}),
 s AS (SELECT draw, sum((sign(v) <> sign(p))::INT) AS c FROM (SELECT draw, v, lag(v) OVER (PARTITION BY draw ORDER BY k) AS p FROM n WHERE abs(v) > 1e-9) GROUP BY 1), q AS (SELECT quantile_cont(irr, 0.2) AS rate FROM i)
 SELECT {r('any_value(rate)', 'rate', 5)}, count(*) AS scenarios, count(irr) AS valid, {r('avg(irr)', 'mean_rate', 5)}, {r('stddev_pop(irr)', 'deviation', 5)}, {r('avg(CASE WHEN irr >= rate THEN 1 ELSE 0 END)', 'reached', 5)}, count(*) FILTER (c > 1) AS more_rates, {r('avg(npv)', 'mean_npv10', 1)}, {r('min(npv)', 'least_npv10', 1)} FROM i JOIN s USING (draw), q"""
)
def risk_adjusted_rate(spark, sf_dir):
    """Fifty draws of prices and costs against a capital outlay that varies with them."""
    from ..operators.simulation import uniform

    per = V.blocks(spark, sf_dir).groupBy("period").agg(F.sum("tonnes").alias("t"), (F.sum(F.col("tonnes") * F.col("grade")) / 100).alias("m"))
    draws = _draws(spark)
    flows = draws.crossJoin(per).select("draw", "period", (F.col("m") * F.col("recovery") * F.col("price") - F.col("t") * (F.col("mining") + F.col("processing"))).alias("flow"))
    outlay = per.agg(F.sum(F.col("m") * 50 * 0.87 - F.col("t") * 13.5).alias("s"))
    first = draws.crossJoin(F.broadcast(outlay)).select("draw", F.lit(0).alias("period"), (-0.9 * F.col("s") * (0.6 + uniform(9, F.col("draw")))).alias("flow"))
    out = economics.risk_adjusted_rate(flows.unionByName(first), "draw", "period", "flow", 0.8)
    return rounded(out, 5).withColumns({c: F.round(c, 1) for c in ("mean_npv10", "least_npv10")})


# --- fixes, audits, cell sizes --------------------------------------------------------


@query(
    f"""WITH {V.SURVEYS}, {V.COLLARS}, c AS (SELECT CASE hole_id % 4 WHEN 0 THEN ' h' || hole_id WHEN 1 THEN 'H' || hole_id WHEN 2 THEN 'h' || hole_id || '  ' ELSE 'H' || hole_id END AS h FROM collars), s AS (SELECT 'H' || hole_id AS h, depth, azimuth * 3 - 200 AS a FROM surveys)
 SELECT table_name, rule_code, hole_id, "column", CASE WHEN table_name = 'surveys' THEN NULL ELSE old END AS old, CASE WHEN table_name = 'surveys' THEN NULL ELSE new END AS new, count(*) AS n FROM (
 SELECT 'collars' AS table_name, 'HOLE_ID' AS rule_code, h AS hole_id, 'hole_id' AS "column", h AS old, upper(trim(h)) AS new FROM c WHERE h <> upper(trim(h))
 UNION ALL SELECT 'surveys', 'AZIMUTH', h, 'azimuth', '', '' FROM s WHERE a < 0 OR a >= 360) GROUP BY ALL"""
)
def logged_fixes(spark, sf_dir):
    """The fixes of collars and surveys by hole; of azimuths, which are doubles, the number."""
    key, h = F.col("hole_id"), F.concat(F.lit("H"), "hole_id")
    messy = F.when(key % 4 == 0, F.concat(F.lit(" "), F.lower(h))).when(key % 4 == 2, F.concat(F.lower(h), F.lit("  "))).otherwise(h)
    _, collars = validation.fixed_collars(V.collars(spark, sf_dir).withColumn("hole_id", messy))
    _, surveys = validation.fixed_directions(V.surveys(spark, sf_dir).withColumns({"hole_id": h, "azimuth": F.col("azimuth") * 3 - 200}))
    rows = collars.unionByName(surveys.withColumns({"old": F.lit(None).cast("string"), "new": F.lit(None).cast("string")}))
    return rows.groupBy("table_name", "rule_code", "hole_id", "column", "old", "new").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {V.SAMPLES}, {V.TARGETS}, n AS (SELECT s.value, t.block_id % 11 / 10::DOUBLE AS p0, least(t.block_id % 11 / 10::DOUBLE + 0.2, 1) AS p1, {_DIST} AS d, row_number() OVER (PARTITION BY s.sample_id ORDER BY {_DIST}, t.block_id) AS k FROM targets t, samples s),
 r AS (SELECT unnest([30, 55])::DOUBLE AS cutoff, (value <= unnest([30, 55]))::INT::DOUBLE AS i, unnest([p0, p1]) AS p FROM n WHERE k = 1 AND d < 80)
 SELECT cutoff, count(*) AS n, {r('avg(i)', 'share')}, {r('avg(p)', 'probability')}, {r('covar_pop(i, p) / (stddev_pop(i) * stddev_pop(p))', 'correlation')}, coalesce(covar_pop(i, p) / (stddev_pop(i) * stddev_pop(p)) > 0.7, false) AS good FROM r GROUP BY 1"""
)
def indicator_audit(spark, sf_dir):
    share = F.col("block_id") % 11 / 10.0
    blocks = V.targets(spark, sf_dir).withColumns({"p0": share, "p1": F.least(share + 0.2, F.lit(1.0))})
    return rounded(reporting.indicator_audit(V.samples(spark, sf_dir), blocks, "value", [30.0, 55.0], ["p0", "p1"], 80.0))


_NICE = "CASE WHEN {v} < 2 THEN round_even({v}, 1) WHEN {v} < 5 THEN round_even({v}, 0) WHEN {v} < 10 THEN round_even({v} / 2.5, 0) * 2.5 WHEN {v} < 50 THEN round_even({v} / 5, 0) * 5 ELSE round_even({v} / 10, 0) * 10 END::DOUBLE"


@query(
    f"""WITH {V.SAMPLES}, d AS (SELECT min(sqrt((t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y))) AS d FROM samples t JOIN samples s ON s.sample_id <> t.sample_id GROUP BY t.sample_id), z AS (SELECT z - lag(z) OVER (ORDER BY z) AS d FROM (SELECT DISTINCT z FROM samples)),
 m AS (SELECT (SELECT median(d) FROM d) AS spacing, (SELECT median(d) FROM z WHERE d > 0.1) AS step), c AS (SELECT *, greatest(least(spacing * 2, 200), 5) AS a, greatest(least(step * 3, 100), 2) AS b FROM m) SELECT {r('spacing', 'spacing')}, {r('step', 'step')}, {_NICE.format(v='a')} AS cell, {_NICE.format(v='b')} AS height FROM c"""
)
def suggested_cells(spark, sf_dir):
    return rounded(reporting.suggested_cells(V.samples(spark, sf_dir)))

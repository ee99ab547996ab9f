"""Recurrences in ranges, against plain loops; one group holds most rows and spans all ranges."""

import random

from pyspark.sql import functions as F

from orebed.operators import economics, planning, processes, running, validation


def _got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def test_water_of_a_hot_node(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else f"n{rng.randrange(30)}", i, rng.choice([0.0, 5.0, 9.0]), rng.choice([0.0, 4.0, 12.0])) for i in range(900)]
    rows += [(None, 3, 4.0, 1.0), (None, 5, 9.0, 2.0), ("gap", 1, None, 1.0), ("gap", 2, 3.0, 1.0)]
    expected, held = [], {}
    for node, period, i, o in sorted(rows, key=lambda x: (x[0] or "", x[1])):
        wanted = 0.0 if i is None or o is None else max(held.get(node, 6.0) + i - o, 0.0)
        held[node] = min(wanted, 20.0)
        expected.append((node or "", period, held[node], max(wanted - 20.0, 0.0)))
    found = processes.water_balance(spark.createDataFrame(rows, "node string, period int, inflow double, outflow double"), 6.0, 20.0)
    assert _got(found.withColumn("node", F.coalesce("node", F.lit(""))), "node", "period", "stored", "spill") == sorted(expected)


def test_buckets_of_a_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.9 else "b", i, float(rng.randrange(1, 14)), {"m": i}) for i in range(700)]
    expected, state = [], {}
    for g, i, t, _ in rows:
        used, period = state.get(g, (0.0, 1))
        if used + t > 10 and used:
            used, period = 0.0, period + 1
        state[g] = (used + t, period)
        expected.append((g, i, period))
    units = spark.createDataFrame(rows, "g string, k int, tonnes double, extra map<string,int>")
    found = economics.bucket_filled(units, 10.0, "g", ["k"])
    assert _got(found, "g", "k", "period") == sorted(expected)
    assert found.where("extra['m'] = k").count() == 700
    assert economics.bucket_filled(units.where("k < 0"), 10.0, "g", ["k"]).count() == 0


def test_shells_against_a_loop(spark):
    rng = random.Random(3)
    shells = [(i, float(rng.choice([0, 3, 5, 8, 25]))) for i in range(60)]
    table = spark.createDataFrame(shells, "shell long, tonnes double")
    for periods in (1, 2, 5, 100):
        room, p, expected = 20.0, 1, []
        for shell, t in shells:
            if not t:
                continue
            if t <= room:
                taken = t
            elif p < periods:
                p, room, taken = p + 1, 20.0, min(t, 20.0)
            else:
                continue
            room -= taken
            expected.append((shell, p, taken))
        assert _got(planning.shells_in_periods(table, 20.0, periods), "shell", "period", "tonnes") == expected, periods


def test_repair_of_one_long_hole(spark):
    rng = random.Random(4)
    rows = [("h", i * 1.0 + rng.choice([0, 0.05, -0.3, 0.4]), i + rng.choice([1.0, 0.2, -0.5, 1.3]), i) for i in range(500)] + [("g", None, 2.0, 0), ("g", 1.0, None, 1)]
    fixed = validation.fixed_intervals(spark.createDataFrame(rows, "hole_id string, depth_from double, depth_to double, code int"), spark.createDataFrame([("h", 400.0), ("h", 450.0)], "hole_id string, length double"))
    expected, before = [], None
    for _, a, b, code in sorted((r for r in rows if r[0] == "h"), key=lambda r: r[1:]):
        a = before if before is not None and a - before <= 0.1 else a
        b = a + 0.01 if b <= a else b
        before = min(b, max(450.0, a))
        expected.append((code, a, before))
    assert _got(fixed.where("hole_id = 'h'"), "code", "depth_from", "depth_to") == sorted(expected)
    assert fixed.where("hole_id = 'g'").count() == 2


def test_sums_that_never_forget(spark):
    """A recurrence whose state always differs is worked out range by range, to the end."""
    rows = spark.range(300).select(F.lit(1).alias("g"), "id", F.lit(1.0).alias("v"))
    found = running.folded(rows, ["g"], ["id"], [F.col("v")], lambda s, x: (((s[0] if s else 0.0) + x[0],), ((s[0] if s else 0.0) + x[0],)), {"through": "double"})
    assert found.where("through = id + 1").count() == 300

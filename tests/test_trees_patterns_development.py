"""Octrees, pattern tables, development waves and risk rates against plain versions."""

from collections import Counter

import numpy as np
import pytest

from orebed.operators import economics, octree, patterns, planning


def test_leaves_hold_few_points_and_all_of_them(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.uniform(0, 100, (300, 3)), rng.normal(20, 0.5, (400, 3))])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)] + [(9999, None, 0.0, 0.0), (9998, float("nan"), 0.0, 0.0)], "id long, x double, y double, z double")
    leaves = octree.octree(df, 6, 40).collect()
    assert sum(r["n"] for r in leaves) == 700
    assert all(r["n"] <= 40 or r["level"] == 6 for r in leaves) and any(r["level"] < 3 for r in leaves)
    own = {r["id"]: (r["level"], r["cell"]) for r in octree.in_leaves(df, 6, 40).collect()}
    assert Counter(own.values()) == {(r["level"], r["cell"]): r["n"] for r in leaves}
    bounds = {(r["level"], r["cell"]): r for r in leaves}
    parents = Counter()
    for i, p in enumerate(x):
        b = bounds[own[i]]
        assert all(b[f"lo_{a}"] - 1e-9 <= v <= b[f"hi_{a}"] + 1e-9 for a, v in zip("xyz", p))
    for i in own:
        level, cell = own[i]
        for up in range(level):
            parents[up, cell >> (3 * (level - up))] += 1
    assert all(n > 40 for n in parents.values())  # only what holds too many is split
    assert octree.octree(df.limit(0), 6, 40).collect() == []
    flat = octree.octree(df.where("id < 300").selectExpr("id", "x", "1D as y", "2D as z"), 6, 40).collect()
    assert sum(r["n"] for r in flat) == 300 and all(r["lo_y"] == 1 for r in flat)


def test_patterns_equal_a_scan(spark):
    rng = np.random.default_rng(7)
    cells = {(i, j, k): int(rng.integers(0, 3)) for i in range(7) for j in range(6) for k in range(3) if rng.uniform() < 0.9}
    grid = spark.createDataFrame([(*c, v) for c, v in cells.items()] + [(50, 50, 50, None)], "i int, j int, k int, facies int")
    template = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (-1, -1, 0)]
    counts, asked = Counter(), []
    for (i, j, k), v in cells.items():
        event = [cells.get((i + a, j + b, k + c)) for a, b, c in template]
        asked.append(event)
        known = event.index(None) if None in event else len(event)
        for n in range(known + 1):
            counts[n, ",".join(map(str, event[:n])), v] += 1
    table = patterns.pattern_counts(grid, "facies", template)
    assert {(r["length"], r["prefix"], r["category"]): r["n"] for r in table.collect()} == counts
    events = [[0, 1, None, 2], [None, 0, 0, 0], [2, 2, 2, 2], [1, 1], [], [7, 0]]
    df = spark.createDataFrame(list(enumerate(events)), "id int, event array<int>")
    found = {(r["id"], r["category"]): (r["probability"], r["length"]) for r in patterns.conditional(df, "id", "event", table, [0, 1, 2], 4).collect()}
    for i, event in enumerate(events):
        known = event.index(None) if None in event else len(event)
        for n in range(known, -1, -1):
            own = {v: c for (m, p, v), c in counts.items() if m == n and p == ",".join(map(str, event[:n]))}
            if sum(own.values()) >= 4:
                break
        for v in range(3):
            assert found[i, v] == (pytest.approx(own.get(v, 0) / sum(own.values())), n)
    few = patterns.conditional(df, "id", "event", table.limit(0), [0, 1], 4).collect()
    assert {(r["probability"], r["length"], r["replicates"]) for r in few} == {(0.5, None, 0)}


def test_development_goes_in_waves_and_cycles_come_last(spark):
    tasks = [(t, 10.0 if t != 4 else 95.0) for t in range(12)]
    links = [(1, 0), (2, 1), (3, 1), (5, 2), (5, 3), (5, 3), (7, 8), (8, 9), (9, 7), (10, 9), (6, 99), (None, 0)]
    df = spark.createDataFrame(tasks, "task long, length double")
    rows = planning.development_schedule(df, spark.createDataFrame(links, "task long, before long"), 30.0, 4).orderBy("turn").collect()
    wave = {r["task"]: r["wave"] for r in rows}
    assert wave == {0: 0, 4: 0, 6: 0, 11: 0, 1: 1, 2: 2, 3: 2, 5: 3, 7: None, 8: None, 9: None, 10: None}
    order = sorted(wave, key=lambda t: (99 if wave[t] is None else wave[t], t))
    assert [r["task"] for r in rows] == order and [r["turn"] for r in rows] == list(range(1, 13))
    period, held, expected = 1, 0.0, []
    for t in order:
        if held + dict(tasks)[t] > 30:
            period, held = period + 1, 0.0
        held += dict(tasks)[t]
        expected.append(period if period <= 4 else None)
    assert [r["period"] for r in rows] == expected
    assert planning.development_schedule(df.limit(0), spark.createDataFrame([], "task long, before long"), 30.0, 4).collect() == []


def test_the_rate_that_most_scenarios_reach(spark):
    rows = [(s, 0, -100.0) for s in range(9)] + [(s, 1, 100.0 + 5 * s) for s in range(9)] + [(9, 0, -100.0), (9, 1, -5.0), (8, 2, -1.0)]
    out = economics.risk_adjusted_rate(spark.createDataFrame(rows, "s int, t int, v double"), "s", "t", "v", 0.75).first()
    irr = [0.05 * s for s in range(8)] + [np.roots([-100, 140, -1]).max() - 1]
    assert out["scenarios"] == 10 and out["valid"] == 9 and out["more_rates"] == 1
    assert out["rate"] == pytest.approx(np.percentile(irr, 25), abs=1e-6)
    assert out["reached"] == pytest.approx(sum(v >= np.percentile(irr, 25) - 1e-9 for v in irr) / 10)

"""Values, cash flows and recoveries as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def block_value(tonnes: Column, grade: Column, price, mining_cost, processing_cost, recovery) -> Column:
    """Metal recovered at its price, less mining and processing."""
    return tonnes * grade * F.lit(float(recovery)) * F.lit(float(price)) - tonnes * (F.lit(float(mining_cost)) + F.lit(float(processing_cost)))


def net_smelter_return(grades: dict[str, dict], penalties: dict[str, dict] | None = None, transport: float = 0.0) -> Column:
    """Per tonne: payable metal at its price over the elements, less penalties above a limit and transport."""
    total = F.lit(0.0)
    for name, e in grades.items():
        total = total + F.col(name) * F.lit(float(e.get("factor", 1.0) * e["recovery"] * e["payable"] * e["price"]))
    for name, p in (penalties or {}).items():
        total = total - F.greatest(F.col(name) - F.lit(float(p["limit"])), F.lit(0.0)) * F.lit(float(p["cost"]))
    return total - F.lit(float(transport))


def discount_factor(period: Column, rate) -> Column:
    return F.pow(F.lit(1.0) + F.lit(float(rate)), -period)


def present_value(flows: Column, rate: float) -> Column:
    """Of an array of cash flows, the first at time 0."""
    return F.aggregate(F.zip_with(flows, F.sequence(F.lit(0), F.size(flows) - 1), lambda v, t: v * F.pow(F.lit(1.0 + rate), -t)), F.lit(0.0), lambda a, v: a + v)


def sign_changes(flows: Column, tolerance: float = 1e-9) -> Column:
    """Of an array of cash flows, those near zero left out."""
    signs = F.transform(F.filter(flows, lambda v: F.abs(v) > tolerance), lambda v: F.signum(v))
    pairs = F.zip_with(F.slice(signs, F.lit(1), F.greatest(F.size(signs) - 1, F.lit(0))), F.slice(signs, F.lit(2), F.greatest(F.size(signs) - 1, F.lit(0))), lambda a, b: F.when(a != b, 1).otherwise(0))
    return F.aggregate(pairs, F.lit(0), lambda a, v: a + v)


def internal_rate(flows: Column, steps: int = 60, low: float = -0.9, high: float = 10.0) -> Column:
    """Rate at which the present value of an array of flows is 0, by bisection inside a higher-order fold; null where the value keeps its sign between ``low`` and ``high``."""
    worth = lambda rate: F.aggregate(F.zip_with(flows, F.sequence(F.lit(0), F.size(flows) - 1), lambda v, t: v * F.pow(1 + rate, -t)), F.lit(0.0), lambda a, v: a + v)
    start = F.struct(F.lit(low).alias("a"), F.lit(high).alias("b"))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["a"] + s["b"]) / 2
        right = F.signum(worth(middle)) == F.signum(worth(F.lit(low)))
        return F.struct(F.when(right, middle).otherwise(s["a"]).alias("a"), F.when(right, s["b"]).otherwise(middle).alias("b"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["a"] + s["b"]) / 2)
    return F.when(F.signum(worth(F.lit(low))) != F.signum(worth(F.lit(high))), found)


def diluted_grade(ore_grade: Column, ore_tonnes: Column, waste_grade: Column, waste_tonnes: Column) -> Column:
    return F.try_divide(ore_grade * ore_tonnes + waste_grade * waste_tonnes, ore_tonnes + waste_tonnes)


def coefficient_of_variation(mean: Column, deviation: Column) -> Column:
    return F.when(F.abs(mean) > 1e-12, deviation / mean)


DOUBLES = T.ArrayType(T.DoubleType())


#: Grams in the units that metal prices are quoted in.
GRAMS = {"g": 1.0, "kg": 1000.0, "t": 1_000_000.0, "oz": 31.1034768, "lb": 453.59237}


def price_per_gram(price: Column, unit: Column) -> Column:
    """A price a gram from one a unit; null for a unit not known."""
    table = F.create_map(*(F.lit(v) for pair in GRAMS.items() for v in pair))
    return price / F.try_element_at(table, F.lower(unit))

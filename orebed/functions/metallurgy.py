"""Plant response as column expressions: hardness, liberation, separation, recovery, throughput, element values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def work_index(strength: Column) -> Column:
    """Bond work index from the uniaxial strength (MPa), between 5 and 25; 10 where there is none."""
    return F.when(strength <= 0, F.lit(10.0)).otherwise(F.least(F.greatest(0.1 * F.sqrt(strength), F.lit(5.0)), F.lit(25.0)))


def liberation(shares: Column, curve: list[float]) -> Column:
    """Liberation of each size fraction of an array of shares: the curve's value at its place, its last beyond, 0 for an empty fraction."""
    table = F.array(*map(F.lit, map(float, curve)))
    return F.transform(shares, lambda s, i: F.when(s == 0, F.lit(0.0)).otherwise(F.element_at(table, F.least(i, F.lit(len(curve) - 1)) + 1)))


#: Fixed values of the methods: recovery without liberation, gain by it, greatest recovery, upgrade by liberation, greatest concentrate grade.
SEPARATION = {"magnetic": (0.85, 0.15, 0.98, 0.3, 68.0), "gravity": (0.70, 0.25, 0.95, 0.4, 65.0), "flotation": (0.80, 0.20, 0.95, 0.35, 67.0)}


def separation(feed: Column, freed: Column, method: str, silica: Column | None = None, alumina: Column | None = None) -> dict[str, Column]:
    """recovery, concentrate_grade, mass_pull, tailings_grade of a feed grade (percent) and mean liberation; a method not known recovers 0.75 at 1.2 times the grade."""
    if method in SEPARATION:
        base, gain, most, upgrade, limit = SEPARATION[method]
        raw = F.lit(base) + gain * freed
        if method == "magnetic":
            raw = raw + F.least(0.1 * (feed / 60.0), F.lit(0.1))
        elif method == "flotation":
            s = silica if silica is not None else F.lit(5.0)
            a = alumina if alumina is not None else F.lit(2.0)
            raw = raw - F.least(0.1 * (s / 10.0 + a / 5.0), F.lit(0.15))
        recovery, concentrate = F.least(raw, F.lit(most)), F.least(feed * (1 + upgrade * freed), F.lit(limit))
    else:
        recovery, concentrate = F.lit(0.75), feed * 1.2
    pull = F.least(F.when(concentrate > 0, recovery * (feed / concentrate)).otherwise(F.lit(0.1)), F.lit(0.5))
    tailings = F.greatest((feed - recovery * concentrate * pull) / (1 - pull), F.lit(0.0))
    return {"recovery": recovery, "concentrate_grade": concentrate, "mass_pull": pull, "tailings_grade": tailings}


def recovery(grade: Column, kind: str, a: float = 0.8, b: float = 0.0, c: float = 0.0) -> Column:
    """Recovery at a head grade by a constant, linear or polynomial surface, between 0 and 1."""
    raw = {"constant": F.lit(float(a)), "linear": a + b * grade, "polynomial": a + b * grade + c * grade * grade}[kind]
    return F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0))


def throughput(hardness: Column, nominal: float, kind: str = "hardness_factor", base: float = 1.0, penalty: float = 0.0) -> Column:
    """Tonnes an hour: the nominal rate times a factor that falls with hardness above 5 (clamped to 0.1 .. 1), or limited by energy."""
    if kind == "energy_limit":
        return F.lit(float(nominal)) / (1 + (hardness - 5.0) * 0.1)
    return nominal * F.greatest(F.least(base - penalty * (hardness - 5.0) / 5.0, F.lit(1.0)), F.lit(0.1))


def element_value(tonnes: Column, grades: dict[str, Column], recoveries: dict[str, Column], prices: dict[str, float], mining: float, processing: float) -> Column:
    """Revenue of the elements that have a grade, a recovery and a price, less mining and processing."""
    revenue = sum((tonnes * g * recoveries[e] * float(prices[e]) for e, g in grades.items() if e in recoveries and e in prices), F.lit(0.0))
    return revenue - tonnes * (mining + processing)


def transformed(value: Column, kind: str, constant: float | None = None, exponent: float = 1.0) -> Column:
    """log, log10, sqrt, boxcox or power of a value (plus a constant); what the function cannot take is raised to its least argument."""
    v = value + float(constant) if constant is not None else value
    least = F.greatest(v, F.lit(2.220446049250313e-16))
    if kind == "log":
        return F.log(least)
    if kind == "log10":
        return F.log10(least)
    if kind == "sqrt":
        return F.sqrt(F.greatest(v, F.lit(0.0)))
    if kind == "boxcox":
        return F.log(least) if exponent == 0 else (F.pow(least, F.lit(float(exponent))) - 1) / float(exponent)
    if kind == "power":
        return F.pow(F.greatest(v, F.lit(0.0)) if exponent < 1 and exponent != 0 else v, F.lit(float(exponent)))
    raise ValueError(f"no transformation {kind}")

"""Rock mechanics, haulage, processing and environment as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def q_system(rqd: Column, jn: Column, jr: Column, ja: Column, jw: Column, srf: Column) -> Column:
    return rqd / jn * jr / ja * jw / srf


def pillar_strength(strength, width: Column, height: Column, width_power: float = 0.5, height_power: float = 0.75) -> Column:
    """K * w^a / h^b, the power-law pillar formula."""
    return F.lit(float(strength)) * F.pow(width, F.lit(width_power)) / F.pow(height, F.lit(height_power))


def hydraulic_radius(width: Column, height: Column) -> Column:
    return width * height / (2 * (width + height))


def stability_number(q_prime: Column, a: Column, b: Column, c: Column) -> Column:
    return q_prime * a * b * c


def rock_mass_class(rmr: Column) -> Column:
    """The five rock mass rating classes."""
    return F.when(rmr > 80, "I").when(rmr > 60, "II").when(rmr > 40, "III").when(rmr > 20, "IV").otherwise("V")


def cycle_time(distance: Column, loaded_speed: float, empty_speed: float, load: float, dump: float, queue: float = 0.0) -> Column:
    """Minutes of a truck cycle; distance in km, speeds in km/h, the rest in minutes."""
    return F.lit(load + dump + queue) + distance / F.lit(loaded_speed) * 60 + distance / F.lit(empty_speed) * 60


def bond_energy(work_index: Column, feed_microns: float, product_microns: float) -> Column:
    """kWh a tonne: 10 * Wi * (1/sqrt(P80) - 1/sqrt(F80))."""
    return 10 * work_index * (F.lit(product_microns**-0.5) - F.lit(feed_microns**-0.5))


def fan_power(airflow: Column, pressure: Column, efficiency: float) -> Column:
    return airflow * pressure / F.lit(float(efficiency))


def freeboard(volume: Column, capacity: Column, area: Column) -> Column:
    return F.greatest(capacity - volume, F.lit(0.0)) / area


def planar_sliding(dip: Column, dip_direction: Column, slope_dip: float, slope_direction: float, friction: float, lateral: float = 20.0) -> Column:
    """A plane that daylights in the slope, is steeper than friction and dips within the lateral limits."""
    turn = F.abs(F.pmod(dip_direction - F.lit(slope_direction) + 180, F.lit(360.0)) - 180)
    return (turn <= lateral) & (dip < slope_dip) & (dip > friction)


def flexural_toppling(dip: Column, dip_direction: Column, slope_dip: float, slope_direction: float, friction: float, lateral: float = 30.0) -> Column:
    """A steep plane that dips into the slope: (90 - dip) + friction <= slope dip."""
    turn = F.abs(F.pmod(dip_direction - F.lit(slope_direction) + 180, F.lit(360.0)) - 180)
    return (turn >= 180 - lateral) & (90 - dip + F.lit(friction) <= slope_dip)


def slope_risk(rating: Column, angle: Column, height: Column, water: Column, faults: Column | None = None, joints: Column | None = None) -> dict[str, Column]:
    """risk_index (0 to 100), risk_class and failure probability of a slope: rock mass, angle and bench height beyond what the rating class allows, and water.

    Fixed values: for ratings from 80, 60, 40, 20 and below, the allowed angles and bench heights.
    """
    allowed = lambda values: F.when(rating >= 80, values[0]).when(rating >= 60, values[1]).when(rating >= 40, values[2]).when(rating >= 20, values[3]).otherwise(values[4])
    steep = F.least(F.greatest(angle - allowed((70.0, 60.0, 50.0, 40.0, 30.0)), F.lit(0.0)) / 10 * 30, F.lit(30.0))
    tall = F.least(F.greatest(height - allowed((15.0, 12.0, 10.0, 8.0, 5.0)), F.lit(0.0)) / 5 * 20, F.lit(20.0))
    index = F.greatest(F.least((100 - rating) / 100 * 40 + steep + tall + F.when(water, 10.0).otherwise(0.0), F.lit(100.0)), F.lit(0.0))
    chance = F.when(index < 25, 0.05).when(index < 50, 0.15).when(index < 75, 0.40).otherwise(0.70)
    for present, more in ((faults, 0.20), (joints, 0.15)):
        if present is not None:
            chance = F.when(present, F.least(chance + more, F.lit(0.95))).otherwise(chance)
    return {"risk_index": index, "risk_class": F.when(index < 25, "Low").when(index < 50, "Moderate").when(index < 75, "High").otherwise("Very High"), "failure_probability": chance}


def support(rating: Column) -> dict[str, Column]:
    """bolts, spacing and mesh by rock mass rating. The five classes of support."""
    pick = lambda *values: F.when(rating >= 81, values[0]).when(rating >= 61, values[1]).when(rating >= 41, values[2]).when(rating >= 21, values[3]).otherwise(values[4])
    meshed = "Systematic bolts + mesh"
    return {"bolts": pick("Spot bolts", "Systematic bolts", meshed, meshed, meshed), "spacing": pick("2.5m", "1.5-2.0m", "1.0-1.5m", "1.0-1.5m", "1.0m"), "mesh": pick("No", "Optional", "Yes", "Yes", "Yes")}


def diluted(tonnes: Column, grade: Column, overbreak: float, contact_grade: float) -> tuple[Column, Column]:
    """Tonnes and grade with overbreak (a tenth of the volume a metre) of the contact's grade."""
    total = tonnes * (1 + overbreak * 0.1)
    return total, F.when(total > 0, (tonnes * grade + (total - tonnes) * contact_grade) / total).otherwise(grade)


def rockburst_index(hazard: Column, rating: Column, stress: Column, weights=(0.6, 0.3, 0.1), threshold: float = 60.0) -> Column:
    """Weighted hazard, rock mass and stress between 0 and 1; the rock mass counts rating / threshold below the threshold and a half from it on."""
    total = float(sum(weights))
    mass = F.when(rating < threshold, rating / threshold).otherwise(F.lit(0.5))
    return F.greatest(F.least((hazard * weights[0] + mass * weights[1] + stress * weights[2]) / total, F.lit(1.0)), F.lit(0.0))


def material(rating: Column) -> dict[str, Column]:
    """Friction angle, cohesion, unit weight and Hoek-Brown m, s, a of a rock mass by its geological strength index. The four classes."""
    pick = lambda *v: F.when(rating >= 75, v[0]).when(rating >= 50, v[1]).when(rating >= 25, v[2]).otherwise(v[3])
    weak = rating < 25
    return {
        "friction_angle": pick(45.0, 40.0, 35.0, 30.0),
        "cohesion": pick(500.0, 300.0, 150.0, 50.0),
        "unit_weight": pick(27.0, 26.0, 25.0, 24.0),
        "mb": F.when(weak, 0.1 * rating).otherwise(0.5 + 0.01 * rating),
        "s": F.when(weak, 0.001).otherwise(0.01 * (rating - 25) / 75),
        "a": F.when(weak, 0.5).otherwise(0.5 - 0.01 * (rating - 25) / 75),
    }


def spacing_rules(range_: Column, spacing: Column, least: float = 10.0, most: float = 500.0) -> dict[str, Column]:
    """Distances of the measured, indicated and inferred classes from a variogram's range and the holes' spacing: a quarter, two thirds and all of the range, not under 0.75, 1.5 and 2.5 spacings, the tighter class at most 0.8 of the next."""
    inside = lambda d: F.greatest(F.least(d, F.lit(most)), F.lit(least))
    m, i, f = (inside(F.greatest(k * range_, s * spacing)) for k, s in ((0.25, 0.75), (0.67, 1.5), (1.0, 2.5)))
    m = F.greatest(F.least(m, 0.8 * i), F.lit(least))
    return {"measured": m, "indicated": F.greatest(F.least(i, 0.8 * f), F.lit(least)), "inferred": f}

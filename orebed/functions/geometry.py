"""Orientations, rotations and projections as column expressions.

Axes are east (x), north (y), up (z); azimuths clockwise from north, angles in
degrees.  Poles point down (z <= 0).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rotation(azimuth: float, dip: float = 0.0, plunge: float = 0.0) -> list[list[float]]:
    """Rows of the matrix that turns the major axis (azimuth, dip) onto x and undoes the plunge about it."""
    a, d, p = (math.radians(v) for v in (azimuth, dip, plunge))
    major = [math.sin(a) * math.cos(d), math.cos(a) * math.cos(d), -math.sin(d)]
    side = [math.cos(a), -math.sin(a), 0.0]
    up = [math.sin(a) * math.sin(d), math.cos(a) * math.sin(d), math.cos(d)]
    semi = [math.cos(p) * s + math.sin(p) * u for s, u in zip(side, up)]
    minor = [math.cos(p) * u - math.sin(p) * s for s, u in zip(side, up)]
    return [major, semi, minor]


def rotated(x: Column, y: Column, z: Column, matrix: list[list[float]], origin=(0.0, 0.0, 0.0)) -> list[Column]:
    shifted = [c - F.lit(float(o)) for c, o in zip((x, y, z), origin)]
    return [sum((F.lit(m) * c for m, c in zip(row, shifted)), F.lit(0.0)) for row in matrix]


def unrotated(x: Column, y: Column, z: Column, matrix: list[list[float]], origin=(0.0, 0.0, 0.0)) -> list[Column]:
    back = [list(r) for r in zip(*matrix)]
    return [sum((F.lit(m) * c for m, c in zip(row, (x, y, z))), F.lit(0.0)) + F.lit(float(o)) for row, o in zip(back, origin)]


def anisotropic(x: Column, y: Column, z: Column, azimuth: float, dip: float, major: float, minor: float, vertical: float) -> list[Column]:
    """Coordinates in which distance 1 is the range in every direction."""
    return [c / F.lit(float(r)) for c, r in zip(rotated(x, y, z, rotation(azimuth, dip)), (major, minor, vertical))]


def pole(dip: Column, dip_direction: Column) -> list[Column]:
    """Downward unit normal of a plane."""
    d, a = F.radians(dip), F.radians(dip_direction)
    return [-F.sin(d) * F.sin(a), -F.sin(d) * F.cos(a), -F.cos(d)]


def dip_and_direction(nx: Column, ny: Column, nz: Column) -> list[Column]:
    """Dip and dip direction of the plane of a normal, whichever way it points."""
    flip = F.when(nz > 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    length = F.sqrt(nx * nx + ny * ny + nz * nz)
    return [F.degrees(F.acos(F.least(F.abs(nz) / length, F.lit(1.0)))), F.pmod(F.degrees(F.atan2(-flip * nx, -flip * ny)), F.lit(360.0))]


def lower_hemisphere(nx: Column, ny: Column, nz: Column) -> list[Column]:
    flip = F.when(nz > 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return [flip * nx, flip * ny, flip * nz]


def line(plunge: Column, trend: Column) -> list[Column]:
    p, t = F.radians(plunge), F.radians(trend)
    return [F.cos(p) * F.sin(t), F.cos(p) * F.cos(t), -F.sin(p)]


def plunge_and_trend(x: Column, y: Column, z: Column) -> list[Column]:
    flip = F.when(z > 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    length = F.sqrt(x * x + y * y + z * z)
    return [F.degrees(F.asin(F.least(F.abs(z) / length, F.lit(1.0)))), F.pmod(F.degrees(F.atan2(flip * x, flip * y)), F.lit(360.0))]


def angle_between(a: list[Column], b: list[Column]) -> Column:
    dot = sum((p * q for p, q in zip(a, b)), F.lit(0.0))
    return F.degrees(F.acos(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0))))


def strike(dip_direction: Column) -> Column:
    return F.pmod(dip_direction - 90, F.lit(360.0))


def axial(direction: Column) -> Column:
    return F.pmod(direction, F.lit(180.0))


def declined(direction: Column, declination: float) -> Column:
    return F.pmod(direction + F.lit(float(declination)), F.lit(360.0))


def schmidt(nx: Column, ny: Column, nz: Column) -> list[Column]:
    """Equal-area projection of the lower hemisphere onto the unit disc."""
    x, y, z = lower_hemisphere(nx, ny, nz)
    k = F.sqrt(1 / (1 - z))
    return [x * k, y * k]


def wulff(nx: Column, ny: Column, nz: Column) -> list[Column]:
    """Equal-angle projection of the lower hemisphere onto the unit disc."""
    x, y, z = lower_hemisphere(nx, ny, nz)
    return [x / (1 - z), y / (1 - z)]


def from_schmidt(x: Column, y: Column) -> list[Column]:
    r = x * x + y * y
    k = F.sqrt(2 - r)
    return [x * k, y * k, r - 1]


def from_wulff(x: Column, y: Column) -> list[Column]:
    r = x * x + y * y
    return [2 * x / (1 + r), 2 * y / (1 + r), (r - 1) / (1 + r)]


def in_polygon(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Ray casting as a parity expression over the polygon's edges."""
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(vertices, vertices[1:] + vertices[:1]):
        if ay != by:
            spans = (F.lit(ay) > y) != (F.lit(by) > y)
            at = F.lit(float(bx - ax)) * (y - F.lit(float(ay))) / F.lit(float(by - ay)) + F.lit(float(ax))
            crossings = crossings + F.when(spans & (x < at), 1).otherwise(0)
    return crossings % 2 == 1


def _core_frame(azimuth: Column, dip: Column) -> list[list[Column]]:
    """High side, third axis and direction of a hole (dip down negative), as rows; a hole within about 2.5 degrees of level has its high side to the north."""
    a, d = F.radians(azimuth), F.radians(-dip)
    hole = [F.sin(d) * F.sin(a), F.sin(d) * F.cos(a), -F.cos(d)]
    up = [-hole[2] * hole[0], -hole[2] * hole[1], 1 - hole[2] * hole[2]]
    length = F.sqrt(up[0] * up[0] + up[1] * up[1] + up[2] * up[2])
    north = (F.abs(F.cos(d)) > 0.999) | (length <= 1e-10)
    high = [F.when(north, F.lit(n)).otherwise(u / length) for u, n in zip(up, (0.0, 1.0, 0.0))]
    third = [hole[1] * high[2] - hole[2] * high[1], hole[2] * high[0] - hole[0] * high[2], hole[0] * high[1] - hole[1] * high[0]]
    size = F.sqrt(third[0] * third[0] + third[1] * third[1] + third[2] * third[2])
    return [high, [t / size for t in third], hole]


def from_core(alpha: Column, beta: Column, azimuth: Column, dip: Column) -> list[Column]:
    """Unit normal of a plane measured on oriented core: alpha from the core axis, beta clockwise from the high side."""
    al, be = F.radians(alpha), F.radians(beta)
    core = [F.sin(al) * F.cos(be), F.sin(al) * F.sin(be), F.cos(al)]
    frame = _core_frame(azimuth, dip)
    out = [core[0] * frame[0][k] + core[1] * frame[1][k] + core[2] * frame[2][k] for k in range(3)]
    size = F.sqrt(out[0] * out[0] + out[1] * out[1] + out[2] * out[2])
    return [c / size for c in out]


def to_core(nx: Column, ny: Column, nz: Column, azimuth: Column, dip: Column) -> list[Column]:
    """Alpha and beta of a unit normal in a hole."""
    high, third, hole = _core_frame(azimuth, dip)
    on = lambda axis: nx * axis[0] + ny * axis[1] + nz * axis[2]
    return [F.degrees(F.acos(F.greatest(F.least(on(hole), F.lit(1.0)), F.lit(-1.0)))), F.pmod(F.degrees(F.atan2(on(third), on(high))), F.lit(360.0))]


def great_circle(dip: Column, dip_direction: Column, points: int) -> Column:
    """An array of unit vectors (x, y, z) along the trace of a plane on the lower hemisphere, from one end of its strike to the other."""
    d, a = F.radians(dip), F.radians(dip_direction)
    along, down = [F.cos(a), -F.sin(a), F.lit(0.0)], [F.cos(d) * F.sin(a), F.cos(d) * F.cos(a), -F.sin(d)]

    def at(k: Column) -> Column:
        t = k * (math.pi / (points - 1))
        return F.struct(*((F.cos(t) * s + F.sin(t) * v).alias(c) for c, s, v in zip("xyz", along, down)))

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)


def small_circle(plunge: Column, trend: Column, angle: Column, points: int) -> Column:
    """An array of unit vectors (x, y, z) at ``angle`` degrees around an axis."""
    p, t, c = F.radians(plunge), F.radians(trend), F.radians(angle)
    axis = line(plunge, trend)
    side, up = [F.cos(t), -F.sin(t), F.lit(0.0)], [F.sin(p) * F.sin(t), F.sin(p) * F.cos(t), F.cos(p)]

    def at(k: Column) -> Column:
        w = k * (2 * math.pi / points)
        return F.struct(*((F.cos(c) * a + F.sin(c) * (F.cos(w) * s + F.sin(w) * u)).alias(n) for n, a, s, u in zip("xyz", axis, side, up)))

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)

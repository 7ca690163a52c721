"""Planar geometry over rings ARRAY<STRUCT<x, z>> and the national grid, as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the national grid (EPSG:3301): GRS80 ellipsoid, Lambert conformal conic with two parallels.
_A, _F = 6378137.0, 1 / 298.257222101
_LAT1, _LAT2, _LAT0, _LON0 = 58.0, 59.3333333333333, 57.5175539305556, 24.0
_FE, _FN = 500000.0, 6375000.0


def _e() -> float:
    return math.sqrt(2 * _F - _F * _F)


def _cone() -> tuple[float, float, float]:
    """Cone constant, scale and radius at the origin."""
    e = _e()
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    p1, p2, p0 = (math.radians(x) for x in (_LAT1, _LAT2, _LAT0))
    n = math.log(m(p1) / m(p2)) / math.log(t(p1) / t(p2))
    f = m(p1) / (n * t(p1) ** n)
    return n, f, _A * f * t(p0) ** n


def to_grid(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(easting, northing) of degrees."""
    n, f, r0 = _cone()
    e, p = _e(), F.radians(lat)
    s = F.sin(p) * e
    t = F.tan(F.lit(math.pi / 4) - p / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))
    r = F.lit(_A * f) * F.pow(t, F.lit(n))
    theta = F.lit(n) * (F.radians(lon) - math.radians(_LON0))
    return F.lit(_FE) + r * F.sin(theta), F.lit(_FN + r0) - r * F.cos(theta)


def from_grid(x: Column, y: Column, rounds: int = 8) -> tuple[Column, Column]:
    """(latitude, longitude) in degrees; the latitude by fixed-point rounds."""
    n, f, r0 = _cone()
    e = _e()
    dx, dy = x - _FE, F.lit(r0 + _FN) - y
    t = F.pow(F.sqrt(dx * dx + dy * dy) / (_A * f), F.lit(1 / n))
    p = F.lit(math.pi / 2) - 2 * F.atan(t)
    for _ in range(rounds):
        s = F.sin(p) * e
        p = F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(e / 2)))
    return F.degrees(p), F.degrees(F.atan2(dx, dy) / n) + _LON0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def square(x: Column, z: Column, side: Column) -> Column:
    """A ring of four corners."""
    at = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("z"))
    return F.array(at(x, z), at(x + side, z), at(x + side, z + side), at(x, z + side))


def _edges(ring: Column) -> Column:
    """The ring's edges as structs of both ends."""
    turned = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda a, b: F.struct(a.x.alias("ax"), a.z.alias("az"), b.x.alias("bx"), b.z.alias("bz")))


def signed_area(ring: Column) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e.ax * e.bz - e.bx * e.az)) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + F.sqrt((e.bx - e.ax) * (e.bx - e.ax) + (e.bz - e.az) * (e.bz - e.az)))


def mean_width(ring: Column) -> Column:
    p = perimeter(ring)
    return F.when(p > 0, 2 * area(ring) / p).otherwise(0.0)


def vertex_mean(ring: Column) -> Column:
    n = F.size(ring)
    total = lambda pick: F.aggregate(ring, F.lit(0.0), lambda s, p: s + pick(p))
    return F.struct((total(lambda p: p.x) / n).alias("x"), (total(lambda p: p.z) / n).alias("z"))


def envelope(ring: Column) -> Column:
    xs, zs = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.z)
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(zs).alias("zmin"), F.array_max(xs).alias("xmax"), F.array_max(zs).alias("zmax"))


def inside(x: Column, z: Column, ring: Column) -> Column:
    """Ray casting with half-open edges: a point on a shared edge belongs to one side only."""
    return F.aggregate(
        _edges(ring), F.lit(False),
        lambda odd, e: odd != (((e.az > z) != (e.bz > z)) & (x < (e.bx - e.ax) * (z - e.az) / F.when(e.bz == e.az, F.lit(1.0)).otherwise(e.bz - e.az) + e.ax)),
    )


def to_segment(px: Column, pz: Column, ax: Column, az: Column, bx: Column, bz: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dz = bx - ax, bz - az
    d2 = dx * dx + dz * dz
    u = F.when(d2 == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (pz - az) * dz) / F.when(d2 == 0, F.lit(1.0)).otherwise(d2))))
    x, z = px - (ax + u * dx), pz - (az + u * dz)
    return F.sqrt(x * x + z * z)


def to_outline(px: Column, pz: Column, ring: Column) -> Column:
    return F.array_min(F.transform(_edges(ring), lambda e: to_segment(px, pz, e.ax, e.az, e.bx, e.bz)))


def heading(dx: Column, dz: Column) -> Column:
    """Degrees of an axis, folded to 0..180."""
    return F.pmod(F.degrees(F.atan2(dz, dx)), F.lit(180.0))


def clip(ring: Column, xmin: float | Column, zmin: float | Column, xmax: float | Column, zmax: float | Column) -> Column:
    """The part of a ring inside a box: one pass over the edges for each side of the box."""

    def half(axis: str, at: float | Column, below: bool) -> Callable[[Column], Column]:
        def step(e: Column) -> Column:
            a, b = e[f"a{axis}"], e[f"b{axis}"]
            keep = lambda v: v <= at if below else v >= at
            u = ((at if isinstance(at, Column) else F.lit(at)) - a) / F.when(b == a, F.lit(1.0)).otherwise(b - a)
            cross = F.struct((e.ax + u * (e.bx - e.ax)).alias("x"), (e.az + u * (e.bz - e.az)).alias("z"))
            end = F.struct(e.bx.alias("x"), e.bz.alias("z"))
            return F.when(keep(a) & keep(b), F.array(end)).when(keep(a), F.array(cross)).when(keep(b), F.array(cross, end)).otherwise(F.array().cast("array<struct<x:double,z:double>>"))

        return lambda r: F.flatten(F.transform(_edges(r), step))

    for axis, at, below in (("x", xmin, False), ("x", xmax, True), ("z", zmin, False), ("z", zmax, True)):
        at = at.cast("double") if isinstance(at, Column) else float(at)
        ring = let(ring, half(axis, at, below))
    return ring


def storeys(eave: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(40), F.round(eave / 3.0).cast("int")))


def circle_radius(employees: Column) -> Column:
    """Radius of a company's circle, from 3 to 40."""
    return F.greatest(F.lit(3.0), F.least(F.lit(40.0), 3 + 2.2 * F.sqrt(F.coalesce(employees, F.lit(0)).cast("double"))))


def sheet_centre(c: Column, step: int = 1000) -> Column:
    """Middle of the map sheet that holds a coordinate; the middle itself stays."""
    return F.floor(c / step).cast("long") * step + step // 2


def photo_square(ring: Column, pad: float = 8.0, least: float = 60.0) -> Column:
    """STRUCT<x, z, span>: the square box around a ring, padded, and at least ``least`` wide."""
    e = envelope(ring)
    span = F.greatest(F.greatest(e.xmax - e.xmin, e.zmax - e.zmin) + 2 * pad, F.lit(least))
    return F.struct(((e.xmin + e.xmax) / 2 - span / 2).alias("x"), ((e.zmin + e.zmax) / 2 - span / 2).alias("z"), span.alias("span"))


def smoothstep(t: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return t * t * (3.0 - 2.0 * t)


def pond_depth(x: Column, z: Column, width: Column, length: Column, area: Column, deepest: float) -> Column:
    """Depth of a pond (box around its middle) at a place: rises smoothly over three metres from the edge, the more the larger it is."""
    edge = F.least(width / 2 - F.abs(x), length / 2 - F.abs(z))
    most = F.greatest(F.lit(0.7), F.least(F.lit(deepest), F.sqrt(area.cast("double")) / 18.0))
    return F.when(edge <= 0, 0.0).otherwise(most * smoothstep(edge / 3.0))


def arm_group(dx: Column, dz: Column, axis_x: Column, axis_z: Column) -> Column:
    """0 for arms of a junction along its axis (within 45 degrees, either way), 1 for those across; null without a direction."""
    dot = (dx * axis_x + dz * axis_z) / F.sqrt(((dx * dx + dz * dz) * (axis_x * axis_x + axis_z * axis_z)).cast("double"))
    return F.when(F.abs(dot) >= 0.7071, 0).when(dot.isNotNull(), 1)

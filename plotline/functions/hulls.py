"""Convex hulls and minimum rotated rectangles of rings ARRAY<STRUCT<x, z>>, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotline.functions import geometry as G


def _cross(a: Column, b: Column, c: Column) -> Column:
    return (b.x - a.x) * (c.z - a.z) - (b.z - a.z) * (c.x - a.x)


def _chain(points: Column) -> Column:
    """One side of the hull of points in order: a new point drops those at the chain's end that no longer turn left. They are a
    suffix, as the chain is convex, so each point looks at its own turn only."""
    none = F.array().cast("array<struct<x:double,z:double>>")

    def add(chain: Column, p: Column) -> Column:
        stays = F.filter(chain, lambda q, k: (k == 0) | (_cross(F.get(chain, k - 1), q, p) > 0))
        return F.concat(stays, F.array(p))

    return F.aggregate(points, none, add)


def convex_hull(ring: Column) -> Column:
    """The hull's vertices, counter-clockwise (x to the right, z up), from the least (x, z) on. Points within an edge are no vertices.
    One or two different points are their own hull; a null or empty ring has an empty one."""
    none = F.array().cast("array<struct<x:double,z:double>>")
    points = F.transform(F.coalesce(ring, none), lambda q: F.struct(q.x.cast("double").alias("x"), q.z.cast("double").alias("z")))
    open_end = lambda c: F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))
    both = lambda p: F.concat(G.let(_chain(p), open_end), G.let(_chain(F.reverse(p)), open_end))
    return G.let(F.array_sort(F.array_distinct(points)), lambda p: F.when(F.size(p) < 3, p).otherwise(both(p)))


def rotated_rectangle(ring: Column) -> Column:
    """STRUCT<x, z, length, width, heading, fill, ux, uz>: the smallest rectangle around a ring. One of its sides lies on an edge of the
    hull, so each of them is tried. ``heading`` is that of the long side, in degrees from 0 (towards -z) clockwise, below 180;
    (ux, uz) is its direction; ``fill`` is the ring's share of the rectangle (0 if that has no area). Of equally small rectangles the one with the least heading
    counts. Null for rings without two different points."""
    def laid_on(e: Column) -> Column:
        dx, dz = e.bx - e.ax, e.bz - e.az
        size = F.sqrt(dx * dx + dz * dz)
        return F.struct((dx / size).alias("ux"), (dz / size).alias("uz"))

    def extents(u: Column, points: Column) -> Column:
        s, t = F.transform(points, lambda p: p.x * u.ux + p.z * u.uz), F.transform(points, lambda p: p.z * u.ux - p.x * u.uz)
        return F.struct(u.ux.alias("ux"), u.uz.alias("uz"), F.array_min(s).alias("s0"), F.array_max(s).alias("s1"), F.array_min(t).alias("t0"), F.array_max(t).alias("t1"))

    def candidate(b: Column) -> Column:
        along, across = b.s1 - b.s0, b.t1 - b.t0
        is_long = along >= across - 1e-9
        ux, uz = F.when(is_long, b.ux).otherwise(-b.uz), F.when(is_long, b.uz).otherwise(b.ux)
        turned = F.pmod(F.degrees(F.atan2(ux, -uz)), F.lit(180.0))
        heading = F.when(turned > 180 - 1e-7, 0.0).otherwise(turned)
        s, t = (b.s0 + b.s1) / 2, (b.t0 + b.t1) / 2
        return F.struct(
            F.round(along * across, 6).alias("k"), F.round(heading, 6).alias("h"), (s * b.ux - t * b.uz).alias("x"), (s * b.uz + t * b.ux).alias("z"),
            F.greatest(along, across).alias("length"), F.least(along, across).alias("width"), heading.alias("heading"), ux.alias("ux"), uz.alias("uz"),
        )

    def smallest(hull: Column) -> Column:
        edges = F.transform(G._edges(hull), laid_on)
        return F.when(F.size(hull) > 1, F.array_min(F.transform(F.transform(edges, lambda u: extents(u, hull)), candidate)))

    def filled(best: Column) -> Column:
        whole = best["length"] * best["width"]
        fill = F.when(whole > 0, G.area(ring) / F.when(whole > 0, whole)).otherwise(0.0)
        return F.when(best.isNotNull(), F.struct(*(best[c].alias(c) for c in ("x", "z", "length", "width", "heading")), fill.alias("fill"), best["ux"].alias("ux"), best["uz"].alias("uz")))

    return G.let(G.let(convex_hull(ring), smallest), filled)

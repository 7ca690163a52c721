"""Rectangles, roofs and blob axes against plain versions."""

import math

import numpy as np
from pyspark.sql import functions as F

from plotline.functions.hulls import convex_hull, rotated_rectangle
from plotline.operators import roofs

RING = "id long, ring array<struct<x:double,z:double>>"


def cross(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def plain_hull(points):
    """Gift wrapping."""
    p = sorted(set(points))
    if len(p) < 3:
        return p
    out, now = [], p[0]
    while True:
        out.append(now)
        nxt = next(q for q in p if q != now)
        for q in p:
            c = cross(now, nxt, q)
            if q != now and (c < 0 or (c == 0 and math.dist(now, q) > math.dist(now, nxt))):
                nxt = q
        now = nxt
        if now == out[0]:
            return out


def plain_rectangle(points):
    """(area, heading, x, z, length, width) over the directions of all pairs of points that are a side of them all."""
    best = None
    for a in points:
        for b in points:
            if a == b or any(cross(a, b, c) < -1e-9 for c in points):
                continue
            n = math.dist(a, b)
            u = ((b[0] - a[0]) / n, (b[1] - a[1]) / n)
            s, t = [p[0] * u[0] + p[1] * u[1] for p in points], [p[1] * u[0] - p[0] * u[1] for p in points]
            w, h = max(s) - min(s), max(t) - min(t)
            long = u if w >= h - 1e-9 else (-u[1], u[0])
            heading = math.degrees(math.atan2(long[0], -long[1])) % 180
            heading = 0.0 if heading > 180 - 1e-7 else heading
            ms, mt = (max(s) + min(s)) / 2, (max(t) + min(t)) / 2
            row = (round(w * h, 6), round(heading, 6), ms * u[0] - mt * u[1], ms * u[1] + mt * u[0], max(w, h), min(w, h))
            best = min(best or row, row)
    return best


def test_hull_and_rectangle(spark):
    rng = np.random.default_rng(3)
    rings = [[tuple(map(float, p)) for p in rng.integers(0, 12, (int(rng.integers(1, 25)), 2))] for _ in range(60)]
    rings += [[(math.cos(k) * 9, math.sin(k) * 5) for k in rng.random(30) * 7] for _ in range(5)]
    rings += [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0)] * 4, [(0.0, 0.0), (1.0, 1.0), (3.0, 3.0)], []]
    rows = spark.createDataFrame([*enumerate(rings), (len(rings), None)], RING)
    got = {r.id: r for r in rows.select("id", convex_hull(F.col("ring")).alias("h"), rotated_rectangle(F.col("ring")).alias("r")).collect()}
    for i, ring in enumerate(rings):
        hull = [tuple(p) for p in got[i].h]
        assert hull == plain_hull(ring)
        want = plain_rectangle(ring) if len(hull) > 1 else None
        if want is None:
            assert got[i].r is None
            continue
        r = got[i].r
        assert np.allclose([r.length * r.width, r.heading, r.x, r.z, r.length, r.width], want, atol=1e-5)
        area = abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2
        assert abs(r.fill - (area / (r.length * r.width) if r.length * r.width > 0 else 0)) < 1e-9
    assert got[len(rings)].r is None and got[len(rings)].h == []


def test_roofs(spark):
    """Houses of known form; one without enough cells, one too ragged, one too flat, one too narrow."""
    rng = np.random.default_rng(1)
    cells, feet, want = {}, [], {}
    forms = [("flat", 0.0), ("gable_long", 0.0), ("gable_short", 30.0), ("hip", 65.0), ("gable_long", 100.0), ("hip", 0.0)]
    for k, (kind, turn) in enumerate(forms):
        cx, cz, length, width, a = 40.0 * k + 20, 20.0, 18.0, 10.0, math.radians(turn)
        corner = lambda s, t: (cx + s * math.cos(a) - t * math.sin(a), cz + s * math.sin(a) + t * math.cos(a))  # noqa: B023, E731
        feet.append((k, [corner(s * length / 2, t * width / 2) for s, t in ((-1, -1), (1, -1), (1, 1), (-1, 1))]))
        for x in range(int(cx) - 15, int(cx) + 15):
            for z in range(5, 35):
                dx, dz = x + 0.5 - cx, z + 0.5 - cz
                s, t = dx * math.cos(a) + dz * math.sin(a), dz * math.cos(a) - dx * math.sin(a)
                side, end = 1 - abs(t) / (width / 2), 1 - abs(s) / (length / 2)
                hip = max(0, min(side, (length / 2 - abs(s)) / (width / 2)))
                cells[x, z] = 3 + {"flat": 2.0, "gable_long": 4 * side, "gable_short": 4 * end, "hip": 4 * hip}[kind] + rng.random() * 0.1
        want[k] = kind
    box = lambda x, z, w, d: [(x, z), (x + w, z), (x + w, z + d), (x, z + d)]
    feet += [(10, box(300.0, 0.0, 3.0, 3.0)), (11, box(400.0, 0.0, 20.0, 3.0)), (12, [(500.0, 0.0), (520.0, 0.0), (520.0, 4.0), (504.0, 4.0), (504.0, 20.0), (500.0, 20.0)]), (13, []), (14, [(0.0, 0.0)])]
    for x0, w, d in ((300, 3, 3), (400, 20, 3), (500, 20, 20)):
        cells |= {(x0 + x, z): 3.0 + min(x, w - x) for x in range(w) for z in range(d)}
    rows = spark.createDataFrame([(1, z, x, float(v)) for (x, z), v in cells.items()] + [(1, 0, 900, None), (2, 0, 300, 9.0)], "tile long, y long, x long, v double")
    prints = spark.createDataFrame([(1, i, ring) for i, ring in feet], "tile long, shape long, ring array<struct<x:double,z:double>>")
    got = {r.shape: r for r in roofs.fit_roofs(prints, rows).collect()}
    assert {k: got[k].kind for k in want} == want
    assert set(got) == {*want, 11, 12} and got[11].kind == got[12].kind == "flat"
    assert all(got[k].error < 0.35 and 6 < got[k].ridge < 7.2 and 2.9 < got[k].eave < 4.4 for k in range(1, 6))
    assert roofs.fit_roofs(prints.limit(0), rows).count() == 0


def test_blob_axes(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for label in range(12):
        a, n = rng.random() * math.pi, 200
        s, t = rng.normal(size=n) * 9, rng.normal(size=n) * 2
        x, y = np.round(s * np.cos(a) - t * np.sin(a)).astype(int) + 100, np.round(s * np.sin(a) + t * np.cos(a)).astype(int) + 100
        pix = sorted(set(zip(y.tolist(), x.tolist(), strict=True)))
        ys, xs = np.array(pix, float).T
        values, vectors = np.linalg.eigh(np.cov(np.vstack([xs, ys])))
        want[label] = (xs.mean(), ys.mean(), 4 * math.sqrt(values[1]) + 2, math.degrees(math.atan2(*vectors[:, 1])) % 180)
        rows += [(1, y, x, label) for y, x in pix]
    rows += [(1, 0, 0, 90), (1, 0, 1, 90), *((1, y, 5, 91) for y in range(4))]
    got = {r.label: r for r in roofs.blob_axes(spark.createDataFrame(rows, "tile long, y long, x long, label long"), 1).collect()}
    assert 90 not in got and got[91].heading == 0.0
    for label, w in want.items():
        r = got[label]
        assert np.allclose([r.x, r.y, r.length], w[:3]) and min(abs(r.heading - w[3]), 180 - abs(r.heading - w[3])) < 1e-4

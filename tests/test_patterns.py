"""Holes, touching blobs, stripes, regions and outlines against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotline.functions import geometry as G
from plotline.operators import patterns, raster, regions

RING = "ring array<struct<x:double,z:double>>"


def test_fill_holes(spark):
    rng = np.random.default_rng(1)
    size, reach = 14, 4
    v = rng.integers(0, 50, (2, size, size)).astype(float)
    v[rng.random(v.shape) < 0.6] = np.nan
    v[1, 4:, :] = np.nan
    rows = [(t, y, x, None if math.isnan(v[t, y, x]) and (x + y) % 2 else float(v[t, y, x])) for t in range(2) for y in range(size) for x in range(size) if not math.isnan(v[t, y, x]) or (x + y) % 3]
    rows += [(0, 3, size, 9.0), (0, -1, 2, 9.0), (7, 0, 0, None), (8, 1, 1, float("inf"))]
    got = {(r.tile, r.y, r.x): (r.v, r.filled) for r in raster.fill_holes(spark.createDataFrame(rows, "tile long, y long, x long, v double").repartition(3), size, reach).collect()}
    assert len(got) == 2 * size * size
    for t in range(2):
        for y in range(size):
            for x in range(size):
                if not math.isnan(v[t, y, x]):
                    assert got[t, y, x] == (v[t, y, x], False)
                    continue
                near = []
                for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
                    for k in range(1, reach + 1):
                        a, b = y + dy * k, x + dx * k
                        if 0 <= a < size and 0 <= b < size and not math.isnan(v[t, a, b]):
                            near.append((k, v[t, a, b]))
                            break
                want = sum(z / k for k, z in near) / sum(1 / k for k, _ in near) if near else float(np.nanmedian(v[t]))
                assert got[t, y, x][1] and abs(got[t, y, x][0] - want) < 1e-9
    assert raster.fill_holes(spark.createDataFrame([], "tile long, y long, x long, v double"), size, reach).count() == 0


def plain_parts(cells):
    """8-connected components of a set."""
    left, out = set(cells), []
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            y, x = todo.pop()
            for q in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if q in left:
                    left.remove(q)
                    part.add(q)
                    todo.append(q)
        out.append(part)
    return out


def plain_split(cells, most, least, steps=4):
    for e in range(1, steps + 1):
        cells = {(y, x) for y, x in cells if all((y + a, x + b) in cells for a in (-1, 0, 1) for b in (-1, 0, 1))}
        parts = [p for p in plain_parts(cells) if len(p) >= max(1, least // (e + 1))]
        if not parts:
            return set()
        if len(parts) >= 2 and all(len(p) <= most for p in parts):
            return {(frozenset(p), e) for p in parts}
    return set()


def test_split_blobs(spark):
    disc = lambda cy, cx, r: {(y, x) for y in range(cy - r, cy + r + 1) for x in range(cx - r, cx + r + 1) if (y - cy) ** 2 + (x - cx) ** 2 <= r * r}
    rng = np.random.default_rng(3)
    blobs = [disc(10, 10, 6) | disc(10, 20, 6), disc(10, 10, 3) | disc(10, 30, 3) | {(10, x) for x in range(10, 30)}, disc(10, 10, 6), {(0, 0)}, {(0, x) for x in range(30)}, disc(20, 20, 9) | disc(20, 35, 9), disc(9, 9, 4) | disc(9, 16, 4) | disc(16, 9, 4)]
    blobs += [set().union(*(disc(int(y), int(x), int(r)) for y, x, r in zip(rng.integers(5, 30, 4), rng.integers(5, 30, 4), rng.integers(2, 6, 4), strict=True))) for _ in range(12)]
    rows = [(1, i, y, x) for i, b in enumerate(blobs) for y, x in b] + [(2, 0, y, x) for y, x in blobs[0]]
    got = {}
    for r in patterns.split_blobs(spark.createDataFrame(rows + rows[:5], "tile long, label long, y long, x long").repartition(3), 120, 6).collect():
        got.setdefault((r.tile, r.label), {}).setdefault((r.part, r.eroded), set()).add((r.y, r.x))
    want = {(1, i): plain_split(b, 120, 6) for i, b in enumerate(blobs)} | {(2, 0): plain_split(blobs[0], 120, 6)}
    assert {k: {(frozenset(p), e) for (_, e), p in v.items()} for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert want[1, 0] and want[1, 1] and not want[1, 2]
    assert patterns.split_blobs(spark.createDataFrame([], "tile long, label long, y long, x long"), 120, 6).count() == 0


def test_stripes(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for i, (period, angle) in enumerate([(5.0, 0.0), (7.5, 90.0), (4.0, 30.0), (6.0, 120.0)]):
        a = math.radians(angle - 90)
        for y in range(60):
            for x in range(60):
                rows.append((i, y + 7, x - 3, math.cos(2 * math.pi / period * (x * math.cos(a) + y * math.sin(a))) * 50 + rng.normal() * 5))
        want[i] = (period, angle)
    rows += [(10, y, x, rng.normal()) for y in range(60) for x in range(60)] + [(11, 0, x, math.cos(x)) for x in range(150)] + [(12, y, x, 3.0) for y in range(30) for x in range(30)] + [(0, 7, -3, None), (13, 0, 0, float("nan"))]
    got = {r["shape"]: r for r in patterns.stripes(spark.createDataFrame(rows, "shape long, y long, x long, v double").repartition(3), 1.0).collect()}
    assert set(got) == set(want)
    for i, (period, angle) in want.items():
        assert abs(got[i].period - period) < 0.3 and min(abs(got[i].angle - angle), 180 - abs(got[i].angle - angle)) < 4


def test_clip_by_columns(spark):
    rng = np.random.default_rng(8)
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 4.0), (4.0, 4.0), (4.0, 9.0), (0.0, 9.0)]
    boxes = [(i, *map(float, np.sort(rng.random(2)) * 12 - 1), *map(float, np.sort(rng.random(2)) * 12 - 1)) for i in range(40)]
    rows = spark.createDataFrame([(i, ring, x0, z0, x1, z1) for i, x0, x1, z0, z1 in boxes], f"id long, {RING}, x0 double, z0 double, x1 double, z1 double")
    over = lambda b, box: max(0, min(b[2], box[2]) - max(b[1], box[0])) * max(0, min(b[4], box[3]) - max(b[3], box[1]))
    for r in rows.select("id", G.area(G.clip(F.col("ring"), F.col("x0"), F.col("z0"), F.col("x1"), F.col("z1"))).alias("a")).collect():
        assert abs(r.a - over(boxes[r.id], (0, 0, 10, 4)) - over(boxes[r.id], (0, 4, 4, 9))) < 1e-9


def test_shares_and_neighbours(spark):
    land = spark.createDataFrame([("a", [(0.0, 0.0), (50.0, 0.0), (50.0, 100.0), (0.0, 100.0)]), ("b", [(50.0, 0.0), (100.0, 0.0), (100.0, 100.0), (50.0, 100.0)]), ("c", [(0.0, 100.0), (100.0, 100.0), (100.0, 101.0), (0.0, 101.0)]), ("d", [(1.0, 1.0)])], f"country string, {RING}")
    tiles = spark.createDataFrame([(1, "a", 40.0, 0.0, 60.0, 20.0), (2, "c", 40.0, 90.0, 60.0, 110.0), (3, "a", 0.0, 0.0, 10.0, 10.0), (4, "a", 0.0, 99.0, 10.0, 200.0), (5, "a", 500.0, 0.0, 510.0, 10.0), (6, "b", 49.0, -100.0, 149.0, 0.5)], "tile long, country string, xmin double, zmin double, xmax double, zmax double")
    for size in (7.0, 64.0, 1000.0):
        got = {(r.tile, r.country): round(r.share, 9) for r in regions.shares(tiles.drop("country"), land, size).collect()}
        assert got == {(1, "a"): 0.5, (1, "b"): 0.5, (2, "a"): 0.25, (2, "b"): 0.25, (2, "c"): 0.05, (3, "a"): 1.0, (4, "a"): round(10 / 1010, 9), (4, "c"): round(10 / 1010, 9), (6, "a"): round(0.5 / 10050, 9), (6, "b"): round(25 / 10050, 9)}
        near = {r.tile: (r.other, round(r.share, 6)) for r in regions.main_neighbour(tiles, land, 0.01, size).collect()}
        assert near == {1: ("b", 0.5), 2: ("a", 0.25)}
    assert regions.shares(tiles.drop("country").limit(0), land).count() == 0


def plain_inside(p, ring):
    odd = False
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        odd ^= (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]
    return odd


@pytest.mark.parametrize("tolerance", [0.0, 0.5])
def test_outlines(spark, tolerance):
    box = lambda x, z, w=1, d=1, turn=False: [(float(a), float(b)) for a, b in ([(x, z), (x + w, z), (x + w, z + d), (x, z + d)][:: -1 if turn else 1])]
    units = [("one", box(0, 0)), ("one", box(1, 0, turn=True)), ("one", box(5, 5)), ("one", box(9, 9, 0.5, 0.5)), ("one", box(0, 0))]
    units += [("ring", box(x, z)) for x in range(4) for z in range(4) if (x, z) not in ((1, 1), (2, 1))]
    units += [("corner", box(0, 0)), ("corner", box(1, 1)), ("corner", []), ("corner", None)]
    rng = np.random.default_rng(5)
    grid = rng.random((12, 12)) < 0.6
    units += [("many", box(x, z, turn=bool((x + z) % 2))) for x in range(12) for z in range(12) if grid[x, z]]
    got = {}
    for r in regions.outlines(spark.createDataFrame(units, f"region string, {RING}").repartition(4), tolerance, 0.5).collect():
        got.setdefault(r.region, []).append((r.rank, r.area, [tuple(p) for p in r.ring]))
    got = {k: sorted(v) for k, v in got.items()}
    assert [(k, a) for k, a, _ in got["one"]] == [(1, 2.0), (2, 1.0)] and [a for _, a, _ in got["ring"]] == [16.0] and [a for _, a, _ in got["corner"]] == [1.0, 1.0]
    if tolerance:
        assert len(got["ring"][0][2]) == 4 and len(got["one"][0][2]) == 4
        return
    assert set(got["one"][0][2]) == {(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0), (0.0, 1.0)}
    # Outer rings of the grid: they cover its cells and their holes, and nothing outside.
    rings = [r for _, _, r in got["many"]]
    open_air = {(-1, -1)}
    todo = [(-1, -1)]
    while todo:
        x, z = todo.pop()
        for q in ((x + 1, z), (x - 1, z), (x, z + 1), (x, z - 1), (x + 1, z + 1), (x - 1, z - 1), (x + 1, z - 1), (x - 1, z + 1)):
            if -1 <= q[0] <= 12 and -1 <= q[1] <= 12 and q not in open_air and not (0 <= q[0] < 12 and 0 <= q[1] < 12 and grid[q]):
                if abs(q[0] - x) + abs(q[1] - z) == 1:
                    open_air.add(q)
                    todo.append(q)
    for x in range(12):
        for z in range(12):
            if grid[x, z]:
                assert any(plain_inside((x + 0.5, z + 0.5), r) for r in rings)
            elif (x, z) in open_air:
                assert not any(plain_inside((x + 0.5, z + 0.5), r) for r in rings)
    for _, a, r in got["many"]:
        assert abs(a - sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:] + r[:1], strict=True)) / 2) < 1e-9

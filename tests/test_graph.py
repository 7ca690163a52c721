"""Snapped graphs against union-find, and parallel twins against all pairs."""

import math

import numpy as np

from plotline.operators import graph

LINES = "tile long, rid long, kind string, line array<struct<x:double,z:double>>"


def clusters(points, radius=1.0):
    """The least member of each point's cluster."""
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for p in points:
        for q in points:
            if p[0] == q[0] and math.dist(p[1:], q[1:]) < radius:
                a, b = sorted((find(p), find(q)))
                root[b] = a
    return {p: find(p) for p in points}


def test_snapped_equals_union_find(spark):
    rng = np.random.default_rng(2)
    pts = {(int(rng.integers(2)), float(x), float(z)) for x, z in np.round(rng.random((300, 2)) * 18, 2)}
    pts |= {(3, 0.7 * i, -0.3 * i) for i in range(60)}  # a chain over many cells
    pts |= {(4, 0.0, 0.0), (4, 1.0, 0.0), (4, 0.0, 0.999), (5, -0.5, -0.5), (5, 0.4, 0.1)}
    got = {(r.tile, r.x, r.z): (r.tile, r.nx, r.nz) for r in graph.snapped(spark.createDataFrame([*pts, *list(pts)[:20]], "tile long, x double, z double").repartition(3)).collect()}
    assert got == clusters(sorted(pts))


def test_build_graph(spark):
    rng = np.random.default_rng(4)
    rows = [(1, i, "road", [tuple(map(float, np.round(rng.random(2) * 12, 2))) for _ in range(int(rng.integers(0, 5)))]) for i in range(60)]
    rows += [(2, 100, "road", [(0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (0.2, 0.2)]), (2, 101, "road", [(1.0, 1.0), (1.0, 1.0), (4.0, 1.0)]), (2, 102, "road", [(1.0, 1.0), (1.5, 1.0)])]
    nodes, edges = graph.build_graph(spark.createDataFrame(rows, LINES))
    length = lambda p: sum(math.dist(a, b) for a, b in zip(p, p[1:], strict=False))
    kept = {i: (t, p) for t, i, _, p in rows if len(p) > 1 and length(p) >= 2}
    ends = [(t, *q) for t, p in kept.values() for q in (p[0], p[-1])]
    node = clusters(sorted(set(ends)))
    arms = {}
    for e in ends:
        arms[node[e]] = arms.get(node[e], 0) + 1
    assert {(r.tile, r.x, r.z): r.arms for r in nodes.collect()} == arms
    got = {r.rid: r for r in edges.collect()}
    assert set(got) == set(kept)
    for i, (t, p) in kept.items():
        r = got[i]
        assert (r.ax, r.az) == node[t, *p[0]][1:] and (r.bx, r.bz) == node[t, *p[-1]][1:] and abs(r.length - length(p)) < 1e-9
        left, want = length(p) / 2, None
        for a, b in zip(p, p[1:], strict=False):
            n = math.dist(a, b)
            if want is None and n > 0 and left <= n + 1e-12:
                want = (a[0] + left / n * (b[0] - a[0]), a[1] + left / n * (b[1] - a[1]))
            left -= n
        assert math.dist(want, (r.mx, r.mz)) < 1e-6
    assert [t.count() for t in graph.build_graph(spark.createDataFrame([], LINES))] == [0, 0]


def plain_directions(rows):
    def mid(p):
        left = sum(math.dist(a, b) for a, b in zip(p, p[1:], strict=False)) / 2
        for a, b in zip(p, p[1:], strict=False):
            n = math.dist(a, b)
            if n > 0 and left <= n:
                u = ((b[0] - a[0]) / n, (b[1] - a[1]) / n)
                return (a[0] + left * u[0], a[1] + left * u[1]), u
            left -= n

    out = {}
    for t, i, kind, p in rows:
        m, u = mid(p)
        seen = set()
        for side in (-1, 1):
            for o in (2.4, 3.0, 3.6, 4.2, 4.8):
                q = (m[0] - u[1] * side * o, m[1] + u[0] * side * o)
                for t2, j, kind2, p2 in rows:
                    for a, b in zip(p2, p2[1:], strict=False):
                        n = math.dist(a, b)
                        if (t, kind) != (t2, kind2) or i == j or n == 0 or abs((b[0] - a[0]) * u[0] + (b[1] - a[1]) * u[1]) < 0.9 * n:
                            continue
                        k = max(0, min(1, ((q[0] - a[0]) * (b[0] - a[0]) + (q[1] - a[1]) * (b[1] - a[1])) / n**2))
                        if math.dist(q, (a[0] + k * (b[0] - a[0]), a[1] + k * (b[1] - a[1]))) < 0.5:
                            seen.add(side)
        out[i] = {(-1,): 1, (1,): -1}.get(tuple(sorted(seen)), 0)
    return out


def test_directions_equal_all_pairs(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(80):
        a, turn = rng.random(2) * 50, rng.integers(0, 4) * math.pi / 2 + rng.normal() * 0.15
        line = [a + k * 12 * np.array([math.cos(turn), math.sin(turn)]) + rng.normal(size=2) * 0.3 for k in range(3)]
        rows.append((int(rng.integers(2)), i, "ab"[int(rng.integers(2))], [tuple(map(float, p)) for p in line]))
    want = plain_directions(rows)
    assert {-1, 0, 1} == set(want.values())
    assert {r.rid: r.allowed for r in graph.allowed_directions(spark.createDataFrame(rows, LINES).repartition(3)).collect()} == want

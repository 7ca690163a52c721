"""Operators without SQL against plain versions."""

import math
import statistics

import numpy as np
import pytest

from plotline.functions import text as T
from plotline.operators import links, raster, spatial


def test_thinned_stops_keep_the_first(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(2)), i, "ab"[int(rng.integers(2))], [None, "x", "y"][int(rng.integers(3))], int(rng.integers(120)), int(rng.integers(60))) for i in range(300)]
    rows += [(5, 1000 + i, "tram", "line", 14 * i, 0) for i in range(9)]  # a chain in which every other stop stays
    kept = []
    for r in sorted(rows, key=lambda r: r[1]):
        if not any(k[0] == r[0] and k[2] == r[2] and k[3] == r[3] and math.dist(k[4:], r[4:]) < 15 for k in kept):
            kept.append(r)
    got = spatial.thinned_stops(spark.createDataFrame(rows, "tile long, id long, kind string, name string, x long, z long"), 15.0)
    assert sorted(r.id for r in got.collect()) == [r[1] for r in kept]
    assert spatial.thinned_stops(got.limit(0), 15.0).count() == 0


def test_blob_shapes(spark):
    rng = np.random.default_rng(7)
    on = rng.random((2, 30, 30)) < 0.45
    v = rng.integers(0, 50, on.shape).astype(float)
    seen, want = np.zeros(on.shape, bool), []
    for t, y, x in zip(*np.nonzero(on)):
        if seen[t, y, x]:
            continue
        todo, blob = [(y, x)], []
        seen[t, y, x] = True
        while todo:
            a, b = todo.pop()
            blob.append((a, b))
            for c in range(max(a - 1, 0), min(a + 2, 30)):
                for d in range(max(b - 1, 0), min(b + 2, 30)):
                    if on[t, c, d] and not seen[t, c, d]:
                        seen[t, c, d] = True
                        todo.append((c, d))
        ys, xs = zip(*blob)
        box = (max(xs) - min(xs) + 1) * (max(ys) - min(ys) + 1)
        want.append((int(t), len(blob), min(xs), max(xs), min(ys), max(ys), round(len(blob) / box, 6), statistics.median(float(v[t, a, b]) for a, b in blob)))
    cells = spark.createDataFrame([(int(t), int(y), int(x), float(v[t, y, x]), bool(on[t, y, x])) for t, y, x in np.ndindex(on.shape)], "tile long, y long, x long, v double, one boolean")
    got = raster.blob_shapes(raster.components(cells.where("one").select("tile", "y", "x")), cells.drop("one")).collect()
    assert sorted((r.tile, r.n, r.x0, r.x1, r.y0, r.y1, round(r.fill, 6), r["median"]) for r in got) == sorted(want)


@pytest.mark.parametrize("block", [1000, 3])
def test_pairs_block_by_block(spark, monkeypatch, block):
    monkeypatch.setattr(links, "BLOCK", block)
    rows = [(g, f"i{k}") for g, n in (("a", 11), ("b", 1), ("c", 4)) for k in range(n)]
    got = links.pairs_within(spark.createDataFrame(rows, "g string, item string"), "g", "item").collect()
    want = {(g, a, b) for g, a in rows for h, b in rows if g == h and a < b}
    assert len(got) == len(want) and {(r.g, r.a, r.b) for r in got} == want


def test_address_forms(spark):
    forms = ["15", "13 A", "13a", "16-18", "16–40", "5-4", "", None, "x"]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "i long, f string")
    got = {r.i: r.v for r in rows.select("i", T.house_forms(rows.f).alias("v")).collect()}
    assert [got[i] for i in range(len(forms)) if forms[i] is not None] == [["15"], ["13a", "13"], ["13a", "13"], ["16", "18", "17"], ["16", "40"], ["5", "4"], [], []]
    lv = ["Kaļķu iela 15 - 8", "Tirgoņu iela 11/13;15", "Republikas laukums 2A", "Pils iela 4, ist.nr. 3", "Mežā", ";;"]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(lv)], "i long, f string")
    got = {r.i: [tuple(k) for k in r.v] for r in rows.select("i", T.lv_address_keys(rows.f).alias("v")).collect()}
    assert got == {0: [("kaļķu iela", "15")], 1: [("tirgoņu iela", "11/13"), ("tirgoņu iela", "15")], 2: [("republikas laukums", "2a")], 3: [("pils iela", "4")], 4: [], 5: []}

"""Components and splits of many groups of cells at once, over the edges of squares and of batches, in few jobs."""

import numpy as np
import pyarrow as pa

from plotline.functions import cells as C
from plotline.operators import patterns, raster

MASK = "tile struct<a:int,b:string>, y int, x long"


def plain(cells):
    """{cell: the least cell of its 8-connected component}"""
    left, found = set(cells), {}
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            y, x = todo.pop()
            part.add((y, x))
            around = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= around
            todo += around
        found |= dict.fromkeys(part, min(part))
    return found


def random_masks(seed):
    rng = np.random.default_rng(seed)
    snake = {(y, x) for y in range(0, 21, 2) for x in range(-9, 12)} | {(y, 11 if y % 4 == 1 else -9) for y in range(1, 20, 2)}
    return [{(int(y) - 13, int(x) - 11) for y, x in np.argwhere(rng.random((27, 23)) < share)} for share in (0.2, 0.35, 0.5, 0.8)] + [snake, {(0, 0)}, {(0, -(1 << 31)), (0, (1 << 31) - 1), (1, -(1 << 31))}]


def test_components_over_edges_of_squares(spark, monkeypatch):
    masks = random_masks(1)
    rows = [((i, "t"), y, x) for i, m in enumerate(masks) for y, x in m] + [((0, "t"), None, 3), ((0, "t"), 3, None), (None, 1, 1)]
    df = spark.createDataFrame(rows + rows[:40], MASK)
    for bits in (1, 3, 9):
        monkeypatch.setattr(raster, "SQUARE", bits, raising=False)
        found = raster.components(df)
        assert [t for _, t in found.dtypes] == [t for _, t in df.dtypes] + ["bigint"]
        want = {(i, *cell, (y << 32) + x) for i, m in enumerate(masks) for cell, (y, x) in plain(m).items()}
        got = [(r.tile.a, r.y, r.x, r.label) for r in found.collect()]
        assert len(got) == len(want) and set(got) == want


def test_large_blobs_are_split_alike(spark, monkeypatch):
    rng = np.random.default_rng(2)
    disc = lambda y0, x0, r: {(y, x) for y in range(y0 - r, y0 + r + 1) for x in range(x0 - r, x0 + r + 1) if (y - y0) ** 2 + (x - x0) ** 2 <= r * r}
    blobs = [set().union(*(disc(*map(int, c)) for c in zip(rng.integers(-9, 25, n), rng.integers(-9, 25, n), rng.integers(2, 7, n), strict=True))) for n in (2, 3, 3, 4, 5, 6)]
    df = spark.createDataFrame([(1, i, y, x) for i, b in enumerate(blobs) for y, x in b] + [(1, 0, None, 2)], "tile int, label long, y int, x int")
    rows = lambda: sorted(map(tuple, patterns.split_blobs(df, 150, 6).collect()))
    want = rows()
    assert len({r[1] for r in want}) > 2
    for most in (0, sorted(map(len, blobs))[2]):
        monkeypatch.setattr(patterns, "BLOB", most)
        assert rows() == want


def test_batches_hold_whole_groups(monkeypatch):
    monkeypatch.setattr(C, "BATCH", 10)
    sizes = [1, 3, 30, 2, 2, 9, 10, 11, 1]
    group = np.repeat(np.arange(len(sizes)), sizes)
    t = pa.table({"first": np.diff(group, prepend=-1) > 0, "group": group})
    for rows in (1, 4, 7, 100):
        out = [x.column("group").to_pylist() for x in C.whole_groups(t.to_batches(max_chunksize=rows))]
        assert sum(out, []) == group.tolist() and all(a[-1] != b[0] for a, b in zip(out, out[1:], strict=False))
        assert rows == 100 or max(map(len, out)) <= 30 + 10 + rows and len(out) > 3
    assert not list(C.whole_groups([]))


def test_blobs_are_split_in_few_jobs(spark):
    """Time went into some hundred jobs, whatever the table: rounds of joins for each component, anew after each step of erosion."""
    cells = spark.range(900).selectExpr("1L AS tile", "CAST(id / 30 AS LONG) AS y", "id % 30 AS x").where("x % 10 < 8 AND y % 10 < 8")
    sc = spark.sparkContext
    sc.setJobGroup("blobs", "few jobs")
    try:
        patterns.split_blobs(raster.components(cells.where("x <> 13 OR y = 3")), 400, 4).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("blobs")) < 30

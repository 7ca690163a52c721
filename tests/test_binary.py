"""Binary files against struct."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotline.sources import binary


def las(points, record, fmt=1, offset=300, scale=(0.01, 0.02, 0.001), shift=(500000.0, 6000000.0, -5.0)):
    head = bytearray(offset)
    head[:4] = b"LASF"
    struct.pack_into("<I", head, 96, offset)
    struct.pack_into("<BHI", head, 104, fmt, record, len(points))
    struct.pack_into("<3d", head, 131, *scale)
    struct.pack_into("<3d", head, 155, *shift)
    body = b"".join(struct.pack("<iiiHBB", *p).ljust(record, b"\x07") for p in points)
    return bytes(head) + body + b"tail"


def test_read_points(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(binary, "RANGE", 700)
    want = []
    for k, record in enumerate((20, 28, 34)):
        pts = [(*map(int, rng.integers(-(2**31), 2**31, 3)), 9, int(rng.integers(256)), int(rng.integers(256))) for _ in range((1, 5000, 701)[k])]
        (tmp_path / f"{k}.las").write_bytes(las(pts, record, fmt=k))
        want += [(f"{k}.las", i, x * 0.01 + 500000.0, y * 0.02 + 6000000.0, z * 0.001 - 5.0, r >> 3 & 7, c & 31) for i, (x, y, z, _, r, c) in enumerate(pts)]
    (tmp_path / "none.las").write_bytes(las([], 20, 0))
    rows = binary.read_points(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() > 1
    assert sorted((r.file.rsplit("/", 1)[1], *tuple(r)[1:]) for r in rows.collect()) == sorted(want)
    for bad in (b"no such thing", las([(1, 2, 3, 0, 0, 0)], 20, fmt=6), las([(1, 2, 3, 0, 0, 0)] * 9, 20)[:400]):
        (tmp_path / "bad").mkdir(exist_ok=True)
        (tmp_path / "bad" / "x.las").write_bytes(bad)
        with pytest.raises(Exception, match="laser points|last point"):
            binary.read_points(spark, str(tmp_path / "bad")).collect()


def test_a_million_points_in_many_tasks(spark, tmp_path):
    n = 1_000_000
    p = np.zeros(n, np.dtype({"names": ["x", "c"], "formats": ["<i4", "u1"], "offsets": [0, 15], "itemsize": 28}))
    p["x"], p["c"] = np.arange(n), np.arange(n) % 64
    (tmp_path / "big.las").write_bytes(las([], 28)[:300].replace(struct.pack("<BHI", 1, 28, 0), struct.pack("<BHI", 1, 28, n)) + p.tobytes())
    rows = binary.read_points(spark, str(tmp_path))
    got = rows.withColumn("task", F.spark_partition_id()).selectExpr("count(*) AS n", "count(DISTINCT point) AS d", "sum(round((x - 500000) * 100)) AS s", "max(cls) AS c", "count(DISTINCT task) AS tasks").first()
    assert (got.n, got.d, got.s, got.c) == (n, n, n * (n - 1) / 2, 31) and got.tasks > 1


def test_points_and_rasters_round_trip(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    pts = [(float(a) / 100, float(b) / 100, float(c) / 100, int(r), int(k)) for a, b, c, r, k in zip(*(rng.integers(0, 5000, 300) for _ in range(3)), rng.integers(0, 8, 300), rng.integers(0, 32, 300), strict=True)]
    binary.write_points(spark.createDataFrame(pts, "x double, y double, z double, n_returns int, cls int").repartition(3), str(tmp_path / "p"))
    assert sorted((round(r.x, 2), round(r.y, 2), round(r.z, 2), r.n_returns, r.cls) for r in binary.read_points(spark, str(tmp_path / "p")).collect()) == sorted(pts)
    monkeypatch.setattr(binary, "RANGE", 7)
    cells = [(t, y, x, float(t * 100 + y * 10 + x) / 4) for t in range(3) for y in range(5) for x in range(4) if (t + y + x) % 3]
    extra = [(0, 9, 9, 1.0), (1, 0, 0, None), (2, 0, 0, float("inf"))]
    binary.write_raster(spark.createDataFrame(cells + extra, "tile long, y long, x long, v double").repartition(3), str(tmp_path / "r"), 4, 5)
    assert sorted((int(r.file.rsplit("/", 1)[1].split(".")[0]), r.y, r.x, r.v) for r in binary.read_raster(spark, str(tmp_path / "r"), 4).collect()) == sorted(cells)
    with pytest.raises(Exception, match="whole row"):
        binary.read_raster(spark, str(tmp_path / "r"), 7).collect()

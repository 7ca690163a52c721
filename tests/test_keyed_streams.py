"""Keyed streams in several batches, with a restart in between, against plain loops."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotline.streaming import keyed as K

SCHEMA = "user_id long, id long, ts timestamp, value double, header boolean"
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out, at = [], 0
    for i in range(400):
        at += int(rng.integers(0, 240))
        out.append((int(rng.integers(4)), i, START + dt.timedelta(seconds=at), None if rng.random() < 0.05 else float(rng.integers(-2, 20)), bool(rng.random() < 0.15)))
    return out + [(None, 1000, START, 1.0, True), (1, 1001, None, 1.0, True)]


def fed(spark, rows, folder, parts, run):
    """Write the rows in stretches and run the query after each, as if it had been stopped."""
    src, out = f"{folder}/in", f"{folder}/out"
    step = -(-len(rows) // parts)
    for lo in range(0, len(rows), step):
        spark.createDataFrame(rows[lo : lo + step], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = run(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src))
        K.run_to_end(stream, out)
    return spark.read.schema(stream.schema).parquet(out).collect()


@pytest.mark.parametrize("parts", [1, 3])
def test_rolling_means(spark, rows, tmp_path, parts):
    got = {r.id: r.mean for r in fed(spark, rows, str(tmp_path), parts, lambda s: K.rolling_means(s, "user_id", 5))}
    seen, want = {}, {}
    for user, i, ts, value, _ in rows:
        if user is not None and ts is not None and value is not None and value > 0:
            seen.setdefault(user, []).append(value)
            last = seen[user][-5:]
            want[i] = sum(last) / len(last)
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-12 for i in want)


@pytest.mark.parametrize("parts", [1, 3])
def test_headed_sessions(spark, rows, tmp_path, parts):
    gap, late = 600, 60
    got = sorted((r.key, r.started, r.last, r.n, r.total) for r in fed(spark, rows, str(tmp_path), parts, lambda s: K.headed_sessions(s, "user_id", gap * 1_000_000, f"{late} seconds")))
    us = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    open_, want = {}, []
    top = max(us(r[2]) for r in rows if r[0] is not None and r[2] is not None)
    for user, _, ts, value, header in rows:
        if user is None or ts is None:
            continue
        now = open_.get(user)
        if now and (header or us(ts) - now[1] > gap * 1_000_000):
            want.append((user, *now))
            now = None
        if header:
            now = (us(ts), us(ts), 1, value or 0.0)
        elif now:
            now = (now[0], us(ts), now[2] + 1, now[3] + (value or 0.0))
        open_[user] = now
    want += [(u, *s) for u, s in open_.items() if s and s[1] + gap * 1_000_000 <= top - late * 1_000_000]
    assert len(want) > 20 and got == sorted(want)


def test_late_rows_are_left_out(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = [(1, 1, at(0), 1.0, True), (1, 2, at(10_000), 1.0, True), (1, 3, at(5), 9.0, False), (1, 4, at(10_001), 2.0, False), (2, 5, at(60_000), 1.0, True)]
    got = sorted((r.key, r.n, r.total) for r in fed(spark, rows, str(tmp_path), 5, lambda s: K.headed_sessions(s, "user_id", 100_000_000, "10 seconds")))
    assert got == [(1, 1, 1.0), (1, 2, 3.0)]
    empty = fed(spark, rows[:1], f"{tmp_path}/none", 1, lambda s: K.rolling_means(s.where(F.lit(False)), "user_id"))
    assert empty == []


def test_keys_share_buckets(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "BUCKETS", 1)
    test_rolling_means(spark, rows, tmp_path / "means", 3)
    test_headed_sessions(spark, rows, tmp_path / "sessions", 3)

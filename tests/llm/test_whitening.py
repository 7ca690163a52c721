"""Whitening against numpy's eigenvectors of the covariance, exact deviations, and odd rows."""

import math

import numpy as np
import pytest

from plotline.llm import queries, whitening

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, n int, whitened string"


def check(table, rows, components=8):
    """``rows``: all (vec_id, vector) of the table. The result, by id."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    ints = [[math.floor(1024 * c) + 100_000 for c in v] + [100_000] * (width - len(v)) for _, v in kept]
    n, sums = len(ints), [sum(c) for c in zip(*ints, strict=True)]
    y = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in ints], float).reshape(n, width)
    values, vectors = np.linalg.eigh(y.T @ y / n) if n and width else (np.zeros(0), np.zeros((0, 0)))
    values, vectors = values[::-1], vectors[:, ::-1]
    k = sum(v > 1e-12 * values[0] for v in values[:components]) if len(values) and values[0] > 0 else 0
    got = whitening.whiten(table, components).collect()
    assert len(got) == n * k
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation, r.deviation_digits), {}).setdefault(r.component, []).append(r)
    for c in range(1, k + 1):
        z = y @ vectors[:, c - 1] / np.sqrt(values[c - 1])
        want = {}
        for (i, _), v, x in zip(kept, ints, z, strict=True):
            dev = sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
            want.setdefault((i, dev if dev < 1 << 63 else None, None if dev < 1 << 63 else str(dev)), []).append(x)
        assert set(want) == set(by)
        pairs = [(sorted(r.whitened for r in by[key][c]), sorted(w)) for key, w in want.items()]
        same = lambda sign: all(np.allclose(a, sorted(sign * x for x in b), rtol=1e-7, atol=1e-7) for a, b in pairs)
        assert same(1) or same(-1)
        for key in want:
            for r in by[key][c]:
                assert r.n == n and abs(r.explained / (values[c - 1] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-9
    return got


@pytest.mark.parametrize("d", [1, 5, 8, 33, 64, 150])
def test_equals_eigenvectors(spark, d):
    rng = np.random.default_rng(d)
    v = rng.normal(size=(400, d)) * np.linspace(2, 0.5, d) + rng.normal(size=d) * 3
    rows = list(enumerate(v.tolist()))
    check(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5), rows)


def test_close_eigenvalues(spark):
    """A nearly round cloud: the spectrum has no gap behind the eighth value."""
    v = np.random.default_rng(1).normal(size=(3000, 96))
    rows = list(enumerate(v.tolist()))
    check(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3), rows)


def test_narrow_spectrum_doubles_the_block(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROUNDS", 0)
    v = np.random.default_rng(2).normal(size=(500, 90))
    rows = list(enumerate(v.tolist()))
    check(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(60, 6)).tolist())]
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (102, [float("nan")] * 6), (103, [float("inf")] * 6), (104, [1.0, 2.0]), (105, []), (None, rows[3][1]), (7, rows[7][1]), (7, rows[8][1])]
    check(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA), rows)
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)]  # one direction only
    assert {r.component for r in check(spark.createDataFrame([(*r, 1, "x") for r in flat], SCHEMA), flat)} == {1}
    for none in ([], [(1, None)], [(1, [2.0, 3.0])], [(1, [2.0]), (2, [2.0])], [(1, [])]):
        assert check(spark.createDataFrame([(*r, 1, "x") for r in none], SCHEMA), none) == []


def test_large_entries(spark):
    """Deviations beyond 63 bits are spelt out."""
    rows = [(i, [float(i) * 1e9, float(i * i) * 1e3]) for i in range(30)]
    got = check(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA), rows, 1)
    assert any(r.deviation is None and int(r.deviation_digits) >= 1 << 63 for r in got)


def test_query_on_the_table(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    check(table, rows)
    assert queries.op12_whitening(spark, DATA).count() == 8 * len(rows)

"""SimHash groups against comparison of all pairs; thresholds against all allocations; hot values; odd rows."""

import itertools
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plotline.llm import queries, simhash

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps):
    """The least position linked with each."""
    fps, label = np.array(fps, np.uint64), np.arange(len(fps))
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    while True:
        now = np.array([label[c].min() for c in close])
        if (now == label).all():
            return label
        label = now


def check_groups(spark, fps):
    """``linked`` over distinct fingerprints, against all pairs."""
    fps = sorted({int(x) for x in fps})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {r.v: r.comp for r in simhash.linked(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(5)).collect()}
    label = brute_groups(fps)
    groups = {}
    for x, g in zip(signed, label, strict=True):
        groups.setdefault(g, []).append(x)
    for g in groups.values():
        assert {got.get(x, x) for x in g} == {min(g)}


def crowd(rng, n):
    """Chains and clusters around a few centres that share many bits, and fingerprints far from all."""
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    out = list(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    for _ in range(4):
        x = centre
        for _ in range(n):
            x = x ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False)))
            out.append(x)
            if rng.random() < 0.2:
                x = centre
    return out


def test_groups_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    check_groups(spark, crowd(rng, 150))
    check_groups(spark, [0, (1 << 64) - 1, 15, 31, 1 << 63])
    check_groups(spark, [7])
    check_groups(spark, [])


@pytest.mark.parametrize("parts", [2, 3, 4, 5])
def test_every_number_of_parts_finds_all(spark, monkeypatch, parts):
    monkeypatch.setattr(simhash, "number_of_parts", lambda n: parts)
    check_groups(spark, crowd(np.random.default_rng(parts), 60))


@pytest.mark.parametrize("pivots", [0, 2])
def test_hot_values_lose_nothing(spark, monkeypatch, pivots):
    monkeypatch.setattr(simhash, "HOT", 5)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    monkeypatch.setattr(simhash, "PIVOTS", pivots)
    rng = np.random.default_rng(8)
    same = np.uint64(0xFFFF_0000_0000_0000)  # sixteen bits that all share
    fps = crowd(rng, 80)
    fps += [x & ~same for x in crowd(rng, 80)] + [int(x) & 0xFFFFF for x in rng.integers(0, 1 << 20, 200)]
    check_groups(spark, fps)


def test_parts_follow_the_size():
    assert [simhash.number_of_parts(n) for n in (10, 10**5, 10**9, 10**11)] == [5, 5, 3, 2] or simhash.number_of_parts(10**11) == 2


def test_thresholds_cost_least():
    rng = np.random.default_rng(2)
    for m in (2, 3, 4, 5):
        cost = [np.concatenate([np.zeros((20, 1)), np.cumsum(rng.random((20, simhash.MOST + 1)), axis=1)], axis=1) for _ in range(m)]
        got = simhash.allocate(cost)
        assert (got.sum(axis=1) == simhash.DISTANCE - m + 1).all()
        for row in range(20):
            price = lambda t: sum(c[row, x + 1] for c, x in zip(cost, t, strict=True))  # noqa: B023, E731
            every = [t for t in itertools.product(range(-1, simhash.MOST + 1), repeat=m) if sum(t) == simhash.DISTANCE - m + 1]
            assert abs(price(got[row]) - min(map(price, every))) < 1e-9


def test_correlated_bits_share_a_part():
    rng = np.random.default_rng(4)
    free = rng.integers(0, 2, (2000, 16))
    bits = np.repeat(free, 4, axis=1)[:, (order := rng.permutation(64))]
    groups = simhash.grouped_bits((bits.T @ bits).astype(np.int64), 2000, 4)
    source = np.repeat(np.arange(16), 4)[order]
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert sum(len({source[b] for b in g}) for g in groups) <= 20  # 16 if every foursome stays together


def check_query(got, rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    label = brute_groups(fps)
    least = {}
    for (i, _), g in zip(rows, label, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = [(i, f"{x:016x}", least.get(g)) for (i, _), x, g in zip(rows, fps, label, strict=True)]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == sorted(want, key=key)


def test_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [None, "", " \n", "a", "A", "a b", "a b c", "a b c d", "A B c d", "é Ü ß", base, base.replace("w7 ", "x "), base + " tail", "x" * 3_000_000, "go " * 1_000_000]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(None, base), (None, "nobody else has this"), (50, base), (50, base), (3, "")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, least int").repartition(3)
    check_query(simhash.simhash_groups(docs).collect(), rows)
    assert simhash.simhash_groups(docs.where(F.lit(False))).count() == 0


def test_query_on_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    check_query(queries.op11_simhash(spark, DATA).collect(), rows)

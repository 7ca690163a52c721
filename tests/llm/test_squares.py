"""N-gram join: what goes into squares, and that two rounds try every allowed pair."""

import itertools

import numpy as np

from plotline.llm import ngram_join

FOUND, TILES, CLASSES = "v long, comp long", "token long, cls long, n int, pos int", "cls long, n int, bits array<long>"


def test_rows_without_a_fitting_partner_get_no_bitmap(spark):
    sizes = {1: 10, 2: 100, 3: 1000, 4: 2000, 5: 2100, 6: 2000}
    tiles = spark.createDataFrame([(7, c, n, 0) for c, n in sizes.items()], TILES)
    classes = spark.createDataFrame([(c, n, [0] * 8) for c, n in sizes.items()], CLASSES)
    got = ngram_join._squares(tiles, spark.createDataFrame([(4, 4), (6, 4)], FOUND), classes)
    assert sorted(r.cls for r in got.collect()) == [4, 5, 6]


def test_two_rounds_try_every_allowed_pair(spark):
    rng = np.random.default_rng(3)
    n = {c: int(rng.integers(300, 380)) for c in range(60)}
    base = rng.integers(0, 2, (4, 512), dtype=np.uint8)
    flat = {c: base[c % 4] ^ (rng.random(512) < 0.07) for c in n}
    bits = {c: np.packbits(x).view(np.int64).tolist() for c, x in flat.items()}
    rows = [(t, c, n[c], int(rng.integers(0, 30))) for t in range(12) for c in rng.choice(60, 3 + 2 * t, replace=False).tolist()]
    want = set()
    for (t, a, na, pa), (u, b, nb, pb) in itertools.combinations(rows, 2):
        d = int((flat[a] ^ flat[b]).sum())
        if t == u and min(na, nb) * 5 >= max(na, nb) * 4 and min(na - pa, nb - pb) * 9 >= 4 * (na + nb) and d * 9 <= na + nb:
            want.add((min(a, b), max(a, b)))
    tiles, found = spark.createDataFrame(rows, TILES), spark.createDataFrame([], FOUND)
    classes = spark.createDataFrame([(c, n[c], bits[c]) for c in n], CLASSES)
    out = lambda tiles, best: ngram_join._squares(tiles, found, classes).mapInArrow(ngram_join._within_squares(best), "a long, b long, token long").collect()
    first = out(tiles, True)
    once, left = {(r.a, r.b) for r in first if r.token is None}, {r.token for r in first if r.token is not None}
    assert once < want and 0 < len(left) < 12
    rest = out(tiles.where(tiles.token.isin(left)), False)
    assert once | {(r.a, r.b) for r in rest} == want

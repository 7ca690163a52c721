"""Periodic runs against a plain search for every period, and odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plotline.llm import queries
from plotline.llm.runs import periodic_runs, run_digests, runs

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(s):
    """(start, length, period) by start, then period."""
    n, got = len(s), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and s[j] == s[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                got.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((a, n, q) for (a, n), q in got.items()), key=lambda r: (r[0], r[2]))


def collapsed(s, found):
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(s) if i not in gone)


def rewritten(doc_id, s):
    if doc_id is None or not s:
        return s
    h, n = zlib.crc32(str(doc_id).encode()), len(s)
    if h % 10:
        return s
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return s[:a] + [s[a + (i - a) % p] for i in range(a, n)]


def digests(doc_id, text):
    s = rewritten(doc_id, WORD.findall(text or ""))
    found = brute(s)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(collapsed(s, found)))


def check(docs, rows):
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted(map(tuple, run_digests(docs).collect()), key=key) == sorted((digests(*r) for r in rows), key=key)


def search(documents):
    first = np.cumsum([0, *map(len, documents)])
    doc = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    words = np.array([w for d in documents for w in d], np.int64)
    got = list(zip(*(x.tolist() for x in runs(doc << 32 | words, first[1:][doc])), strict=True))
    return [[(a - lo, n, q) for a, n, q in got if lo <= a < hi] for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


@st.composite
def repetitive(draw):
    """Words with nested repetition: stretches of a few words, repeated, joined and broken."""
    out = []
    for _ in range(draw(st.integers(0, 4))):
        unit = draw(st.lists(st.integers(0, 2), min_size=1, max_size=9))
        out += (unit * draw(st.integers(1, 8)))[: draw(st.integers(1, 70))]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(repetitive(), max_size=4))
def test_equals_a_search_for_every_period(documents):
    assert search(documents) == [brute(d) for d in documents]


@pytest.mark.parametrize("unit", [[0], [0, 1], [0, 0, 0, 1], [0] * 9 + [1] * 9, list(range(6)), list(range(7)), list(range(100))])
@pytest.mark.parametrize("times", [2, 2.5, 7])
def test_every_shift_of_a_run(unit, times):
    s = (unit * 8)[: int(len(unit) * times)]
    for shift in range(20):
        d = [*range(1000, 1000 + shift), *s, 5000]
        assert search([d]) == [brute(d)]


def test_touching_stretches_keep_all_their_runs():
    d = ([0, 1] * 40)[:-1] + ([0, 1] * 40)[:-1]  # a run around the touch for every odd period from 7 on
    found = brute(d)
    assert len({q for _, _, q in found}) > 10 and search([d]) == [found]


def test_odd_rows(spark):
    texts = [None, "", " \t\n", "one", "a " * 11, "a " * 12, "a A " * 12, "a b c\n" * 9, "é ü é " * 8, "x" * 3_000_000, "pair up " * 300_000]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, "b c d " * 9), (5, "a " * 12), *((i, " ".join(f"w{(k * k) % 41}" for k in range(i % 120))) for i in range(100, 260))]
    small = [r for r in rows if len(r[1] or "") < 100_000]
    docs = lambda some: spark.createDataFrame([(*r, 1.0, "x", "y") for r in some], "doc_id long, text string, seed double, runs string, best string")
    check(docs(small), small)
    got = {r.doc_id: r for r in periodic_runs(docs(rows)).where("doc_id IN (9, 10)").collect()}
    assert got[9].runs == [] and got[9].collapsed == texts[9]
    assert [tuple(r) for r in got[10].runs] == [(0, 600_000, 2)] and got[10].collapsed == "pair up"
    assert run_digests(docs([])).count() == 0


def test_query_on_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    some = [r for r in rows if len(r[1] or "") < 8_000]
    got = {r.doc_id: tuple(r) for r in queries.op13_runs(spark, DATA).collect()}
    assert len(got) == len(rows) and sum(r[1] > 0 for r in got.values()) > 10
    assert [got[r[0]] for r in some] == [digests(*r) for r in some]

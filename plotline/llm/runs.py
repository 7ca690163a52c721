"""Periodic runs in texts by internal pattern matching.

A run is a maximal stretch of words with smallest period q and length >= max(MIN_LENGTH, 2 q). Documents are held whole, many short
ones at a time, and every step works on all of them at once:

1. Prefix doubling names the classes of equal fragments of 1, 2, 4, ... words. The last names are the ranks of the suffixes, so they
   give the suffix array, in which the suffixes that begin with a fragment are an interval.
2. A wavelet matrix over the suffix array answers how many occurrences of a fragment lie before a position, and which is the k-th
   (range successor). A run of period q holds, in its first length - q words, an aligned dyadic block of m words with
   2 m - 1 <= q <= 4 m - 2 (m = 4 below, m = 2 for q = 6) that occurs again q words on: so each block asks for its occurrences in
   the neighbouring windows of m positions that cover these distances.
3. Three or more occurrences in such a window are an arithmetic progression, whose difference p is the block's own period. In the
   block's own p-periodic stretch only p counts. Another such stretch must lie at the distance of the two stretches'
   ends, unless the stretches touch: only then every member is a candidate.
4. Candidates (position, q) are extended both ways by the dyadic classes. Of equal stretches the smallest period stays.

Words are maximal runs of characters other than ASCII white space, told apart by their bytes.

Cases: null, empty and white-space texts have no words, no runs and an empty collapsed text. A null doc_id is a document like any other
(never rewritten). Repeated rows are documents of their own. A very long text stands alone in its task, in memory of about 60 bytes a
word and 10 more for each doubling of its longest repeat. An empty table gives no rows. Extra columns, whatever their names, are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm._text import chunks, joined, owners, words

MIN_LENGTH = 12
#: Bytes of text that are searched at once (one longer document stands alone).
SLICE = 1 << 21
_RUNS = "array<struct<start:long,length:long,period:long>>"


def dyadic_classes(key: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(first, count) for fragments of 1, 2, 4, ... words, until every suffix is alone: the number of suffixes smaller than the fragment
    that begins at each position (with -1 after the last), and how often the fragment occurs. ``key`` tells words of different
    documents apart; ``end`` is the end of each position's document. Fragments that reach beyond it are alone."""
    n = len(key)
    order = np.argsort(key, kind="stable")
    bounds = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
    size = np.diff(np.append(bounds, n))
    first, count = np.empty(n + 1, np.int32), np.empty(n, np.int32)
    first[order], first[n] = np.repeat(bounds, size), -1
    count[order] = np.repeat(size, size)
    levels, m = [(first, count)], 1
    while len(at := np.flatnonzero(count > 1)):
        head = first[at].astype(np.int64)
        k = head * (n + 2) + np.where(at + m < end[at], first[np.minimum(at + m, n)] + 1, 0)
        order = np.argsort(k, kind="stable")
        k, head, at = k[order], head[order], at[order]
        new = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        size = np.diff(np.append(new, len(k)))
        whole = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1])))
        begin = np.repeat(whole, np.diff(np.append(whole, len(k))))  # where each one's old class begins
        first, count = first.copy(), count.copy()
        first[at] = head + np.repeat(new, size) - begin
        count[at] = np.repeat(size, size)
        levels.append((first, count))
        m *= 2
    return levels


class Wavelet:
    """Wavelet matrix of whole numbers from 0 to ``top``: order statistics of any interval in a step for each bit."""

    def __init__(self, values: np.ndarray, top: int):
        v, n = values.astype(np.int32), len(values)
        self.rows: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        for b in range(max(1, int(top).bit_length()) - 1, -1, -1):
            one = (v >> b & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            bits = np.packbits(one, bitorder="little")
            packed[: len(bits)] = bits
            packed = packed.view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            self.rows.append((b, packed, before, n - int(before[-1])))
            v = np.concatenate((v[~one], v[one]))

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the values at [lo, hi) are less than x (at most ``top``)."""
        out = np.zeros(len(lo), np.int64)
        for b, packed, before, zeros in self.rows:
            l1, h1 = self._ones(packed, before, lo), self._ones(packed, before, hi)
            one = (x >> b & 1).astype(bool)
            out += np.where(one, hi - h1 - lo + l1, 0)
            lo, hi = np.where(one, zeros + l1, lo - l1), np.where(one, zeros + h1, hi - h1)
        return out

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of the values at [lo, hi)."""
        out = np.zeros(len(lo), np.int64)
        for b, packed, before, zeros in self.rows:
            l1, h1 = self._ones(packed, before, lo), self._ones(packed, before, hi)
            less = hi - h1 - lo + l1
            one = k >= less
            k = np.where(one, k - less, k)
            out |= one.astype(np.int64) << b
            lo, hi = np.where(one, zeros + l1, lo - l1), np.where(one, zeros + h1, hi - h1)
        return out


def _forward(levels: list[tuple[np.ndarray, np.ndarray]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that agree from i and j on (i < j)."""
    i, j = i.copy(), j.copy()
    begin, n = i.copy(), len(levels[0][0]) - 1
    for k in range(len(levels) - 1, -1, -1):
        first = levels[k][0]
        step = (first[np.minimum(i, n)] == first[np.minimum(j, n)]).astype(np.int64) << k
        i += step
        j += step
    return i - begin


def _backward(levels: list[tuple[np.ndarray, np.ndarray]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that agree before i and j (i < j)."""
    i, j = i.copy(), j.copy()
    begin = i.copy()
    for k in range(len(levels) - 1, -1, -1):
        first, m = levels[k][0], 1 << k
        step = ((i >= m) & (first[np.maximum(i - m, 0)] == first[np.maximum(j - m, 0)])).astype(np.int64) << k
        i -= step
        j -= step
    return begin - i


def _windows(m: int) -> list[tuple[int, int]]:
    """Distances from a block of m words that are searched, in pieces of m positions at most."""
    if m == 2:
        return [(6, 6)]
    return [(1, 4), (5, 8), (9, 12), (13, 14)] if m == 4 else [(2 * m - 1, 3 * m - 2), (3 * m - 1, 4 * m - 2)]


def runs(key: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length, period of all runs, by start, then period. ``key`` and ``end`` as in ``dyadic_classes``."""
    none = np.empty(0, np.int64)
    n = len(key)
    if n < MIN_LENGTH:
        return none, none, none
    levels = dyadic_classes(key, end)
    asked = []
    for k in range(1, len(levels)):
        m = 1 << k
        i = np.arange(0, n - m + 1, m)
        i = i[levels[k][1][i] > 1]
        for near, far in _windows(m):
            some = i[i + near + m <= end[i]]
            asked.append(np.stack([some, np.full(len(some), k), some + near, np.minimum(some + far + 1, end[some])]))
    block, level, begin, stop = np.concatenate(asked, axis=1) if asked else np.empty((4, 0), np.int64)
    if not len(block):
        return none, none, none
    suffixes = np.empty(n, np.int32)
    suffixes[levels[-1][0][:n]] = np.arange(n)
    repeated = levels[1][1][suffixes] > 1  # other suffixes begin with no repeated block
    place = np.concatenate(([0], np.cumsum(repeated)))
    tree = Wavelet(suffixes[repeated], n)
    lo, count = np.empty(len(block), np.int64), np.empty(len(block), np.int64)
    for k in range(1, len(levels)):
        at = level == k
        lo[at], count[at] = place[levels[k][0][block[at]]], levels[k][1][block[at]]
    c0 = tree.below(lo, lo + count, begin)
    found = tree.below(lo, lo + count, stop) - c0
    at = np.flatnonzero(found)
    block, lo, count, c0, found = block[at], lo[at], count[at], c0[at], found[at]
    nearest = tree.kth(lo, lo + count, c0)
    two = np.flatnonzero(found > 1)
    second = tree.kth(lo[two], lo[two] + count[two], c0[two] + 1)
    pair = found[two] == 2
    few = found <= 2
    i, j = [block[few], block[two][pair]], [nearest[few], second[pair]]
    x, p = two[~pair], (second - nearest[two])[~pair]
    if len(x):  # progressions
        own, first, last = block[x], nearest[x], nearest[x] + (found[x] - 1) * p
        left, right = own - _backward(levels, own, own + p), own + p + _forward(levels, own, own + p)
        left2, right2 = first - _backward(levels, first, first + p), first + p + _forward(levels, first, first + p)
        apart = left2 > right
        for q in (left2 - left, right2 - right):
            ok = apart & (own + q >= first) & (own + q <= last) & ((own + q - first) % p == 0)
            i.append(own[ok])
            j.append((own + q)[ok])
        i.append(own[left2 == left])
        j.append((own + p)[left2 == left])
        ok = np.flatnonzero(~apart & (left2 != left))
        times = found[x][ok]
        t = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        i.append(np.repeat(own[ok], times))
        j.append(np.repeat(first[ok], times) + t * np.repeat(p[ok], times))
    i, j = np.concatenate(i), np.concatenate(j)
    period = j - i
    start = i - _backward(levels, i, j)
    length = i + _forward(levels, i, j) + period - start
    ok = length >= np.maximum(MIN_LENGTH, 2 * period)
    start, length, period = start[ok], length[ok], period[ok]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    ok = np.ones(len(start), bool)
    ok[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[ok], length[ok], period[ok]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _rewritten(n: np.ndarray, first: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The word that each place takes: its own, or where seed % 10 = 0 one of a stretch that repeats to the document's end."""
    src = np.arange(first[-1])
    for d in np.flatnonzero((seed % 10 == 0) & (n > 0)).tolist():
        g = int(seed[d]) // 10
        a = g % int(n[d])
        p = 1 + (int(n[d]) - a) // (3 + g % 8)
        lo = int(first[d]) + a
        src[lo : first[d + 1]] = lo + (src[lo : first[d + 1]] - lo) % p
    return src


def periodic_runs(docs: DataFrame, rewrite: bool = False) -> DataFrame:
    """doc_id, runs (by start, then period), collapsed: the text's words without those that lie in a run after its first period, joined
    by one space. With ``rewrite`` a tenth of the documents (by the CRC-32 of their ids) first get a periodic tail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches, "text", SLICE):
            starts, ends, first = words(data, off)
            n, size = np.diff(first), ends - starts
            src = _rewritten(n, first, rows.column("seed").to_numpy())
            inside = np.zeros(len(data) + 1, np.int8)
            np.add.at(inside, starts, 1)
            np.add.at(inside, ends, -1)
            letters = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
            at = np.concatenate(([0], np.cumsum(size)))
            spelt = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(letters)]) if len(starts) else pa.array([], pa.large_binary())
            ids = spelt.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            doc = owners(first)
            start, length, period = runs(doc << 32 | ids[src], first[1:][doc])
            gone = np.zeros(len(starts) + 1, np.int64)
            np.add.at(gone, start + period, 1)
            np.add.at(gone, start + length, -1)
            kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
            text, at = joined(data, starts, size, src[kept])
            bounds = at[np.searchsorted(kept, first)]
            some = np.flatnonzero(np.diff(bounds))
            cut = np.ones(len(text), bool)
            cut[bounds[1:][some] - 1] = False  # no space behind a document's last word
            bounds = bounds - np.concatenate(([0], np.cumsum(np.diff(bounds) > 0)))
            collapsed = pa.Array.from_buffers(pa.large_utf8(), rows.num_rows, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(text[cut])]).cast(pa.string())
            of = doc[start] if len(start) else np.empty(0, np.int64)
            listed = pa.StructArray.from_arrays([pa.array(start - first[of]), pa.array(length), pa.array(period)], ["start", "length", "period"])
            listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(rows.num_rows + 1)), pa.int32()), listed)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), listed, collapsed], names=["doc_id", "runs", "collapsed"])

    doc_id = F.col("doc_id").cast("long")
    seed = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(1)) if rewrite else F.lit(1).cast("long")
    return docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), seed.alias("seed")).mapInArrow(run, f"doc_id long, runs {_RUNS}, collapsed string")


def run_digests(docs: DataFrame) -> DataFrame:
    """For each document of ``periodic_runs`` (rewritten): the number of its runs, the longest (ties: smallest start, then period), and
    digests of the runs and of the collapsed text."""
    best = F.reduce("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda a, b: F.when(a.isNull() | (b["length"] > a["length"]), b).otherwise(a))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    found = periodic_runs(docs, rewrite=True).withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.expr("1000 * best.length div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

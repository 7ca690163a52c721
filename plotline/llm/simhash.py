"""SimHash near-duplicates by the generalised pigeonhole principle.

The fingerprint of a text has bit b set if more than half of the XXH64 hashes of its word shingles (repeats included) have it. Two
fingerprints link if they differ in ``DISTANCE`` bits or fewer.

1. Equal fingerprints are one. The covariance of the bits, over all of them, groups correlated bits into the same parts, so that
   different parts tell different things.
2. Pigeonhole: with thresholds t_1 .. t_m (-1: the part is left out) that sum to DISTANCE - m + 1, any two linked fingerprints differ in at most
   t_i bits in some part i. Every fingerprint gets thresholds of its own, by dynamic programming over the parts: the cost of a
   threshold is its probes (the values of the part within t_i bits) and its candidates, estimated from histograms of the parts. So a
   value that many fingerprints share is probed only by those for which nothing is cheaper. The number of parts follows from how many fingerprints there are.
3. Each fingerprint is listed under its value in every part, and probes the values within its thresholds. Lists and probes meet by hash of the
   value; candidates are verified by counting differing bits. A task sends the links of each place as stars of their components.
4. Values with more than ``HOT`` listed fingerprints: first all meet about ``PIVOTS`` of them. Then those that are not in one component yet meet in
   squares of bounded lists and probes, without those within the largest component.

Cases: null, empty and white-space texts have the fingerprint zero, which links like any other; texts of fewer words than a shingle
are one shingle. Repeated rows and ids are rows of their own; a null id never names a component unless all its ids are null. Very long texts
are single rows; shingles are hashed in slices. An empty table gives no rows. Extra columns, whatever their names, are not read."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.llm._text import LOWER, U, chunks, joined, splitmix, words
from plotline.llm.components import components
from plotline.session import forget, stored

SIZE, SEED, BITS = 4, 42, 64
DISTANCE = 4
#: Cost of a candidate, if that of a probe (a shuffled row) is 1.
CANDIDATE = 0.02
#: Largest threshold of one part, and bits of a part that its histogram tells apart.
MOST, KNOWN = 3, 16
#: Listed fingerprints of a value from which it is hot; pivots of a hot value; rows of a block of one.
HOT, PIVOTS, BLOCK = 4096, 16, 4096
#: Rows (lists and probes) of one group of values that meet in a task, and pairs that it looks at in one go.
GROUP, PAIRS = 200_000, 2_000_000
#: Hot values whose ids are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST = 1 << 20


def fingerprint(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the documents of a flat text column."""
    starts, ends, first = words(data, off)
    n = np.diff(first)
    text, at = joined(LOWER[data], starts, ends - starts, np.arange(len(starts)))
    size = np.minimum(n, SIZE)
    shingles = np.where(n > 0, n - size + 1, 0)
    bounds = np.concatenate(([0], np.cumsum(shingles)))
    out, spelt = np.zeros(len(n), U), text.tobytes()
    lo = 0
    while lo < len(n):  # documents with about a quarter of a million shingles at a time
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + (1 << 18), side="right")) - 1)
        total, doc = shingles[lo:hi], np.repeat(np.arange(lo, hi), shingles[lo:hi])
        begin = first[doc] + np.arange(bounds[lo], bounds[hi]) - bounds[doc]
        heads, tails = at[begin].tolist(), (at[begin + size[doc]] - 1).tolist()
        h = np.array([xxhash.xxh64_intdigest(spelt[a:b], SEED) for a, b in zip(heads, tails, strict=True)], U)
        some = np.flatnonzero(total)
        if len(some):
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            count = np.add.reduceat(bits, bounds[lo:hi][some] - bounds[lo], axis=0, dtype=np.int32)
            most = 2 * count > total[some][:, None]
            out[lo + some] = np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()
        lo = hi
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(fingerprint(data, off).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _summed(fps: DataFrame, of, size: int) -> np.ndarray:
    """Sums over all fingerprints of the ``size`` whole numbers that ``of`` counts in a batch; those that are zero are not sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += of(b.column("fp").to_numpy().view(U))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    got = fps.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most ``size`` rows
    out = np.zeros(size, np.int64)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out


def _together(fp: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
    return (bits.T @ bits).astype(np.int64).ravel()


def grouped_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The 64 bits in ``parts`` groups of nearly equal size: each begins with the bit that is most correlated with those left, and takes in
    those most correlated with its own."""
    mean = np.diag(together) / n
    cov = together / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    close = np.abs(cov / np.outer(spread, spread))
    np.fill_diagonal(close, 0)
    left, out = list(range(BITS)), []
    for i in range(parts):
        width = len(left) // (parts - i)
        group = [max(left, key=lambda b: (close[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < width:
            group.append(max(left, key=lambda b: (close[b, group].sum(), -b)))
            left.remove(group[-1])
        out.append(group)
    return out


def number_of_parts(n: int) -> int:
    """The parts that cost least for n fingerprints of independent bits."""

    def cost(m: int) -> float:
        widths = [BITS // m + (i < BITS % m) for i in range(m)]
        price = [[0.0] + [sum(comb(w, j) for j in range(t + 1)) * (1 + CANDIDATE * n / 2.0**w) for t in range(MOST + 1)] for w in widths]
        best = {0: 0.0}
        for p in price:
            now: dict[int, float] = {}
            for have, c in best.items():
                for t, x in enumerate(p, -1):
                    now[have + t] = min(now.get(have + t, np.inf), c + x)
            best = now
        return best[DISTANCE - m + 1]

    return min(range(2, DISTANCE + 2), key=cost)


def _value(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of a part, the first KNOWN of them, as a number."""
    out = np.zeros(len(fp), np.int64)
    for k, b in enumerate(bits[:KNOWN]):
        out |= ((fp >> U(b)) & U(1)).astype(np.int64) << k
    return out


def prices(counts: np.ndarray, width: int) -> np.ndarray:
    """Row t + 1: the cost of threshold t for each value of a part, from the histogram of its first bits; the others count as even."""
    known = counts.size.bit_length() - 1
    near = [counts.astype(np.float64), *(np.zeros(counts.size) for _ in range(MOST))]  # fingerprints at exactly j bits
    at = np.arange(counts.size)
    for b in range(known):
        other = at ^ (1 << b)
        near = [near[j] + (near[j - 1][other] if j else 0) for j in range(MOST + 1)]
    rest = width - known
    within = lambda t: sum(comb(rest, j) for j in range(t + 1)) / 2.0**rest
    out = [np.zeros(counts.size)]
    for t in range(MOST + 1):
        out.append(sum(comb(width, j) for j in range(t + 1)) + CANDIDATE * sum(near[j] * within(t - j) for j in range(t + 1)))
    return np.array(out, np.float32)


def allocate(cost: list[np.ndarray]) -> np.ndarray:
    """Thresholds of each fingerprint (rows) for each part, of least cost, that sum to DISTANCE - parts + 1. ``cost[i][:, t + 1]``: of
    threshold t in part i."""
    n, m = len(cost[0]), len(cost)
    need = DISTANCE + 1  # of t_i + 1
    best = np.full((n, need + 1), np.inf)
    best[:, 0] = 0
    chosen = []
    for c in cost:
        now, pick = np.full((n, need + 1), np.inf), np.zeros((n, need + 1), np.int8)
        for t in range(min(MOST + 2, need + 1)):
            with_t = np.full((n, need + 1), np.inf)
            with_t[:, t:] = best[:, : need + 1 - t] + c[:, t : t + 1]
            less = with_t < now
            now[less], pick[less] = with_t[less], t
        best = now
        chosen.append(pick)
    out, left = np.empty((n, m), np.int8), np.full(n, need)
    for i in range(m - 1, -1, -1):
        t = chosen[i][np.arange(n), left]
        out[:, i] = t - 1
        left -= t
    return out


#: Kinds of rows: listed only, listed and probing its own value, probing a value nearby.
LISTED, BOTH, PROBE = 0, 1, 2


def _rows(fps: DataFrame, parts: list[list[int]], tables: list[np.ndarray]) -> DataFrame:
    """key, fp, kind, crowd: every fingerprint under its value in each part, and its probes. ``crowd`` bounds from above how many are listed there."""
    held = fps.sparkSession.sparkContext.broadcast(tables)
    masks = [sum(1 << b for b in bits) for bits in parts]
    names = [U(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1) for i in range(len(parts))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = held.value

        def batch(i: int, fp: np.ndarray, value: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
            key = splitmix((value & U(masks[i])) ^ names[i])
            crowd = tables[i][0][_value(value, parts[i])]
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(kind), pa.array(crowd)], names=["key", "fp", "kind", "crowd"])

        for b in batches:
            fp = b.column("fp").to_numpy().view(U)
            values = [_value(fp, bits) for bits in parts]
            t = allocate([tables[i][1][:, v].T for i, v in enumerate(values)])
            for i, bits in enumerate(parts):
                yield batch(i, fp, fp, np.where(t[:, i] >= 0, BOTH, LISTED).astype(np.int32))
                for k in range(1, MOST + 1):
                    some = fp[t[:, i] >= k]
                    flips = np.array([sum(1 << x for x in c) for c in combinations(bits, k)], U) if len(some) else np.empty(0, U)
                    step = max(1, 100_000 // max(1, len(flips)))
                    for lo in range(0, len(some), step):
                        part = np.repeat(some[lo : lo + step], len(flips))
                        yield batch(i, part, part ^ np.tile(flips, len(some[lo : lo + step])), np.full(len(part), PROBE, np.int32))

    return fps.select("fp").mapInArrow(run, "key long, fp long, kind int, crowd long")


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of the links (a, b) as links of every member to the least."""
    if not len(a):
        return a, b
    u, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(u))
    while True:
        lx, ly = label[x], label[y]
        apart = lx != ly
        if not apart.any():
            break
        x, y, lx, ly = x[apart], y[apart], lx[apart], ly[apart]
        np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))
        while (label[label] != label).any():
            label = label[label]
    some = label != np.arange(len(u))
    return u[label[some]], u[some]


def _matched(key: np.ndarray, fp: np.ndarray, listed: np.ndarray, probing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows that probe and rows listed under the same key, as stars."""
    order = np.flatnonzero(listed)
    order = order[np.argsort(key[order], kind="stable")]
    keys, there = key[order], fp[order]
    probe = np.flatnonzero(probing)
    begin, stop = np.searchsorted(keys, key[probe]), np.searchsorted(keys, key[probe], side="right")
    before = np.concatenate(([0], np.cumsum(stop - begin)))
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    lo = 0
    while lo < len(probe):
        hi = max(lo + 1, int(np.searchsorted(before, before[lo] + PAIRS, side="right")) - 1)
        count = stop[lo:hi] - begin[lo:hi]
        x = np.repeat(fp[probe[lo:hi]], count)
        y = there[np.arange(before[hi] - before[lo]) + np.repeat(begin[lo:hi] - before[lo:hi] + before[lo], count)]
        ok = (np.bitwise_count((x ^ y).view(U)) <= DISTANCE) & (x != y)
        a, b = stars(np.concatenate([a, x[ok]]), np.concatenate([b, y[ok]]))
        lo = hi
    return a, b


def _links(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _meet(rows: DataFrame, groups: int) -> DataFrame:
    """Links (a, b) of rows whose keys have few listed."""

    def run(t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_numpy()
        return _links(*_matched(t.column("key").to_numpy(), t.column("fp").to_numpy(), kind != PROBE, kind != LISTED))

    return rows.withColumn("place", F.pmod("key", F.lit(groups))).groupBy("place").applyInArrow(run, "a long, b long")


def _to_pivots(hot: DataFrame) -> DataFrame:
    """Links of the fingerprints listed under hot keys with about PIVOTS of them."""
    listed = hot.where(F.col("kind") != PROBE)
    share = F.xxhash64("fp", "key").cast("double") / F.lit(2.0**64) + 0.5
    pivots = listed.where(share * F.col("listed") < PIVOTS).select("key", F.col("fp").alias("b"))
    return listed.join(pivots, "key").where((F.col("fp") != F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= DISTANCE)).select(F.col("fp").alias("a"), "b")


def _squares(hot: DataFrame, found: DataFrame) -> DataFrame:
    """Links (a, b) between different components under hot keys, from squares of a block of listed rows and one of probing rows."""
    now = hot.join(found.select(F.col("v").alias("fp"), "comp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    lists, probes = (F.col("kind") != PROBE).cast("long"), (F.col("kind") != LISTED).cast("long")
    sizes = now.groupBy("key", "comp").agg(F.sum(lists).alias("l"), F.sum(probes).alias("p"))
    sizes = sizes.groupBy("key").agg(F.max_by("comp", F.struct("l", "p", "comp")).alias("giant"), F.max_by("l", F.struct("l", "p", "comp")).alias("gl"), F.max_by("p", F.struct("l", "p", "comp")).alias("gp"), F.sum("l").alias("l"), F.sum("p").alias("p"), F.count("*").alias("comps"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    sizes = sizes.where("comps > 1").select("key", "giant", blocks(F.col("l") - F.col("gl")).alias("l_out"), blocks(F.col("gl")).alias("l_in"), blocks(F.col("p") - F.col("gp")).alias("p_out"), blocks(F.col("gp")).alias("p_in"))
    rows = now.join(sizes, "key")
    stray, h = F.col("comp") != F.col("giant"), F.xxhash64("fp", "key")

    def dealt(out: str, inside: str, others_out: str, others_in: str) -> tuple[Column, Column]:
        """The block of a row, and the blocks of the other role that it meets: rows of the giant don't meet their own."""
        own = F.when(stray, F.pmod(h, F.greatest(F.col(out), F.lit(1)))).otherwise(F.col(out) + F.pmod(h, F.greatest(F.col(inside), F.lit(1))))
        met = F.when(stray, F.col(others_out) + F.col(others_in)).otherwise(F.col(others_out))
        return own.cast("int"), F.when(met > 0, F.sequence(F.lit(0), met - 1)).otherwise(F.array().cast("array<int>"))

    own_l, met_l = dealt("l_out", "l_in", "p_out", "p_in")
    own_p, met_p = dealt("p_out", "p_in", "l_out", "l_in")
    left = rows.where(F.col("kind") != PROBE).select("key", own_l.alias("list"), F.explode(met_l).alias("probe"), "fp", "comp", F.lit(True).alias("listed"))
    right = rows.where(F.col("kind") != LISTED).select("key", F.explode(met_p).alias("list"), own_p.alias("probe"), "fp", "comp", F.lit(False).alias("listed"))

    def run(t: pa.Table) -> pa.Table:
        listed = t.column("listed").to_numpy(zero_copy_only=False)
        return _links(*_matched(t.column("key").to_numpy(), t.column("fp").to_numpy(), listed, ~listed))

    return left.unionByName(right).groupBy("key", "list", "probe").applyInArrow(run, "a long, b long")


def linked(fps: DataFrame) -> DataFrame:
    """v, comp for every fingerprint of ``fps`` (distinct) that links with another."""
    spark = fps.sparkSession
    together = _summed(fps, _together, BITS * BITS).reshape(BITS, BITS)
    n = fps.count()
    if n < 2:
        return spark.createDataFrame([], "v long, comp long")
    parts = grouped_bits(together, n, number_of_parts(n))
    counts = _summed(fps, lambda fp: np.concatenate([np.bincount(_value(fp, p), minlength=1 << min(len(p), KNOWN)) for p in parts]), sum(1 << min(len(p), KNOWN) for p in parts))
    counts = np.split(counts, np.cumsum([1 << min(len(p), KNOWN) for p in parts])[:-1])
    rows, rows_path = stored(_rows(fps, parts, [(c, prices(c, len(p))) for c, p in zip(counts, parts, strict=True)]), "probes")
    total = rows.count()
    crowds = rows.where((F.col("crowd") > HOT) & (F.col("kind") != PROBE)).groupBy("key").agg(F.count("*").alias("listed")).where(F.col("listed") > HOT)
    crowds, crowds_path = stored(crowds, "hot")
    hot_keys = crowds.count()
    few = F.broadcast(crowds) if hot_keys <= BROADCAST else crowds
    links = _meet(rows.join(few, "key", "left_anti") if hot_keys else rows, max(1, -(-total // GROUP)))
    if not hot_keys:
        links, links_path = stored(links, "links")
        found = components(links)
        forget(spark, rows_path, crowds_path, links_path)
        return found
    hot, hot_path = stored(rows.join(few, "key").select("key", "fp", "kind", "listed"), "hot")
    links, links_path = stored(links.unionByName(_to_pivots(hot)), "links")
    found = components(links)
    more, more_path = stored(links.unionByName(_squares(hot, found)), "links")
    out = components(more)
    forget(spark, rows_path, crowds_path, hot_path, links_path, more_path)
    return out


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for every row."""
    spark = docs.sparkSession
    base, _ = stored(fingerprints(docs), "fingerprints")
    fps, fps_path = stored(base.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = linked(fps)
    comp = fps.join(found.select(F.col("v").alias("fp"), "comp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    named, named_path = stored(comp, "named")
    least, least_path = stored(named.groupBy("comp").agg(F.min("least").alias("component_id")), "least")
    ids, _ = stored(named.join(least, "comp").select("fp", "component_id"), "ids")
    forget(spark, fps_path, named_path, least_path)
    return base.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

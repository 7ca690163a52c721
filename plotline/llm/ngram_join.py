"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact intersection of sorted arrays.

A document is the set of its distinct five-word shingles as sorted 64-bit hashes. Two sets link at Jaccard ``THRESHOLD`` or more.

1. Shingles that repeat within the share of a task are counted over all documents; the most frequent of them (at most
   ``FREQUENT``, 9 bytes each) are broadcast. They only set an order, rare shingles first: a set's *prefix* is its first
   n - ceil(0.8 n) + 1 shingles, and sets that link share one of them whatever the order.
2. Equal sets are one class, named by 128 bits. A tile is the classes of one size band (factor 1.25; linked sizes lie in the same or
   neighbouring bands) that share a prefix shingle. In each tile every class meets the tile's pivots, the classes with the fewest rarer
   shingles (an original before its copies), and those of the band below: so a tile gives no more pairs than it has rows.
3. Places in the order bound the overlap: sets whose first common shingle stands at places i and j share min(|A| - i, |B| - j) at most.
   Parity bitmaps of the hashed sets bound it too: differing bits count against it. Most false candidates end here.
4. Sets of the classes left are built again from the texts and intersected exactly; links give components.
5. Shingles of three or more classes that are not yet all in one component: their classes are dealt to squares of at most a fixed number
   of rows (blocks of those outside the largest component against all blocks), and all pairs of different components in a square go
   through 3 and 4. Bitmaps are brought only to rows that have a partner of fitting size and place in their square. First each class takes
   its two best partners in a square; shingles where that left an allowed pair untried meet again, and all that the bitmaps allow are tried.
   So no link between different components is lost, while groups of near copies never expand into all their pairs.

Cases: null, empty and white-space texts have no shingles and are their own component; texts of one to four words are one shingle of
their own. Repeated rows are equal documents. A null doc_id never names a component unless it is alone. Very long texts have bitmaps
as long as their sets; one document is held at a time. An empty table gives no rows. Extra columns, whatever their names, are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.llm._text import U, chunks, span_hash, splitmix, words
from plotline.llm.components import components
from plotline.session import forget, stored

SIZE = 5
THRESHOLD = (4, 5)
#: Shingles whose order the broadcast sets, and the least number of counted repeats that puts one there.
FREQUENT, REPEATS = 1 << 20, 8
#: Distinct shingles that a task counts before it sends what repeated and begins anew.
WINDOW = 1_500_000
#: Bytes of text that are cut into shingles at once (one longer document stands alone).
SLICE = 1 << 19
#: Bits of the smallest signature; sets of more shingles get the next power of two that is no smaller than their size.
BITMAP = 512
#: Rows of a block of a tile that is searched in full; a square holds two blocks.
BLOCK = 1024
#: Wanted classes whose ids are broadcast (16 bytes each); more are joined by shuffle.
WANTED = 1 << 20
_MULTIPLIERS = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_sets(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    starts, ends, first = words(data, off)
    h = span_hash(data, starts, ends)
    if len(h) >= SIZE:
        m = len(h) - SIZE + 1
        s = splitmix(sum(h[k : m + k] * _MULTIPLIERS[k] for k in range(SIZE)))
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= SIZE:
            x = np.sort(s[lo : hi - SIZE + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif hi > lo:  # the whole text, told apart by its length
            whole = U(0x51ED270B7A14C3E5 * (hi - lo) & (1 << 64) - 1)
            part = h[lo:hi] * np.array(_MULTIPLIERS[: hi - lo])
            out.append(splitmix(np.array([whole]) ^ part.sum(dtype=U)))
        else:
            out.append(np.empty(0, U))
    return out


def _class(x: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a set: equal sets share it, whatever task built them."""
    sums = [splitmix(x ^ U(c)).sum(dtype=U) + U(len(x)) for c in (0xB5297A4D3F84D5B5, 0x8EBC6AF09C88C6E3)]
    k1, k2 = splitmix(np.array(sums)).view(np.int64).tolist()
    return k1, k2


def _parity(x: np.ndarray) -> np.ndarray:
    """Bit i is the parity of the hashes that fall on i, so the bits where two signatures differ count against their overlap."""
    size = max(BITMAP, 1 << (len(x) - 1).bit_length())
    return np.packbits(np.bincount((x & U(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1).view(np.int64)


def _prefix_length(n: int) -> int:
    return n - -(-THRESHOLD[0] * n // THRESHOLD[1]) + 1 if n else 0


def _longs(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)]).astype(np.int32), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))


def frequent_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent shingles, and levels that grow with their counts.

    Each task counts its own documents (equal sets once) and sends what repeats there; the sums over all tasks are stored, and only
    the FREQUENT largest come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, counts = np.empty(0, U), np.empty(0, np.int64)
        waiting: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()

        def merge() -> None:
            nonlocal have, counts
            u, c = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            have, at = np.unique(np.concatenate([have, u]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([counts, c]), minlength=len(have)).astype(np.int64)

        def repeated() -> Iterator[pa.RecordBatch]:
            some = np.flatnonzero(counts > 1)
            for lo in range(0, len(some), 500_000):
                at = some[lo : lo + 500_000]
                yield pa.RecordBatch.from_arrays([pa.array(have[at].view(np.int64)), pa.array(counts[at])], names=["token", "n"])

        for _, data, off in chunks(batches, "text", SLICE):
            for x in shingle_sets(data, off):
                if len(x) and (c := _class(x)) not in seen:
                    seen.add(c)
                    waiting.append(x)
            if sum(map(len, waiting)) > 1_000_000:
                merge()
                if len(have) > WINDOW:
                    yield from repeated()
                    have, counts = np.empty(0, U), np.empty(0, np.int64)
                    seen.clear()
        if waiting:
            merge()
        yield from repeated()

    spark = texts.sparkSession
    sums, path = stored(texts.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= REPEATS), "frequent")
    level = F.least(F.floor(4 * F.log2("n")), F.lit(255)).cast("int")
    held, floor = 0, 256
    for r in sums.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 256 rows
        if held + r["count"] > FREQUENT:
            break
        held, floor = held + r["count"], r.level
    got = sums.select("token", level.alias("level")).where(F.col("level") >= floor).toArrow()
    forget(spark, path)
    tokens = got.column("token").to_numpy().view(U)
    order = np.argsort(tokens)
    return tokens[order], got.column("level").to_numpy().astype(np.uint8)[order]


def prefixes(texts: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, text_hash, n, k1, k2, bits, cold and hot ARRAY<BIGINT>: a set's size, name, bitmap and prefix (rare shingles, then frequent ones)."""
    held = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, levels = held.value
        maybe = np.zeros(1 << 24, bool)
        maybe[tokens >> U(40)] = True
        for rows, data, off in chunks(batches, "text", SLICE):
            sets = shingle_sets(data, off)
            names, bits, cold, hot = [], [], [], []
            for x in sets:
                length = _prefix_length(len(x))
                known = maybe[x >> U(40)]
                some, its = x[known], np.empty(0, np.uint8)
                if len(some):
                    at = np.minimum(np.searchsorted(tokens, some), len(tokens) - 1)
                    is_hot = tokens[at] == some
                    known[known] = is_hot
                    some, its = some[is_hot], levels[at[is_hot]]
                rare = x[~known][:length] if len(some) else x[:length]
                names.append(_class(x) if len(x) else (None, None))
                bits.append(_parity(x))
                cold.append(rare.view(np.int64))
                hot.append(some[np.lexsort((some, its))][: length - len(rare)].view(np.int64))
            k1, k2 = zip(*names, strict=True) if names else ((), ())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("text_hash"), pa.array([len(x) for x in sets], pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), _longs(bits), _longs(cold), _longs(hot)],
                names=["doc_id", "text_hash", "n", "k1", "k2", "bits", "cold", "hot"],
            )

    return texts.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, n int, k1 long, k2 long, bits array<long>, cold array<long>, hot array<long>")


def _band(n: Column) -> Column:
    """Size bands of factor 5/4."""
    return F.floor(F.log(1.25, n) + 1e-9).cast("int")


def _fits(na, nb, pa_, pb, least=F.least, greatest=F.greatest):
    """Sizes that can reach the threshold, and places of a first common shingle that can."""
    num, den = THRESHOLD
    return (least(na, nb) * den >= greatest(na, nb) * num) & (least(na - pa_, nb - pb) * (num + den) >= (na + nb) * num)


def _may_link(na: Column, nb: Column, xa: Column, xb: Column) -> Column:
    """Whether bitmaps allow a link: |A ^ B| >= differing bits, and a link needs |A ^ B| <= (|A| + |B|) / 9."""
    xor = lambda p, q: F.zip_with(p, q, lambda u, v: u.bitwiseXOR(v))

    def folded(p: Column, q: Column) -> Column:
        """p with its halves laid over each other if q is shorter: fitting sizes differ by one doubling at most."""
        half = F.size(q)
        return F.when(F.size(p) > half, xor(F.slice(p, F.lit(1), half), F.slice(p, half + 1, half))).otherwise(p)

    differ = F.aggregate(xor(folded(xa, xb), folded(xb, xa)), F.lit(0), lambda s, v: s + F.bit_count(v))
    over = THRESHOLD[0] + THRESHOLD[1]
    return differ * over <= (na + nb) * (over - 2 * THRESHOLD[0])


def _bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) whose bitmaps allow a link."""
    x = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    y = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    return pairs.distinct().join(x, "a").join(y, "b").where(_may_link(F.col("na"), F.col("nb"), F.col("xa"), F.col("xb"))).select("a", "b")


_TILE_NAMES = ["kind", "token", "a", "b", "n", "pos"]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, band, pos, n, cls) sorted in this order. Out: kind 0, pairs (a, b) of each row with its tile's first two rows and the
    first of the band below; kind 1, the rows of tokens that three rows or more have.

    Only the rows of one token that a batch may break off are held, and of a long one only its pivots."""
    names = ["token", "band", "pos", "n", "cls"]
    held: list[np.ndarray] = [np.empty(0, np.int64)] * 5
    skip, long = 0, False  # leading rows of ``held`` that are there as pivots only; whether its token has three rows already

    def out(cols: list[np.ndarray], skip: int, long: bool) -> pa.RecordBatch | None:
        token, band, pos, n, cls = cols
        m = len(token)
        if not m:
            return None
        new_token = np.concatenate(([True], token[1:] != token[:-1]))
        new_run = new_token | np.concatenate(([True], band[1:] != band[:-1]))
        first = np.flatnonzero(new_token)
        count = np.diff(np.append(first, m))[np.cumsum(new_token) - 1]
        run = np.flatnonzero(new_run)
        number = np.cumsum(new_run) - 1
        lead, at = run[number], np.arange(m)
        below = np.full(len(run), -1)
        if len(run) > 1:
            near = (token[run[1:]] == token[run[:-1]]) & (band[run[1:]] == band[run[:-1]] + 1)
            below[1:][near] = run[:-1][near]
        second = np.minimum(lead + 1, m - 1)
        x = np.concatenate([lead, np.where(number[second] == number, second, at), np.where(below[number] >= 0, below[number], at)])
        y = np.tile(at, 3)
        some = x != y
        x, y = x[some], y[some]
        ok = _fits(n[x], n[y], pos[x], pos[y], np.minimum, np.maximum) & (cls[x] != cls[y])
        a, b = np.minimum(cls[x], cls[y])[ok], np.maximum(cls[x], cls[y])[ok]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        if len(a):
            once = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            a, b = a[once], b[once]
        tile = count > 2
        if long:
            tile |= token == token[0]
        tile[:skip] = False
        none, some = np.zeros(len(a), np.int64), int(tile.sum())
        cols = [np.repeat([0, 1], [len(a), some]), np.concatenate([none, token[tile]]), np.concatenate([a, cls[tile]]), np.concatenate([b, np.zeros(some, np.int64)]), np.concatenate([none, n[tile]]), np.concatenate([none, pos[tile]])]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=_TILE_NAMES)

    for b in batches:
        cols = [np.concatenate([h, b.column(c).to_numpy().astype(np.int64)]) for h, c in zip(held, names, strict=True)]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut:
            if (done := out([c[:cut] for c in cols], skip, long)) is not None:
                yield done
            held, skip, long = [c[cut:] for c in cols], 0, False
        else:
            held = cols
        if len(held[0]) > 20_000:
            yield out(held, skip, True)
            last = held[1] == held[1][-1]
            at = np.flatnonzero(last)[:2]
            held, skip, long = [c[at] for c in held], len(at), True
    if (done := out(held, skip, long)) is not None:
        yield done


def _spokes(hot: DataFrame) -> DataFrame:
    """Pairs (a, b) of the classes of tiles of frequent shingles with their tile's pivots and those of the band below. Pivots are
    aggregated with map-side minima, so that one shingle may have any number of rows."""
    row = F.struct("pos", F.xxhash64("cls").alias("h"), "cls", "n")
    pivots = hot.groupBy("token", "band").agg(F.min(row).alias("p0"), F.min_by(row, F.xxhash64("cls")).alias("p1"))
    pivots = pivots.select("token", "band", F.explode(F.array("p0", "p1")).alias("p"))
    pivots = pivots.select("token", F.explode(F.array("band", F.col("band") + 1)).alias("band"), F.col("p.cls").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.pos").alias("pp"))
    met = hot.join(pivots, ["token", "band"]).where((F.col("cls") != F.col("pivot")) & _fits(F.col("n"), F.col("pn"), F.col("pos"), F.col("pp")))
    return met.select(F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b"))


def _links(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> tuple[DataFrame, str]:
    """The pairs (a, b) that really link, stored."""
    spark = texts.sparkSession
    named = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    wanted, wanted_path = stored(classes.select("k1", "k2", "cls", "least_doc").join(named, "cls"), "wanted")
    ids = wanted.select("least_doc").distinct()
    few = F.broadcast(ids) if wanted.count() <= WANTED else ids

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for _, data, off in chunks(batches, "text", SLICE):
            names, sets = [], []
            for x in shingle_sets(data, off):
                if len(x) and (c := _class(x)) not in seen:
                    seen.add(c)
                    names.append(c)
                    sets.append(x.tobytes())
            k1, k2 = zip(*names, strict=True) if names else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sets, pa.binary())], names=["k1", "k2", "ids"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for p, q in zip(b.column("p"), b.column("q"), strict=True):
                x, y = np.frombuffer(p.as_buffer(), U), np.frombuffer(q.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both * THRESHOLD[1] >= (len(x) + len(y) - both) * THRESHOLD[0])
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    asked = texts.join(few, texts.doc_id.eqNullSafe(F.col("least_doc")), "left_semi")
    built = asked.mapInArrow(build, "k1 long, k2 long, ids binary")
    once = built.dropDuplicates(["k1", "k2"])  # by the join's own key, so that sets are moved once
    sets, sets_path = stored(once.join(wanted.select("k1", "k2", "cls"), ["k1", "k2"]).select("cls", "ids"), "sets")
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("ids").alias("p")), "a").join(sets.select(F.col("cls").alias("b"), F.col("ids").alias("q")), "b")
    out = stored(both.select("a", "b", "p", "q").mapInArrow(verify, "a long, b long"), "links")
    forget(spark, wanted_path, sets_path)
    return out


def _squares(tiles: DataFrame, found: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (token, lo, hi, own, cls, n, pos, comp, bits) of the squares of tokens whose classes are in several components.

    Rows without a partner of fitting size and place in their square are left out before the bitmaps, by far the widest column, are joined."""
    comps = found.select(F.col("v").alias("cls"), "comp")
    now = tiles.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    sizes = now.groupBy("token", "comp").agg(F.count("*").alias("k"))
    sizes = sizes.groupBy("token").agg(F.sum("k").alias("all"), F.max("k").alias("most"), F.max_by("comp", F.struct("k", "comp")).alias("giant"), F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    sizes = sizes.select("token", "giant", blocks(F.col("all") - F.col("most")).alias("outside"), blocks(F.col("most")).alias("inside"))
    rows = now.join(sizes, "token")
    h, stray = F.xxhash64("cls", "token"), F.col("comp") != F.col("giant")
    own = F.when(stray, F.pmod(h, F.col("outside"))).otherwise(F.col("outside") + F.pmod(h, F.col("inside"))).cast("int")
    others = F.sequence(F.lit(0), F.when(stray, F.col("outside") + F.col("inside")).otherwise(F.col("outside")) - 1)
    rows = rows.withColumn("own", own).withColumn("other", F.explode(others))
    rows = rows.select("token", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "cls", "n", "pos", "comp")
    rows = rows.repartition(*_SQUARE).sortWithinPartitions(*_SQUARE).mapInArrow(_by_square(_partnered), "token long, lo int, hi int, own int, cls long, n int, pos int, comp long")
    rows = rows.join(classes.select("cls", "bits"), "cls")
    return rows.select(*_SQUARE, "own", "cls", "n", "pos", "comp", "bits").repartition(*_SQUARE).sortWithinPartitions(*_SQUARE)


def _differ(values: np.ndarray, off: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of the bitmaps of rows x and y; the longer one is folded to the length of the shorter."""
    width = np.diff(off)
    least = np.minimum(width[x], width[y])
    out = np.empty(len(x), np.int64)
    for w in np.unique(least).tolist():
        pairs = np.flatnonzero(least == w)
        rows, at = np.unique(np.concatenate([x[pairs], y[pairs]]), return_inverse=True)
        places = off[rows][:, None] + np.arange(w)
        m = values[places]
        wide = width[rows] > w
        m[wide] ^= values[places[wide] + w]
        left, right = at[: len(pairs)], at[len(pairs) :]
        step = max(1, 500_000 // w)
        for lo in range(0, len(pairs), step):
            out[pairs[lo : lo + step]] = np.bitwise_count(m[left[lo : lo + step]] ^ m[right[lo : lo + step]]).sum(axis=1)
    return out


_SQUARE = ["token", "lo", "hi"]


def _by_square(done):
    """A task over rows sorted by square: ``done`` gets whole squares as a table, its number columns, and the squares' numbers."""

    def numbered(t: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray]:
        c = {k: t.column(k).to_numpy().astype(np.int64) for k in (*_SQUARE, "own", "cls", "n", "pos", "comp")}
        new = np.concatenate(([False], np.any([c[k][1:] != c[k][:-1] for k in _SQUARE], axis=0)))
        return c, np.cumsum(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < 4 * BLOCK:  # a square has about two blocks of rows at most
                continue
            _, square = numbered(held)
            last = int(np.searchsorted(square, square[-1]))
            if last:
                whole = held.slice(0, last)
                yield from done(whole, *numbered(whole))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from done(held, *numbered(held))

    return run


def _fitting(c: dict[str, np.ndarray], square: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (x, y) of a square, of different components, whose sizes and places allow a link."""
    m = len(square)
    edges = np.flatnonzero(np.concatenate(([True], square[1:] != square[:-1])))
    size = np.diff(np.append(edges, m))[square - square[0]]

    def keep(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (c["comp"][x] != c["comp"][y]) & ((c["own"][x] != c["own"][y]) | (c["lo"][x] == c["hi"][x])) & (c["cls"][x] != c["cls"][y])
        x, y = x[ok], y[ok]
        ok = _fits(c["n"][x], c["n"][y], c["pos"][x], c["pos"][y], np.minimum, np.maximum)
        return x[ok], y[ok]

    small = np.flatnonzero(size <= 48)
    for step in range(1, 48):
        x = small[small + step < m]
        x = x[square[x] == square[x + step]]
        if not len(x):
            break
        yield keep(x, x + step)
    for lo in edges[size[edges] > 48].tolist():
        hi = lo + int(size[lo])
        for i in range(lo, hi, 128):
            x, y = np.meshgrid(np.arange(i, min(i + 128, hi)), np.arange(i, hi), indexing="ij")
            up = x < y
            yield keep(x[up], y[up])


def _partnered(t: pa.Table, c: dict[str, np.ndarray], square: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows that have a fitting partner."""
    some = np.zeros(len(square), bool)
    for x, y in _fitting(c, square):
        some[x] = some[y] = True
    yield from t.filter(pa.array(some)).to_batches()


def _within_squares(best: bool):
    """A task over rows of squares: pairs (a, b) of different components that places and bitmaps allow. If ``best``, each row's two best,
    and the tokens of squares that have more (with null a and b)."""

    def pairs(t: pa.Table, c: dict[str, np.ndarray], square: np.ndarray) -> Iterator[pa.RecordBatch]:
        bits = t.column("bits").combine_chunks()
        bits = pa.concat_arrays(bits.chunks) if isinstance(bits, pa.ChunkedArray) else bits
        off, values = bits.offsets.to_numpy().astype(np.int64), bits.values.to_numpy().view(U)
        found: list[np.ndarray] = []
        for x, y in _fitting(c, square):
            if len(x):
                d = _differ(values, off, x, y)
                ok = d * (THRESHOLD[0] + THRESHOLD[1]) <= (c["n"][x] + c["n"][y]) * (THRESHOLD[1] - THRESHOLD[0])
                found.append(np.stack([x[ok], y[ok], d[ok]]))
        x, y, d = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        more = np.zeros(0, np.int64)
        if best and len(x):
            row, pair = np.concatenate([x, y]), np.tile(np.arange(len(x)), 2)
            order = np.lexsort((np.tile(d, 2), row))
            row, pair = row[order], pair[order]
            first = np.concatenate(([True, True], row[2:] != row[:-2]))
            taken = np.zeros(len(x), bool)
            taken[pair[first]] = True
            more = np.unique(c["token"][x[~taken]])
            x, y = x[taken], y[taken]
        a, b = c["cls"][x], c["cls"][y]
        columns = [pa.concat_arrays([pa.array(u), pa.nulls(len(more), pa.int64())]) for u in (np.minimum(a, b), np.maximum(a, b))]
        yield pa.RecordBatch.from_arrays([*columns, pa.concat_arrays([pa.nulls(len(x), pa.int64()), pa.array(more)])], names=["a", "b", "token"])

    return _by_square(pairs)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, component, text_hash for every row. Ids may repeat: ``component`` names a component whatever the
    ids in it (null: no shingles), and the hash tells rows apart that share an id."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base, base_path = stored(prefixes(texts, frequent_shingles(texts)).withColumn("rid", F.monotonically_increasing_id()), "prefixes")
    same = base.where("n > 0").groupBy("k1", "k2")
    classes, class_path = stored(same.agg(F.min("rid").alias("cls"), F.min("doc_id").alias("least_doc"), *(F.first(c).alias(c) for c in ("n", "bits", "cold", "hot"))), "classes")
    # Tiles of rare shingles, which few classes have, go by shingle; those of frequent ones are aggregated first.
    rows = lambda column: classes.select(F.posexplode(column).alias("at", "token"), (F.lit(0) if column == "cold" else F.size("cold")).alias("base"), "n", "cls").select("token", _band(F.col("n")).alias("band"), (F.col("at") + F.col("base")).alias("pos"), "n", "cls")
    rare = rows("cold").repartition("token").sortWithinPartitions("token", "band", "pos", "cls")
    rare, rare_path = stored(rare.mapInArrow(_runs, "kind int, token long, a long, b long, n int, pos int"), "tiles")
    hot, hot_path = stored(rows("hot"), "tiles")
    tried, tried_path = stored(_bounded(rare.where("kind = 0").select("a", "b").unionByName(_spokes(hot)), classes), "pairs")
    links, links_path = _links(tried, classes, texts)
    found = components(links)
    forget(spark, tried_path, links_path)
    tiles = rare.where("kind = 1").select("token", F.col("a").alias("cls"), "n", "pos").unionByName(hot.select("token", "cls", "n", "pos"))
    rest_paths: list[str] = []
    for best in (True, False):  # what is still apart and has pairs that were not tried meets in full, so that no link is lost
        rest, rest_path = stored(_squares(tiles, found, classes).mapInArrow(_within_squares(best), "a long, b long, token long").distinct(), "pairs")
        rest_paths.append(rest_path)
        if rest.isEmpty():
            break
        more, more_path = _links(rest.where("token IS NULL").select("a", "b"), classes, texts)
        # Components of components: the new links run between those found so far.
        of = found.select(F.col("v").alias("x"), "comp")
        for end in ("a", "b"):
            more = more.join(of, F.col(end) == F.col("x"), "left").withColumn(end, F.coalesce("comp", end)).select("a", "b")
        merged = components(more).select(F.col("v").alias("old"), F.col("comp").alias("new"))
        alone = merged.join(found.select(F.col("v").alias("old")), "old", "left_anti").select(F.col("old").alias("v"), F.col("new").alias("comp"))
        found, _ = stored(found.join(merged, F.col("comp") == F.col("old"), "left").select("v", F.coalesce("new", "comp").alias("comp")).unionByName(alone), "components")
        forget(spark, more_path)
        untried = rest.where("token IS NOT NULL").select("token")
        if untried.isEmpty():
            break
        tiles = tiles.join(untried, "token", "left_semi")
    forget(spark, *rest_paths)
    named = classes.select("k1", "k2", "cls", "least_doc").join(found.select(F.col("v").alias("cls"), "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least, least_path = stored(named.groupBy("comp").agg(F.min("least_doc").alias("component_id")), "least")  # a plain table, so that Spark can split a large component
    named, named_path = stored(named.join(least, "comp").select("k1", "k2", "component_id", F.col("comp").alias("component")), "named")
    forget(spark, class_path, rare_path, hot_path, least_path)
    members = base.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "k1", "k2", "text_hash")
    out = members.join(named, ["k1", "k2"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "component", "text_hash")
    out, _ = stored(out, "groups")
    forget(spark, base_path, named_path)
    return out

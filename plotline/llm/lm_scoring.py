"""LM scoring: stupid-backoff scores from n-gram count tables, computed relationally.

Words are maximal runs of characters other than ASCII white space, with A-Z lowered; every word of the corpus is known. The score of
a bigram (word, next word) is count(a b) / count(a) if the bigram occurs at least ``MIN_COUNT`` times, else BACKOFF * count(b) / words;
the first word of a document has count(b) / words. Logarithms are summed per document and divided by its words.

A document is exploded into its distinct bigrams with their numbers of occurrences, partitioned by hash of the bigram. The count table
of the bigrams is aggregated over these partitions and joined to them there, so that the exploded rows move once. Word counts are
aggregated from each task's own sums; those of the most frequent words (at most ``VOCABULARY``) are broadcast as numbers, all others
are joined by hash to one row for each document and word that asks for them.
Hot keys: bigrams that repeat within tasks are looked for first; the most frequent (at most ``HOT``) are counted exactly, summed in each
task, and broadcast, so that their rows never move. What is left of a bigram is a few in ``HOT`` of all rows at most, however many copies
of a text the corpus holds.

Cases: null, empty and white-space texts have no words and score null. Repeated rows count as separate documents. Ids may be null. Very
long texts are one document each, held alone. An empty table gives no rows. Other columns than ``doc_id`` and ``text`` are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm._text import U, chunks, span_hash, splitmix, words
from plotline.session import forget, stored

#: Words and bigrams whose counts are broadcast (16 bytes each).
VOCABULARY, HOT = 1 << 19, 1 << 20
#: Occurrences within a task's share from which a bigram may be among the most frequent ones.
REPEATS = 3
MIN_COUNT = 2
BACKOFF = 0.4
#: Distinct n-grams that a task counts before it sends its sums and begins anew.
WINDOW = 1_000_000
#: Stand before the first word of a document, and for facts about a document. Numbers are small, names of words negative.
START, WORDS, ID, SCORE = ((1 << 62) + i for i in range(4))
#: Logarithms are carried as whole numbers of this fraction.
UNIT = 1e-9


def _named(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Negative 64-bit names of words."""
    return span_hash(data, starts, ends).view(np.int64) | np.int64(-1 << 63)


def _pairs(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words that have one before them in their document, and the names of these bigrams."""
    at = np.ones(len(h), bool)
    at[first[:-1][first[1:] > first[:-1]]] = False
    at = np.flatnonzero(at)
    return at, splitmix(h[at - 1].view(U) * U(0x9E3779B97F4A7C15) + h[at].view(U)).view(np.int64)


class Index:
    """Places of names in a sorted array, by a table of their low bits; -1 for others."""

    BITS = 22

    def __init__(self, names: np.ndarray):
        self.names = names
        self.table = np.full(1 << self.BITS, -1, np.int32)
        self.table[names & ((1 << self.BITS) - 1)] = np.arange(len(names), dtype=np.int32)

    def find(self, x: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.full(len(x), -1)
        at = self.table[x & ((1 << self.BITS) - 1)].astype(np.int64)
        unsure = np.flatnonzero((at >= 0) & (self.names[at] != x))
        place = np.minimum(np.searchsorted(self.names, x[unsure]), len(self.names) - 1)
        at[unsure] = np.where(self.names[place] == x[unsure], place, -1)
        return at


class _Counter:
    """Counts of 64-bit names, merged now and then."""

    def __init__(self):
        self.have, self.n, self.waiting = np.empty(0, np.int64), np.empty(0, np.int64), []

    def add(self, names: np.ndarray) -> bool:
        """Whether it is full."""
        self.waiting.append(names)
        if sum(map(len, self.waiting)) > 1_000_000:
            self.merge()
        return len(self.have) > WINDOW

    def merge(self) -> None:
        if self.waiting:
            u, c = np.unique(np.concatenate(self.waiting), return_counts=True)
            self.have, at = np.unique(np.concatenate([self.have, u]), return_inverse=True)
            self.n = np.bincount(at, weights=np.concatenate([self.n, c]), minlength=len(self.have)).astype(np.int64)
            self.waiting.clear()


def gram_counts(texts: DataFrame) -> DataFrame:
    """size (1 or 2), gram (its name), n, before: occurrences of every word, and of the bigrams as far as they repeat in a task's
    share. ``before`` is the name of a bigram's first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, firsts = (_Counter(), _Counter()), {}

        def sums(size: int) -> Iterator[pa.RecordBatch]:
            c = counters[size - 1]
            c.merge()
            some = np.flatnonzero(c.n >= (1 if size == 1 else REPEATS))
            for lo in range(0, len(some), 500_000):
                at = some[lo : lo + 500_000]
                before = pa.nulls(len(at), pa.int64()) if size == 1 else pa.array(first_words(c.have[at]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), pa.array(c.have[at]), pa.array(c.n[at]), before], names=["size", "gram", "n", "before"])
            counters[size - 1].__init__()
            firsts.clear() if size == 2 else None

        def first_words(grams: np.ndarray) -> np.ndarray:
            names, before = (np.concatenate(x) for x in zip(*firsts.values(), strict=True))
            order = np.argsort(names, kind="stable")
            return before[order][np.searchsorted(names, grams, sorter=order)]

        for k, (_, data, off) in enumerate(chunks(batches, "text")):
            starts, ends, first = words(data, off)
            h = _named(data, starts, ends)
            at, pairs = _pairs(h, first)
            names, place = np.unique(pairs, return_index=True)
            firsts[k] = names, h[at[place] - 1]
            if counters[0].add(h):
                yield from sums(1)
            if counters[1].add(pairs):
                yield from sums(2)
        for size in (1, 2):
            yield from sums(size)

    found = texts.mapInArrow(run, "size int, gram long, n long, before long")
    return found.groupBy("size", "gram").agg(F.sum("n").alias("n"), F.first("before").alias("before"))


def _most_frequent(counts: DataFrame, most: int) -> pa.Table:
    """gram, n, before of the most frequent n-grams, at most ``most`` of them, by steps of a sixteenth of a doubling."""
    level = F.floor(16 * F.log2("n")).cast("int")
    held, floor = 0, None
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 1,024 rows
        if held + r["count"] > most:
            break
        held, floor = held + r["count"], r.level
    return counts.where(level >= (floor if floor is not None else 1 << 20)).select("gram", "n", "before").toArrow()


def hot_bigrams(texts: DataFrame, candidates: pa.Table, known: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted names of the candidates whose first word has a number, and the logarithms of their scores, from exact counts."""
    names, before = candidates.column("gram").to_numpy(), candidates.column("before").to_numpy()
    first = Index(known).find(before)
    order = np.argsort(names[first >= 0])
    names, first = names[first >= 0][order], first[first >= 0][order]
    held = texts.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(held.value)
        total = np.zeros(len(held.value), np.int64)
        for _, data, off in chunks(batches, "text"):
            starts, ends, first = words(data, off)
            at = index.find(_pairs(_named(data, starts, ends), first)[1])
            total += np.bincount(at[at >= 0], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["k", "n"])

    got = texts.mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # at most HOT rows
    count = np.ones(len(names), np.int64)
    count[got.column("k").to_numpy()] = got.column("n").to_numpy()
    return names, np.log(count) - np.log(n[first])


def exploded(texts: DataFrame, known: tuple[np.ndarray, np.ndarray], hot: tuple[np.ndarray, np.ndarray], total: int) -> DataFrame:
    """rid, a, b, m. A row for each distinct bigram (a, b) of a document that is not hot, m times in it; START stands before a first word
    without a number. Facts about a document (b says which): its number of words, its id, and the logarithms that need no table, of its
    first word, if that has a number, and of its hot bigrams."""
    held = texts.sparkSession.sparkContext.broadcast((*known, *hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, n, hot_names, hot_log = held.value
        index, hot_index = Index(vocabulary), Index(hot_names)
        unigram = np.log(np.maximum(n, 1)) - np.log(max(total, 1))
        for rows, data, off in chunks(batches, "text"):
            starts, ends, first = words(data, off)
            h = _named(data, starts, ends)
            docs, size = len(first) - 1, np.diff(first)
            doc = np.repeat(np.arange(docs), size)
            ids = index.find(h)
            others, local = np.unique(h[ids < 0], return_inverse=True)  # words without a number, numbered within the slice
            ids[ids < 0] = len(vocabulary) + local
            at, names = _pairs(h, first)
            place = hot_index.find(names)
            score = np.bincount(doc[at[place >= 0]], weights=hot_log[place[place >= 0]], minlength=docs).astype(np.float64)
            at = at[place < 0]
            heads = first[:-1][size > 0]
            easy = ids[heads] < len(vocabulary)
            score[doc[heads[easy]]] += unigram[ids[heads[easy]]]
            heads = heads[~easy]
            start = len(vocabulary) + len(others)
            who, a, b = np.concatenate([doc[at], doc[heads]]), np.concatenate([ids[at - 1], np.full(len(heads), start)]), np.concatenate([ids[at], ids[heads]])
            side = start + 1
            if docs * side**2 < 1 << 63:
                key, m = np.unique((who * side + a) * side + b, return_counts=True)
                who, a, b = key // side**2, key // side % side, key % side
            else:
                (who, a, b), m = np.unique(np.stack([who, a, b]), axis=1, return_counts=True)
            outer = np.concatenate([np.arange(len(vocabulary)), others, [START]])
            rid, own = rows.column("rid"), rows.column("doc_id")
            facts = ((WORDS, pa.array(size)), (ID, own), (SCORE, pa.array(np.round(score / UNIT).astype(np.int64))))
            for what, m_ in facts:
                yield pa.RecordBatch.from_arrays([rid, rid, pa.array(np.full(docs, what)), m_], names=_NAMES)
            yield pa.RecordBatch.from_arrays([rid.take(pa.array(who)), pa.array(outer[a]), pa.array(outer[b]), pa.array(m)], names=_NAMES)

    return texts.mapInArrow(run, "rid long, a long, b long, m long")


_NAMES = ["rid", "a", "b", "m"]


def stupid_backoff(docs: DataFrame, most: int = VOCABULARY, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, score (mean log score of its words) of every row, under the counts of all rows."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts, path = stored(gram_counts(texts), "grams")
    single = counts.where("size = 1")
    total = single.agg(F.sum("n").alias("n")).first().n or 0
    frequent = _most_frequent(single, most)
    order = np.argsort(frequent.column("gram").to_numpy())
    known, n = frequent.column("gram").to_numpy()[order], frequent.column("n").to_numpy()[order]
    candidates = _most_frequent(counts.where(f"size = 2 AND n >= {MIN_COUNT}"), hot)
    rows = exploded(texts.withColumn("rid", F.monotonically_increasing_id()), (known, n), hot_bigrams(texts, candidates, known, n), total)
    # One exchange holds the exploded bigrams and, aggregated over it, their count table: both sides of the join read the same columns
    # (``last`` is there for that alone, and always holds), so Spark shuffles them once.
    rows = rows.where("rid IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL").repartition("a", "b")
    # The count table grows with the corpus and is never broadcast: each partition's part is hashed beside its rows, and nothing is sorted.
    table = rows.groupBy("a", "b").agg(F.sum("m").alias("c_ab"), F.max("rid").alias("last")).hint("shuffle_hash")
    counted = rows.alias("r").join(table.alias("t"), (F.col("r.a") == F.col("t.a")) & (F.col("r.b") == F.col("t.b")) & (F.col("r.rid") <= F.col("t.last"))).select("rid", "r.a", "r.b", "m", "c_ab")
    # The logarithm of a score takes in that of one word's count: less that of the first, or else that of the second word.
    fact, first, often = F.col("b") > START, F.col("a") == START, F.col("c_ab") >= MIN_COUNT
    of_first = ~first & often
    counted = counted.withColumns({"needed": F.when(fact, None).when(of_first, F.col("a")).otherwise(F.col("b")), "sign": F.when(of_first, -F.col("m")).otherwise(F.col("m"))})
    words_log = float(np.log(max(total, 1)))
    base = F.col("m") * F.when(first, F.lit(-words_log)).when(often, F.log("c_ab")).otherwise(F.lit(float(np.log(BACKOFF)) - words_log))
    numbers = spark.createDataFrame(pa.table({"needed": pa.array(np.arange(len(n))), "log_c": pa.array(np.log(n), pa.float64())}))  # at most VOCABULARY rows
    counted = counted.join(F.broadcast(numbers), "needed", "left")
    known_log = F.when(F.col("b") == SCORE, F.col("m") * UNIT).otherwise(0.0)
    log = F.when(fact, known_log).otherwise(base + F.coalesce(F.col("sign") * F.col("log_c"), F.lit(0.0)))
    late = F.col("needed") < 0  # words without a number: their counts are joined to one row for each document and word
    said = lambda what: F.max(F.when(F.col("b") == what, F.col("m")))
    asked = counted.groupBy("rid", F.when(late, F.col("needed")).alias("word")).agg(
        said(ID).alias("doc_id"), said(WORDS).alias("n_words"), F.sum(log).alias("log_score"), F.sum(F.when(late, F.col("sign"))).alias("times")
    )
    asked, _ = stored(asked, "asked")
    found = asked.where("word IS NOT NULL").join(single.select(F.col("gram").alias("word"), "n"), "word").withColumn("log_score", F.col("log_score") + F.col("times") * F.log("n"))
    found, _ = stored(found.groupBy("rid").agg(F.sum("log_score").alias("more")), "found")
    forget(spark, path)
    sums = asked.where("word IS NULL").join(found, "rid", "left")  # every document has one such row
    score = (F.col("log_score") + F.coalesce("more", F.lit(0.0))) / F.col("n_words")
    return sums.select("doc_id", "n_words", F.when(F.col("n_words") > 0, F.round(score, 6)).alias("score"))

"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a document are the distinct hashes of its words, neighbouring pairs and pairs that skip one or two words, folded to
``2**BITS`` coordinates. Every coordinate has its own learning rate, and the L1 term keeps most weights at exactly zero, so the
model is a short list of (coordinate, weight) that is broadcast. Learning runs over at most ``sample`` labelled rows (the
documented bound: different texts with the lowest hashes of their ids, then of their texts); scoring runs over every row's whole text,
without a shuffle.

Cases: a null or empty text has no features and scores the model's bias. A null label is ignored; a document with several label
rows counts as toxic if any says so. Repeated documents give repeated rows, and one lesson; an id with many texts gives no more lessons than
``sample`` allows. Very long texts are single rows, scored whole and one at a time. Scores may tie; nothing depends on their order. An empty
table gives no rows. Without labels of both classes every score is 0.5 times 0.9, below the threshold. Input columns other than
``doc_id`` and ``text`` are never read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm._text import U, chunks, per_doc, span_hash, spans, splitmix
from plotline.llm.quality import is_held_out

BITS = 20
#: Features are looked for inside words of letters and digits; other ASCII marks separate.
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SKIP_MULTIPLIERS = (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC13FA9A902A6328F)


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of every word, pair and skip-gram, document by document, and where each document's begin."""
    starts, ends, first = spans(_TOKEN[data], off)
    h = span_hash(data, starts, ends)
    n = np.diff(first)
    sizes = [n] + [np.maximum(n - k, 0) for k in (1, 2, 3)]
    bounds = np.concatenate([[0], np.cumsum(sum(sizes))])
    out = np.empty(bounds[-1], np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    rank = np.arange(len(h)) - first[:-1][doc]
    base = bounds[:-1].copy()
    shift = U(64 - BITS)
    out[base[doc] + rank] = h >> shift
    base += sizes[0]
    for k, c in zip((1, 2, 3), _SKIP_MULTIPLIERS, strict=True):
        ok = rank < n[doc] - k
        at = np.flatnonzero(ok)
        out[base[doc[at]] + rank[at]] = splitmix(h[at] * U(c) + h[at + k]) >> shift
        base += sizes[k]
    return out, bounds


class Ftrl:
    """FTRL-proximal with binary features; ``weights`` are derived from (z, n) when they are read."""

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, positive: float = 2.0, size: int = (1 << BITS) + 1):
        self.alpha, self.beta, self.l1, self.l2, self.positive = alpha, beta, l1, l2, positive
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        free = np.maximum(np.abs(z) - self.l1, 0)
        return -np.sign(z) * free / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        g *= self.positive if y > 0.5 else 1.0  # toxic rows are the rarer ones
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(sampled: DataFrame, passes: int = 4) -> dict[str, list]:
    """Sparse weights from rows (text, label, ord). The rows must be few: FTRL sees them one after another, in one task. They are
    moved there by a shuffle, so that what selects them stays parallel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple[int, np.ndarray, float]] = []
        for rows, data, off in chunks(batches, "text"):
            at, bounds = features(data, off)
            y, order = rows.column("label").to_pylist(), rows.column("ord").to_pylist()
            seen += [(order[i], np.unique(at[bounds[i] : bounds[i + 1]]).astype(np.int32), y[i]) for i in range(len(y))]
        model = Ftrl()
        bias = 1 << BITS
        rng = np.random.default_rng(7)
        seen.sort(key=lambda x: (x[0], len(x[1]), x[1].tobytes()))  # an order that doesn't depend on how rows arrive
        for _ in range(passes if len({x[2] for x in seen}) == 2 else 0):
            for i in rng.permutation(len(seen)):
                model.learn(np.append(seen[i][1], bias), seen[i][2])
        w = model.weights(slice(None))
        nz = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([nz], pa.list_(pa.int64())), pa.array([w[nz]], pa.list_(pa.float64())), pa.array([len(seen)])], names=["at", "w", "n"])

    got = sampled.repartition(1).mapInArrow(run, "at array<long>, w array<double>, n long").collect()
    return {"at": got[0].at, "w": got[0].w} if got else {"at": [], "w": []}


def bounded_sample(labels: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` rows of (doc_id, label): those with the lowest hashes of their ids; it is small enough to broadcast."""
    labels = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").cast("double").alias("label"))
    order = F.xxhash64("doc_id")
    return labels.select("doc_id", "label", order.alias("ord")).orderBy("ord", "doc_id").limit(sample)


def lessons(docs: DataFrame, few: DataFrame, sample: int) -> DataFrame:
    """text, label, ord of at most ``sample`` rows of ``docs`` whose ids are in ``few`` (doc_id, label, ord), each text of an id once: ids may repeat in
    the documents, so the rows are bounded after they have met. Only hashes are sorted; texts move for the rows that stay."""
    x = docs.withColumn("_hash", F.xxhash64("text"))
    keys = x.select("doc_id", "_hash").join(few, "doc_id").distinct().orderBy("ord", "_hash", "doc_id").limit(sample)
    return x.join(F.broadcast(keys), ["doc_id", "_hash"]).dropDuplicates(["doc_id", "_hash"]).select("text", "label", "ord")


def score(docs: DataFrame, model: dict[str, list]) -> DataFrame:
    """doc_id, text_hash, score: the logistic of the summed weights of a document's distinct features."""
    at, w = np.array(model["at"], np.int64), np.array(model["w"], float)
    held = docs.sparkSession.sparkContext.broadcast((at, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = held.value
        dense = np.zeros((1 << BITS) + 1)
        dense[at] = w
        bias = dense[1 << BITS] if len(at) else np.log(0.45 / 0.55)
        heavy = dense != 0
        for rows, data, off in chunks(batches, "text"):
            f, bounds = features(data, off)
            hit = np.flatnonzero(heavy[f])  # few: most weights are zero
            doc = np.searchsorted(bounds, hit, side="right") - 1
            key = np.unique(doc * (1 << 21) + f[hit])
            doc, f = key >> 21, key & ((1 << 21) - 1)
            total = bias + per_doc(dense[f], np.searchsorted(doc, np.arange(rows.num_rows + 1)))
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_hash"), pa.array(p)], names=["doc_id", "text_hash", "score"])

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, score double")


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = 12_000, passes: int = 4) -> DataFrame:
    """doc_id, held_out, score, predicted, text_hash for every row of ``docs``, learnt from ``labels`` (doc_id, toxic) outside the held-out
    fold, over at most ``sample`` of them."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("label")).where(~is_held_out())
    few = F.broadcast(bounded_sample(taught, sample))  # at most `sample` rows of 24 bytes
    model = train(lessons(docs, few, sample), passes)
    return score(docs, model).select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "text_hash")

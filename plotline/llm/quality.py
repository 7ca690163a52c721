"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each document becomes a vector of ``len(STATISTICS)`` statistics of its whole text. Per class the mean and the covariance
are gathered in one aggregation over all labelled rows (counts, sums and outer products: a few kilobytes for each task);
covariances are shrunk towards the pooled one and a multiple of the identity; scores are differences of Mahalanobis
log-densities with the Cholesky factors computed once.

Cases: a null or empty text has all-zero counts and gets a score like any other. A null label is ignored; a document with several label rows counts as
good only if all of them do. Repeated documents give repeated rows. Very long texts are single rows, read whole and one at a time. Scores
may tie; nothing depends on their order. An empty table gives no rows. Without labels of both classes every score is 0.5.
Columns of the input other than ``doc_id`` and ``text`` are never read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm._text import IS_WORD, chunks, owners, per_doc, span_hash, spans, words
from plotline.session import stored

STATISTICS = (
    "words", "word_length", "word_length_sd", "punctuation", "symbols", "digits", "upper", "no_letter", "distinct", "top_word",
    "line_length", "repeated_lines", "repeated_pairs", "space", "end_marks", "non_ascii", "sentence", "short_words", "long_words", "lines",
)
_ASCII = np.arange(256)
_PUNCT = np.isin(_ASCII, np.frombuffer(b".,;:!?'\"()-", np.uint8))
_DIGIT = (_ASCII >= 48) & (_ASCII < 58)
_UPPER = (_ASCII >= 65) & (_ASCII < 91)
_LETTER = _UPPER | ((_ASCII >= 97) & (_ASCII < 123)) | (_ASCII >= 128)
_SYMBOL = (_ASCII > 32) & (_ASCII < 127) & ~_PUNCT & ~_DIGIT & ~_LETTER
_STOP = np.isin(_ASCII, np.frombuffer(b".!?", np.uint8))
_LINE = _ASCII != 10


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """A smoothed log-odds of part in whole: small shares are told apart, 0 and 1 stay finite."""
    part = np.minimum(part, whole)
    return np.log((part + 0.5) / (whole - part + 0.5 + 1e-9 * whole)).clip(-12, 12)


def _repeats(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document: how many different hashes it has, and how often its most frequent one occurs."""
    if len(h) == 0:
        return np.zeros(n), np.zeros(n)
    key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    d = (key[at] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, d, np.diff(np.append(at, len(key))))
    return np.bincount(d, minlength=n).astype(float), most


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents, len(STATISTICS)) of a flat text column."""
    n, size = len(off) - 1, np.diff(off).astype(float)
    starts, ends, first = words(data, off)
    doc, length, count = owners(first), (ends - starts).astype(float), np.diff(first).astype(float)
    some = np.maximum(count, 1)
    kind = lambda table: per_doc(table[data].astype(np.float64), off)
    mean = per_doc(length, first) / some
    sd = np.sqrt(np.maximum(per_doc(length * length, first) / some - mean * mean, 0))
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    h = span_hash(data, starts, ends)
    distinct, top = _repeats(h, doc, n)
    same = doc[1:] == doc[:-1]
    pairs, _ = _repeats((h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[same], doc[1:][same], n)
    lo, hi, line_first = spans(_LINE[data], off)
    lines = np.diff(line_first).astype(float)
    kept, _ = _repeats(span_hash(data, lo, hi), owners(line_first), n)
    n_letters, n_pairs = kind(_LETTER), np.maximum(count - 1, 0)
    last = data[ends - 1] if len(ends) else np.empty(0, np.uint8)
    return np.stack([
        np.log1p(count), np.log1p(mean), np.log1p(sd), _share(kind(_PUNCT), size), _share(kind(_SYMBOL), size), _share(kind(_DIGIT), size),
        _share(kind(_UPPER), n_letters), _share(per_doc((letters[ends] == letters[starts]) * 1.0, first), count),
        _share(distinct, count), _share(top, count), np.log1p(size / np.maximum(lines, 1)), _share(lines - kept, lines),
        _share(n_pairs - pairs, n_pairs), _share(size - kind(IS_WORD), size), _share(per_doc((_PUNCT[last] | _SYMBOL[last]) * 1.0, first), count),
        _share(kind(_ASCII >= 128), size), np.log1p(count / (kind(_STOP) + 1)), _share(per_doc((length <= 3) * 1.0, first), count),
        _share(per_doc((length > 14) * 1.0, first), count), np.log1p(lines),
    ], axis=1)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, stats ARRAY<DOUBLE>: one pass over the texts, no shuffle. The hash tells rows apart that share an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches, "text"):
            x = statistics(data, off)
            stats = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_hash"), stats], names=["doc_id", "text_hash", "stats"])

    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return docs.mapInArrow(run, "doc_id long, text_hash long, stats array<double>")


@dataclass
class QuadraticDiscriminant:
    """log prior, mean and inverse Cholesky factor of each class; ``score`` is the posterior of class 1."""

    prior: np.ndarray
    mean: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray

    @staticmethod
    def fit(n: np.ndarray, sums: np.ndarray, outer: np.ndarray, shrink: float, ridge: float) -> QuadraticDiscriminant | None:
        if (n < 2).any():
            return None
        d = sums.shape[1]
        mean = sums / n[:, None]
        cov = outer / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
        pooled = (cov * n[:, None, None]).sum(0) / n.sum()
        scale = np.trace(pooled) / d or 1.0
        weight = shrink + (1 - shrink) * d / (d + n)  # small classes lean more on the pooled covariance
        cov = (1 - weight)[:, None, None] * cov + weight[:, None, None] * pooled + ridge * scale * np.eye(d)
        low = np.linalg.cholesky(cov)
        return QuadraticDiscriminant(np.log(n / n.sum()), mean, np.linalg.inv(low), 2 * np.log(np.diagonal(low, axis1=1, axis2=2)).sum(1))

    def score(self, x: np.ndarray, temper: float = 1.0) -> np.ndarray:
        logs = []
        for k in (0, 1):
            z = np.einsum("ij,kj->ik", x - self.mean[k], self.whiten[k])
            logs.append(self.prior[k] - 0.5 * self.log_det[k] - 0.5 * np.einsum("ij,ij->i", z, z))
        return 1 / (1 + np.exp(np.clip((logs[0] - logs[1]) * temper, -500, 500)))


def _moments(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, sums and outer products of each class over all labelled rows; each task sends one row for each class."""
    d = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, outer = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for b in batches:
            x = np.asarray(b.column("stats").flatten()).reshape(-1, d)
            y = np.asarray(b.column("label"))
            for k in (0, 1):
                part = x[y == k]
                n[k] += len(part)
                sums[k] += part.sum(0)
                outer[k] += part.T @ part
        m = [np.concatenate([[n[k]], sums[k], outer[k].ravel()]) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([x.tolist() for x in m], pa.list_(pa.float64()))], names=["label", "m"])

    rows = labelled.mapInArrow(run, "label long, m array<double>").select("label", F.posexplode("m").alias("i", "v"))
    total = np.zeros((2, 1 + d + d * d))
    for r in rows.groupBy("label", "i").agg(F.sum("v").alias("v")).collect():  # 2 * (1 + d + d * d) numbers
        total[r.label, r.i] = r.v
    return total[:, 0], total[:, 1 : d + 1], total[:, d + 1 :].reshape(2, d, d)


def train(stats: DataFrame, labels: DataFrame, shrink: float = 0.3, ridge: float = 1e-3) -> QuadraticDiscriminant | None:
    """Fit on the rows of ``stats`` that ``labels`` (doc_id, label) names; both may hold repeated ids."""
    labels = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").cast("long").alias("label"))
    return QuadraticDiscriminant.fit(*_moments(stats.join(labels, "doc_id").select("stats", "label")), shrink, ridge)


def score(stats: DataFrame, model: QuadraticDiscriminant | None, temper: float = 0.3) -> DataFrame:
    """doc_id, text_hash, score. ``temper`` flattens log-density ratios, which correlated statistics exaggerate."""
    d = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column("stats").flatten()).reshape(-1, d)
            p = np.full(len(x), 0.5) if model is None else model.score(x, temper)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(p)], names=["doc_id", "text_hash", "score"])

    return stats.mapInArrow(run, "doc_id long, text_hash long, score double")


def is_held_out(column: str = "doc_id", folds: int = 5):
    """Rows whose crc32(doc_id as text) is divisible by ``folds`` teach nothing; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds == 0, F.lit(False))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, text_hash for every row of ``docs``, learnt from ``labels`` (doc_id, quality) outside the
    held-out fold."""
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).where(~is_held_out())
    stats, _ = stored(document_statistics(docs), "stats")
    model = train(stats, taught)
    return score(stats, model).select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "text_hash")

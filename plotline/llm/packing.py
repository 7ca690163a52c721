"""Best-fit packing, bulk-synchronously.

Documents are tokenised, ended by id 0, and cut into pieces only if they are longer than a sequence. The pieces are range-sorted by
size over Spark's partitions, which ranks them among those of their size. As sizes are bounded by the sequence length, pieces and
gaps sorted by size are at most ``capacity`` runs of equal size each, whatever the corpus: a sweep matches runs, not rows. In a round
every run of pieces, from the largest, goes to its successor among the gaps (the tightest room that holds it); where several runs
want one run of gaps, rank decides: the larger pieces, then the lower ranks, come first, and the others go to the next room. After
the sweep the gaps that took a piece have what is left of their room, and the next round begins; gaps that took nothing have no piece
that fits and never will. When no gap is left, as many new sequences are opened as the rest needs at least. A matched run says which
ranks of a size go to which sequences; it is broadcast (its number is bounded by sizes and rounds), and every piece finds its run by
its rank, where it lies. So a piece moves once, in the range sort, however many rounds there are.

Cases: a null or empty text is the single id 0. Repeated rows are packed separately. Ties of size are broken by a hash of the row
number. Very long texts are many pieces, of which the first takes what whole pieces leave over. An empty table gives no rows. Other
input columns than ``doc_id`` and ``text``, whatever their names, are not read."""

from __future__ import annotations

import base64
import bisect
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotline.session import stored

CAPACITY = 2048
END = 0


class Tokenizer:
    """Ids of the byte-level vocabulary ``byte_bpe_50k``; its rank file gives the same ids as its JSON file, several times faster."""

    def __init__(self, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return np.array([*self._encoding.encode_ordinary(text), END], "<u4")


@functools.lru_cache(maxsize=1)
def tokenizer(ranks_path: str) -> Tokenizer:
    """One for each worker process: building it takes memory and time."""
    return Tokenizer(ranks_path)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenised_pieces(docs: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the first piece of a long document takes what whole pieces leave over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(ranks_path or default_ranks()).encode
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = encode(text.as_py() or "")
                start, piece, n = 0, 0, len(ids)
                while start < n:
                    size = n % capacity if start == 0 and n % capacity else capacity
                    rows.append((doc, piece, start, size, zlib.crc32(ids[start : start + size].tobytes())))
                    start, piece = start + size, piece + 1
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def match_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(size, first rank, length, pieces a sequence, first sequence, offset) of the runs that ``counts`` (size -> pieces) are matched
    in: the pieces of a size with ranks from ``first rank`` on go to consecutive sequences. In a round a gap takes one piece, or a
    quarter of the equal pieces that it has room for if that is more: rounds grow with the logarithm of the capacity then, and work
    and result with the number of sizes, not with that of pieces."""
    left, rank = dict(counts), dict.fromkeys(counts, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, length)
    out, opened = [], 0
    while left:
        if not gaps:
            fresh = -(-sum(s * n for s, n in left.items()) // capacity)
            gaps[capacity] = [(opened, fresh)]
            opened += fresh
        rooms, after = sorted(gaps), {}
        for s in sorted(left, reverse=True):
            at = bisect.bisect_left(rooms, s)  # the successor of s among the rooms
            while left[s] and at < len(rooms):
                room = rooms[at]
                sequence, n = gaps[room].pop()
                each = min(max(1, room // s // 4), left[s])
                m = min(n, left[s] // each)
                out.append((s, rank[s], m * each, each, sequence, capacity - room))
                rank[s], left[s] = rank[s] + m * each, left[s] - m * each
                if n > m:
                    gaps[room].append((sequence + m, n - m))
                elif not gaps[room]:
                    rooms.pop(at)
                if room > each * s:
                    after.setdefault(room - each * s, []).append((sequence, m))
        left = {s: n for s, n in left.items() if n}
        gaps = after
    return out


def best_fit(items: DataFrame, capacity: int = CAPACITY, size: str = "size") -> DataFrame:
    """``items`` with sequence_id and offset; ``size`` names a column of values from 1 to ``capacity``."""
    spark = items.sparkSession
    items = items.withColumn("_id", F.monotonically_increasing_id())
    order = [F.col(size), F.xxhash64("_id"), F.col("_id")]
    place = F.monotonically_increasing_id()  # partition and place in it
    ranked, _ = stored(items.repartitionByRange(*order).sortWithinPartitions(*order).drop("_id").withColumn("_place", place), "ranked")
    # Ranks among the pieces of a size: a partition holds a range of sizes, so there is a row for each size and each further partition.
    part = F.shiftright("_place", 33)
    parts, parts_path = stored(ranked.groupBy(part.alias("_part"), F.col(size).alias("_size")).agg(F.min("_place").alias("first"), F.count("*").alias("n")), "parts")
    w = W.partitionBy("_size").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts_before = parts.select("_part", "_size", (F.coalesce(F.sum("n").over(w), F.lit(0)) - F.col("first")).alias("_shift"))
    counts = {r._size: r.n for r in parts.groupBy("_size").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    runs = spark.createDataFrame(match_runs(counts, capacity), "r_size long, r_first long, r_n long, r_each long, r_sequence long, r_offset long")
    ranked = ranked.join(F.broadcast(parts_before), (part == F.col("_part")) & (F.col(size) == F.col("_size")))
    rank = F.col("_place") + F.col("_shift")
    found = ranked.join(F.broadcast(runs), (F.col(size) == F.col("r_size")) & (rank >= F.col("r_first")) & (rank < F.col("r_first") + F.col("r_n")))
    at = rank - F.col("r_first")
    sequence, offset = F.col("r_sequence") + (at - at % F.col("r_each")) / F.col("r_each"), F.col("r_offset") + at % F.col("r_each") * F.col(size)
    return found.select(*(c for c in items.columns if c != "_id"), sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row."""
    pieces, _ = stored(tokenised_pieces(docs, capacity, ranks_path), "tokens")  # the range sort reads them twice
    return best_fit(pieces, capacity, "length")

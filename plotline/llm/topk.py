"""Exact top-k inner products by norm-bucketed retrieval.

Vectors become integers, floor(scale * x). Candidates are grouped into buckets by length (ties of length by a hash of the id, so
that equal lengths can be split), the longest first. Buckets are searched in waves, each ``GROWTH`` times as many as all before it:
after a wave every query has a threshold, its k-th best product so far, and goes on only to buckets whose longest vector could reach it.
As buckets are in order of length, these are all buckets up to a number that a small table of lengths on a logarithmic scale gives. Inside a
bucket the local cosine threshold, threshold / (query length * bucket's largest length), chooses the pruning: where it is low,
candidates shorter than threshold / query length fall away (length pruning); where it is high, and the interval is narrow, the candidate's coordinate at the query's
largest coordinate must lie in the interval that the threshold allows (coordinate pruning). What is left is verified by exact products,
and the best k of each bucket meet by query.

Cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an id. Vectors of unequal
lengths count as padded with zeros. Rows that share an id are all the query's own row when that id asks, which it does with its
shortest vector. With fewer than k candidates all are returned; ties go to the smaller id. An empty table gives no rows. Products from
2**53 on are verified in 64-bit integers; components or verified products that leave 63 bits raise. Columns other than ``vec_id`` and ``embedding`` are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotline.session import forget, stored

#: Below this local cosine threshold length pruning is used, above it coordinate pruning.
SWITCH = 0.3
#: Where the interval of coordinates keeps more than this part (1 / WIDE) of a bucket, length pruning is used too: copying so many rows for one query
#: costs more than their products with many queries at once.
WIDE = 16
#: Buckets searched after a wave, as a multiple of those before it.
GROWTH = 4


def integer_vectors(table: DataFrame, scale: float) -> DataFrame:
    """vec_id, norm, v (float64 bytes of the integers) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, norms, raw = [], [], []
            for i, x in zip(b.column("vec_id").to_pylist(), b.column("x"), strict=True):
                if i is None or not x.is_valid or x.values.null_count:
                    continue
                v = np.floor(scale * np.asarray(x.values, np.float64))
                if not np.isfinite(v).all():
                    continue
                if len(v) and np.abs(v).max() >= 2.0**63:
                    raise OverflowError(f"vector {i}: a component leaves 63 bits")
                ids.append(i)
                norms.append(float(np.sqrt(v @ v)))
                raw.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(norms, pa.float64()), pa.array(raw, pa.binary())], names=["vec_id", "norm", "v"])

    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).mapInArrow(run, "vec_id long, norm double, v binary")


def _matrix(raw: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    vs = [np.frombuffer(x, np.float64) for x in raw.to_pylist()]
    width = max([width, *map(len, vs)])
    out = np.zeros((len(vs), width))
    for i, v in enumerate(vs):
        out[i, : len(v)] = v
    return out


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of the rows of q with those of c: exact in floats below 2**53, else whole numbers."""
    out = q @ c.T
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1] < 2.0**53:
        return out
    if np.abs(out).max(initial=0) >= 2.0**63 * (1 - 1e-9):
        raise OverflowError("a product leaves 63 bits")
    return q.astype(np.int64) @ c.astype(np.int64).T


def search_bucket(q_ids: np.ndarray, q: np.ndarray, q_norm: np.ndarray, floor: np.ndarray, ids: np.ndarray, c: np.ndarray, norm: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query position, candidate ids, products) of each query's best k in one bucket; ``floor`` holds thresholds (-inf: none yet)."""
    order = np.argsort(-norm, kind="stable")
    ids, c, norm = ids[order], c[order], norm[order]
    unit = c / np.maximum(norm, 1e-300)[:, None]
    sorted_coordinate: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    out = []
    longest = norm[0] if len(norm) else 0.0
    by_length: list[tuple[int, int]] = []
    for i in range(len(q)):
        reach = q_norm[i] * longest
        cosine = -1.0 if floor[i] <= 0 or reach == 0 else floor[i] / reach
        if floor[i] > reach * (1 + 1e-12):
            continue  # the whole bucket is too short
        if cosine <= SWITCH:
            need = floor[i] / q_norm[i] if floor[i] > 0 and q_norm[i] > 0 else 0.0
            by_length.append((i, int(np.searchsorted(-norm, -need * (1 - 1e-12), side="right"))))
            continue
        qu = q[i] / q_norm[i]
        f = int(np.argmax(np.abs(qu)))
        x, t = qu[f], min(cosine, 1.0)
        spread = np.sqrt(max(0.0, (1 - t * t) * (1 - x * x)))
        lo, hi = (t * x - spread if x < t or x > 0 else -1.0), (t * x + spread)
        lo, hi = (lo if -x < t else -1.0), (hi if x < t else 1.0)  # near the pole the interval reaches the end
        if f not in sorted_coordinate:
            at = np.argsort(unit[:, f], kind="stable")
            sorted_coordinate[f] = at, unit[at, f]
        at, values = sorted_coordinate[f]
        part = at[np.searchsorted(values, lo - 1e-9) : np.searchsorted(values, hi + 1e-9, side="right")]
        if len(part) * WIDE > len(c):
            by_length.append((i, int(np.searchsorted(-norm, -(floor[i] / q_norm[i]) * (1 - 1e-12), side="right"))))
        elif len(part):
            out.append(_best(i, q_ids[i], ids[part], _products(q[i : i + 1], c[part])[0], floor[i], k))
    by_length.sort(key=lambda x: x[1])
    for lo in range(0, len(by_length), 64):
        some = by_length[lo : lo + 64]
        products = _products(q[[i for i, _ in some]], c[: some[-1][1]])
        for (i, n), s in zip(some, products, strict=True):
            out.append(_best(i, q_ids[i], ids[:n], s[:n], floor[i], k))
    return [x for x in out if len(x[1])]


def _best(i: int, own: int, ids: np.ndarray, s: np.ndarray, floor: float, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    ok = np.flatnonzero((s >= floor - abs(floor) * 1e-12 if np.isfinite(floor) else np.full(len(s), True)) & (ids != own))
    if len(ok) > k:
        kth = np.partition(s[ok], len(ok) - k)[len(ok) - k]
        ok = ok[s[ok] >= kth]
    ok = ok[np.lexsort((ids[ok], -s[ok]))][:k]
    return i, ids[ok], s[ok]


def _reach(buckets: DataFrame, n_buckets: int) -> tuple[DataFrame, int, int]:
    """(cell, last): the last bucket that holds vectors of a logarithmic length cell or above; and the least and greatest cell. The
    number of cells is bounded by the range of lengths, whatever the number of buckets."""
    cells = {r.cell: r.last for r in buckets.groupBy(_cell(F.col("longest")).alias("cell")).agg(F.max("bucket").alias("last")).collect()}
    lo, hi = min(cells, default=0), max(cells, default=0)
    rows, last = [(hi + 1, -1)], -1
    for c in range(hi, lo - 1, -1):
        last = max(last, cells.get(c, -1))
        rows.append((c, last))
    return buckets.sparkSession.createDataFrame(rows, "cell int, last int"), lo, hi


def _cell(length: Column) -> Column:
    """32 cells for each doubling."""
    return F.floor(32 * F.log2(F.greatest(length, F.lit(0.5)))).cast("int")


def top_k(table: DataFrame, every: int = 20, k: int = 20, scale: float = 64.0, bucket_rows: int = 4096, block_queries: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row whose id is divisible by ``every``."""
    spark = table.sparkSession
    vectors, vectors_path = stored(integer_vectors(table, scale), "vectors")
    n = vectors.count()
    n_buckets = max(1, -(-n // bucket_rows))
    placed, _ = stored(vectors.repartitionByRange(n_buckets, F.col("norm").desc(), F.xxhash64("vec_id")).withColumn("bucket", F.spark_partition_id()), "buckets")
    forget(spark, vectors_path)
    buckets, _ = stored(placed.groupBy("bucket").agg(F.max("norm").alias("longest")), "longest")
    reach, lo_cell, hi_cell = _reach(buckets, n_buckets)
    last_bucket = buckets.agg(F.max("bucket").alias("b")).first().b
    queries = placed.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("q_id"), F.col("norm").alias("q_norm"), F.col("v").alias("qv"))
    blocks = max(1, -(-n // every // block_queries))
    queries = queries.groupBy("q_id").agg(F.min(F.struct("q_norm", "qv")).alias("q")).select("q_id", "q.q_norm", "q.qv").withColumn("block", F.pmod(F.xxhash64("q_id"), F.lit(blocks)).cast("long"))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        c = _matrix(right.column("v"))
        q = _matrix(left.column("qv"), c.shape[1])
        c = np.pad(c, ((0, 0), (0, q.shape[1] - c.shape[1])))
        ids = left.column("q_id").to_numpy()
        found = search_bucket(ids, q, left.column("q_norm").to_numpy(), left.column("floor").to_numpy(), right.column("vec_id").to_numpy(), c, right.column("norm").to_numpy(), k)
        sizes = [len(x[1]) for x in found]
        return pa.table({
            "query_id": pa.array(np.repeat(ids[[x[0] for x in found]], sizes) if found else [], pa.int64()),
            "vec_id": pa.array(np.concatenate([x[1] for x in found]) if found else [], pa.int64()),
            "score": pa.array(np.concatenate([x[2].astype(np.int64) for x in found]) if found else [], pa.int64()),
        })

    def search(asked: DataFrame, candidates: DataFrame) -> DataFrame:
        """Candidates are copied for the blocks of queries that ask for their bucket."""
        where = asked.select(F.col("bucket").alias("b"), F.col("block").alias("g")).distinct()
        copies = candidates.join(where, F.col("bucket") == F.col("b")) if blocks > 1 else candidates.withColumn("g", F.lit(0).cast("long"))
        copies = copies.select(F.col("bucket").alias("c_bucket"), F.col("g").alias("c_block"), "vec_id", "norm", "v")
        return asked.groupBy("bucket", "block").cogroup(copies.groupBy("c_bucket", "c_block")).applyInArrow(run, "query_id long, vec_id long, score long")

    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    none = F.lit(float("-inf"))
    top, top_path, start = None, None, 0
    while last_bucket is not None and start <= last_bucket:
        stop = max(1, start * GROWTH) - 1  # this wave's last bucket
        if top is None:
            asked = queries.withColumn("floor", none).withColumn("last", F.lit(stop))
        else:
            floors = top.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("s")).select(F.col("query_id").alias("q_id"), F.when(F.col("n") >= k, F.col("s")).alias("s"))
            asked = queries.join(floors, "q_id", "left").withColumn("floor", F.coalesce("s", none)).drop("s")
            need = F.when((F.col("floor") > 0) & (F.col("q_norm") > 0), _cell(F.col("floor") / F.col("q_norm") * (1 - 1e-9))).otherwise(lo_cell)
            asked = asked.withColumn("cell", F.least(F.greatest(need, F.lit(lo_cell)), F.lit(hi_cell + 1))).join(F.broadcast(reach), "cell").drop("cell")
        asked = asked.where(F.col("last") >= start).withColumn("bucket", F.explode(F.sequence(F.lit(start), F.least("last", F.lit(min(stop, last_bucket)))))).drop("last")
        found = search(asked, placed.where(F.col("bucket").between(start, stop)))
        both = found if top is None else top.unionByName(found)
        before = top_path
        top, top_path = stored(both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "vec_id", "score"), "top")
        if before:
            forget(spark, before)
        start = stop + 1
    if top is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return top.withColumn("rank", F.row_number().over(best)).select("query_id", "rank", "vec_id", "score")

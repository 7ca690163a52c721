"""Bounds that hold whatever the rows: lessons of the toxicity learner, products of large components."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotline.llm import topk, toxicity


def brute_top(rows, k, every=20):
    ints = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    out = {}
    for q, v in ints:
        if q % every == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ints if i != q))[:k]
            out[q] = [(i, -s) for s, i in scores]
    return out


@pytest.mark.parametrize("size", [1e3, 1e6, 3e6])
@pytest.mark.parametrize("block", [16384, 2])
def test_large_components(spark, size, block):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=64) * size).tolist()) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(5)]  # ties
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in topk.top_k(table, k=6, bucket_rows=16, block_queries=block).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: [(i, s) for _, i, s in sorted(v)] for q, v in got.items()} == brute_top(rows, 6)


def test_products_beyond_63_bits_raise(spark):
    table = spark.createDataFrame([(i, [1e9 * (i + 1)] * 4) for i in range(30)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="63 bits"):
        topk.top_k(table, k=3).collect()


def test_lessons_are_bounded_after_the_join(spark):
    docs = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(spark.range(300).select((F.col("id") % 100).alias("doc_id"), F.lit("same text").alias("text")))
    few = toxicity.bounded_sample(spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label")), 50)
    rows = toxicity.lessons(docs, few, 50).collect()
    assert len(rows) == 50
    assert toxicity.lessons(docs.where("doc_id <> 1"), few, 1000).count() == few.where("doc_id <> 1").count()
    labels = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    assert toxicity.classify_toxicity(docs, labels, sample=10).count() == docs.count()


def test_wide_intervals_meet_many_queries_at_once(monkeypatch):
    import numpy as np

    from plotline.llm import topk

    rng, calls, products = np.random.default_rng(1), [], topk._products
    c, q = (np.floor(64 * rng.standard_normal((n, 16))) for n in (400, 128))
    c_norm, q_norm = np.linalg.norm(c, axis=1), np.linalg.norm(q, axis=1)
    monkeypatch.setattr(topk, "_products", lambda a, b: calls.append(len(a)) or products(a, b))
    found = topk.search_bucket(np.arange(128), q, q_norm, 0.32 * q_norm * c_norm.max(), np.arange(1000, 1400), c, c_norm, 5)
    assert len(calls) < 20
    for i, ids, s in found:
        every = c @ q[i]
        best = np.lexsort((np.arange(400), -every))[:5]
        best = best[every[best] >= 0.32 * q_norm[i] * c_norm.max() * (1 - 1e-12)]
        assert ids.tolist() == (best + 1000).tolist() and s.tolist() == every[best].tolist()

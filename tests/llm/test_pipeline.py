"""Stages of the pipeline against plain versions, with nulls, repeated ids and rows, clashing columns and empty tables."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from plotline.llm import mixing, quality, toxicity

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, text_hash string, component long"
WORDS = [f"w{i}" for i in range(40)]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 0.5, 7, "clash", 9) for i, t, s in rows], SCHEMA)


@pytest.mark.parametrize("stage", [s for _, s in P.STAGES])
def test_empty_tables(spark, stage):
    assert stage(spark, table(spark, []), DATA).count() == 0


def test_copies_of_one_id_and_of_none(spark):
    near, far = " ".join(["v", *WORDS[1:]]), " ".join(f"x{i}" for i in range(30))
    rows = [(5, " ".join(WORDS), "a"), (5, " ".join(WORDS), "a"), (3, near, "b"), (None, near, "b"), (5, far, "a"), (None, far + " y", None), (None, "only one", "a"), (None, "only one", "a"), (8, "", "a"), (9, None, "a"), (8, "", "a")]
    got = sorted(((r.doc_id, r.text) for r in P.near_copies(spark, table(spark, rows), DATA).collect()), key=str)
    assert got == sorted([(3, near), (5, far), (None, "only one"), (8, ""), (8, ""), (9, None)], key=str)


def test_rejected_texts_go_and_their_ids_stay(spark, monkeypatch):
    rows = [(1, "good", "a"), (1, "bad", "a"), (None, "bad", "a"), (None, "good", "a"), (None, None, "a"), (2, "good", None)]
    judge = lambda docs, labels: docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.when(F.col("text") == "bad", 0).otherwise(1).alias("predicted"))
    monkeypatch.setattr(P, "classify_quality", judge)
    got = [(r.doc_id, r.text) for r in P.quality(spark, table(spark, rows), DATA).collect()]
    assert sorted(got, key=str) == sorted([(i, t) for i, t, _ in rows if t != "bad"], key=str)
    monkeypatch.setattr(P, "classify_toxicity", lambda docs, labels: judge(docs, labels).withColumn("predicted", 1 - F.col("predicted")))
    got = [(r.doc_id, r.text) for r in P.toxicity(spark, table(spark, rows), DATA).collect()]
    assert sorted(got, key=str) == sorted([(i, t) for i, t, _ in rows if t != "bad"], key=str)


def test_mixture_gives_the_words_of_its_placements(spark, monkeypatch):
    real = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source").collect()
    rows = [(r.doc_id, r.text, r.source) for r in real] + [(None, "a null id", None), (7, None, "a"), (7, " \t ", "a")]
    docs = table(spark, rows)
    monkeypatch.setattr(P, "mix", lambda *a: mixing.mix(*a, block_words=300))  # many documents on borders
    got = P.mixture(spark, docs, DATA)
    assert got.columns == P.COLUMNS
    words = lambda t: WORD.findall(t or "")
    mixed = mixing.mix(docs.select(*P.COLUMNS, mixing.word_count("text").alias("size")), F.col("source"), F.col("size"), block_words=300)
    want = Counter()
    for r in mixed.collect():
        for p in r.placements:
            want[r["row"].doc_id, " ".join(words(r["row"].text)[p.from_word : p.to_word])] += 1
    have = got.collect()
    assert Counter((r.doc_id, " ".join(words(r.text))) for r in have) == want
    assert all(r.n_chars == len(r.text) for r in have)
    whole = Counter((i, t) for i, t, _ in rows)
    assert sum((r.doc_id, r.text) in whole for r in have) > 50  # a document in one block is not touched


def test_discriminant_by_hand(spark):
    import numpy as np
    import zlib

    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    d = len(quality.STATISTICS)
    stats = {r.doc_id: np.array(r.stats) for r in quality.document_statistics(docs).collect()}
    taught = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    x = {k: np.array([stats[i] for i, y in taught.items() if y == k]) for k in (0, 1)}
    n, cov = {k: len(v) for k, v in x.items()}, {k: np.cov(v.T, bias=True) for k, v in x.items()}
    pooled = sum(n[k] * cov[k] for k in n) / sum(n.values())
    logs = {}
    for k in (0, 1):
        w = 0.3 + 0.7 * d / (d + n[k])
        c = (1 - w) * cov[k] + w * pooled + 1e-3 * np.trace(pooled) / d * np.eye(d)
        inv, det = np.linalg.inv(c), np.linalg.slogdet(c)[1]
        logs[k] = lambda v, m=x[k].mean(0), inv=inv, det=det, k=k: np.log(n[k] / sum(n.values())) - 0.5 * det - 0.5 * (v - m) @ inv @ (v - m)
    for r in quality.classify_quality(docs, labels).collect():
        want = 1 / (1 + np.exp(0.3 * (logs[0](stats[r.doc_id]) - logs[1](stats[r.doc_id]))))
        assert abs(r.score - want) < 1e-6 and r.predicted == int(r.score >= 0.3)


def test_ftrl_by_hand(spark):
    import math
    import zlib

    import numpy as np
    import pyarrow as pa

    from plotline.llm._text import flat

    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    order = {r.doc_id: r.o for r in labels.select("doc_id", F.xxhash64("doc_id").alias("o")).collect()}
    taught = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def plain(t):
        w = [x.translate(low) for x in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", t)]
        return {(0, x) for x in w} | {(k, a, b) for k in (1, 2, 3) for a, b in zip(w, w[k:])}

    def features(t):  # the coordinates that hashing gives, which distinct features may share
        at, _ = toxicity.features(*flat(pa.array([t])))
        return {*at.tolist(), "bias"}

    short = [t for t in texts.values() if len(t) < 400][:60]
    assert [len(features(t)) - 1 for t in short] == [len(plain(t)) for t in short] and short
    assert len({*features("a b c d"), *features("A, b - c d")}) == len(features("a b c d"))

    z, n = {}, {}
    weight = lambda f: 0.0 if abs(z.get(f, 0.0)) <= 8 else -math.copysign(abs(z[f]) - 8, z[f]) / ((1 + math.sqrt(n[f])) / 2 + 0.1)
    rows = [(features(texts[i]), taught[i]) for i in sorted(taught, key=order.get) if i in texts]
    rng = np.random.default_rng(7)
    for _ in range(4):
        for at in rng.permutation(len(rows)):
            f, y = rows[at]
            w = {x: weight(x) for x in f}
            g = (1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - y) * (2 if y else 1)
            for x in f:
                a = n.get(x, 0.0)
                z[x] = z.get(x, 0.0) + g - (math.sqrt(a + g * g) - math.sqrt(a)) / 2 * w[x]
                n[x] = a + g * g
    got = toxicity.classify_toxicity(docs, labels).collect()
    for r in got:
        assert abs(r.score - 1 / (1 + math.exp(-sum(map(weight, features(texts[r.doc_id])))))) < 1e-6

"""Scores of words beyond the broadcast vocabulary."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plotline.llm import lm_scoring
from plotline.llm.queries import oracle_sql

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["a b c a b d", "a b c a x y", "x y", "rare words only here", "rare words", "q", None, "", "a a a b b", "B c x Y rare", "z z z z"]


def by_hand(docs):
    uni, bi = Counter(b for w in docs for b in w), Counter(p for w in docs for p in zip(w, w[1:], strict=False))
    n = uni.total()
    score = lambda w, i, b: uni[b] / n if i == 0 else bi[w[i - 1], b] / uni[w[i - 1]] if bi[w[i - 1], b] >= 2 else 0.4 * uni[b] / n
    return [(i, len(w), round(sum(math.log(score(w, j, b)) for j, b in enumerate(w)) / len(w), 6) if w else None) for i, w in enumerate(docs)]


def same(got, want):
    assert len(got) == len(want)
    for r, (i, n, s) in zip(sorted(got, key=lambda r: r.doc_id), want, strict=True):
        assert (r.doc_id, r.n_words) == (i, n) and (r.score is None) == (s is None) and (s is None or abs(r.score - s) < 2e-6), (r, s)


@pytest.mark.parametrize("most,hot", [(0, 0), (1, 256), (3, 2), (5, 0), (1 << 16, 1 << 16)])
def test_words_without_a_number_keep_their_counts(spark, monkeypatch, most, hot):
    monkeypatch.setattr(lm_scoring, "REPEATS", 2)  # few texts repeat more often
    docs = [WORD.findall((t or "").lower()) for t in TEXTS]
    table = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)  # bigrams repeat within the task
    same(lm_scoring.stupid_backoff(table, most=most, hot=hot).collect(), by_hand(docs))


def test_many_words_of_one_count(spark):
    """No count is too large, and no number of equal counts too many, for the vocabulary."""
    grams = spark.range(70_000).select(F.lit(1).alias("size"), F.col("id").alias("gram"), F.lit(1 << 21).cast("long").alias("n"), F.lit(None).cast("long").alias("before"))
    assert lm_scoring._most_frequent(grams, 1 << 16).num_rows == 0 and lm_scoring._most_frequent(grams, 70_000).num_rows == 70_000


def test_counts_begin_anew(spark, monkeypatch):
    docs = [WORD.findall((t or "").lower()) for t in TEXTS] * 3
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    monkeypatch.setattr(lm_scoring, "WINDOW", 3)
    same(lm_scoring.stupid_backoff(table, most=4, hot=3).collect(), by_hand(docs))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sql_has_no_cap():
    assert all("65536" not in x for x in oracle_sql().values())

"""The registered queries of this subpackage: each applies one operator, with its production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotline.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotline.llm.warc import archive_round_trip

    return archive_round_trip(_table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotline.llm.mixing import mix_documents

    return mix_documents(_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotline.llm.sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotline.llm.toxicity import classify_toxicity

    return classify_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotline.llm.ngram_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotline.llm.quality import classify_quality

    return classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotline.llm.media import media_digests

    return media_digests(_table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotline.llm.topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotline.llm.lm_scoring import stupid_backoff

    return stupid_backoff(_table(spark, sf_dir, "documents"))


def op10_lm_scoring_all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotline.llm.lm_scoring import stupid_backoff

    return stupid_backoff(_table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotline.llm.simhash import simhash_groups

    return simhash_groups(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotline.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotline.llm.runs import run_digests

    return run_digests(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_OP10 = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM t),
known AS (SELECT word, count(*) AS n FROM x GROUP BY word),
total AS (SELECT coalesce(sum(n), 0) AS t FROM known),
y AS (SELECT x.doc_id, x.i, word AS b, known.n AS c_b FROM x JOIN known USING (word)),
z AS (SELECT *, lag(b) OVER w AS a, lag(c_b) OVER w AS c_a FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT a, b, count(*) AS c_ab FROM z WHERE i > 0 GROUP BY a, b),
s AS (SELECT z.doc_id, ln(CASE WHEN i = 0 THEN c_b / total.t::DOUBLE WHEN c_ab >= 2 THEN c_ab / c_a::DOUBLE ELSE 0.4 * (c_b / total.t::DOUBLE) END) AS l
      FROM z LEFT JOIN g ON g.a = z.a AND g.b = z.b CROSS JOIN total)
SELECT d.doc_id, coalesce(r.n, 0) AS n_words, round(r.l / r.n, 6) AS score
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, sum(l) AS l FROM s GROUP BY doc_id) r USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_lm_scoring": _OP10, "op10_lm_scoring_all_words": _OP10}

"""Corpus pipeline: five stages over ``documents``, each reading the Parquet table that the one before wrote.

Quality, toxicity and near-duplicate stages drop rows; mixing repeats and cuts rows to their sources' targets; packing, the last,
returns the pieces of training sequences. Every stage works on all rows that its predecessor kept.

Cases: a null text is judged as an empty one; it has no words to mix, and if it gets so far its only piece is id 0. Null and repeated ids
are told apart by their texts; repeated rows are judged alike, and one of them stays as a near copy. Very long texts are handled as
single rows. Ties go to the smaller id, then to the smaller hash of the text. Empty tables give empty tables. Columns of ``documents``
beyond the five of ``COLUMNS`` go with the mixture stage."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.llm.mixing import in_shard_order, mix, take_words, word_count
from plotline.llm.ngram_join import near_duplicates
from plotline.llm.packing import pack_documents
from plotline.llm.quality import classify_quality
from plotline.llm.toxicity import classify_toxicity
from plotline.session import bounded_batches, forget, importable, new_path, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


#: Rejected texts (16 bytes each) that are sent to every task; more of them are joined by shuffle.
MOST_BROADCAST = 1 << 20


def _hinted(table: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if its checked size allows it."""
    return F.broadcast(table) if table.count() <= MOST_BROADCAST else table


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (F.xxhash64(a["text"]) == b["text_hash"])


def _without(docs: DataFrame, rejected: DataFrame, tag: str) -> DataFrame:
    """``docs`` without the rows whose id and text (by its hash) are in ``rejected``; that table is written first, so that its size is known
    and texts need not move while it is small."""
    gone = _hinted(stored(rejected.select("doc_id", "text_hash").distinct(), tag)[0])
    return docs.join(gone, _same(docs, gone), "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, classify_quality(docs, _labels(spark, sf_dir)).where("predicted = 0"), "low-quality")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, classify_toxicity(docs, _labels(spark, sf_dir)).where("predicted = 1"), "toxic")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays (ids before null; of equal ids that with the smallest hash of
    its text; of repeated rows one). Documents without words are no copies of each other."""
    rows = near_duplicates(docs).where("component IS NOT NULL").groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    rows, _ = stored(rows, "copies")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    kept = rows.groupBy("component").agg(first.alias("k"), F.count("*").alias("texts"), F.sum("n").alias("n")).where("n > 1")
    x = rows.join(kept.select("component", "k", "texts"), "component")
    stays = F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("text_hash") == F.col("k.text_hash"))
    left = _without(docs, x.where(~stays), "dropped")
    twins = _hinted(stored(x.where(stays & (F.col("n") > 1)).select("doc_id", "text_hash"), "twins")[0])  # kept texts that several rows hold
    once = left.join(twins, _same(left, twins), "left_semi").withColumn("_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_hash"]).select(*docs.columns)
    return left.join(twins, _same(left, twins), "left_anti").select(*docs.columns).unionByName(once)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each part of a document that a shard takes in a pass (the whole document, unless it lies on the border of two blocks
    or is where its source's share ends), written in the shards' shuffled order."""
    sized = docs.select(*COLUMNS, word_count("text").alias("size"))
    rows = in_shard_order(mix(sized, F.col("source"), F.col("size")))
    lo, hi = F.col("x.from_word"), F.col("x.to_word")
    whole = (lo == 0) & (hi == F.col("size"))
    text = F.when(whole, F.col("row.text")).otherwise(take_words(F.when(~whole, F.col("row.text")), lo, hi))
    return rows.select("row.doc_id", text.alias("text"), "row.lang", "row.source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _bounded(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(bounded_batches(spark), docs, sf_dir)

    return run_stage


STAGES = [(f.__name__, _bounded(f)) for f in (quality, toxicity, near_copies, mixture, packing)]
#: Learnt scores and random draws have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if stage is STAGES[-1][1]:
            return out
        path = new_path(spark, f"stage-{name}")
        out.write.parquet(path)
        if last:
            forget(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs

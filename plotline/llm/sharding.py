"""Sharding by jump consistent hashing: a stable key and the number of shards decide, without a ring table.

Adding a shard moves rows only into the new one, and only the necessary share of them. ``slot`` numbers the rows of a shard without
gaps, in the order of a hash of id, size and checksum; ranks come from bucket offsets, so no task holds a shard, and rows that share an id
(or have none) are spread over the buckets.

Cases: a null doc_id is a key of its own (the number 0 is a different one). A null text has size 1 and the checksum of no bytes. Very long
texts are a size and a checksum like others. Rows with equal ids land in one shard and get different slots; repeated rows are numbered
in any order, as they are alike. Other columns than ``doc_id`` and ``text``, whatever their names, are not read. No rows, no result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotline.llm._rank import bucket_of, buckets_for, offsets
from plotline.llm._text import U, splitmix
from plotline.session import stored


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key: every key jumps ahead to its next candidate until that lies beyond the last shard."""
    key = keys.astype(U)
    shard = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    going = np.arange(len(key))
    while len(going):
        shard[going] = ahead[going]
        key[going] = key[going] * U(2862933555777941757) + U(1)
        ahead[going] = ((shard[going] + 1) * ((1 << 31) / ((key[going] >> U(33)).astype(np.float64) + 1))).astype(np.int64)
        going = going[ahead[going] < shards]
    return shard


def with_shard(rows: DataFrame, key: str, shards: dict[str, int]) -> DataFrame:
    """``rows`` with a column for each entry of ``shards``: name -> number of shards."""

    def pick(n: int):
        @F.pandas_udf("int")
        def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                keys = splitmix(s.fillna(0).to_numpy(np.int64).astype(U) ^ np.where(s.isna(), U(0x5851F42D4C957F2D), U(0)))
                yield pd.Series(jump_hash(keys, n).astype(np.int32))

        return f

    return rows.select("*", *(pick(n)(F.col(key)).alias(name) for name, n in shards.items()))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = with_shard(rows, "doc_id", {"shard": shards, "grown_shard": shards + 1}).withColumn("h", F.xxhash64("doc_id", "size", "text_crc32"))
    rows, _ = stored(rows, "shards")  # the texts are read once
    buckets = buckets_for(rows.count() // max(1, shards) + 1)
    rows = rows.withColumn("bucket", bucket_of(F.col("h"), buckets))
    before = offsets(rows, ["shard"], "bucket", F.lit(1))
    w = W.partitionBy("shard", "bucket").orderBy("h", "doc_id", "size", "text_crc32")
    return rows.join(before, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.row_number().over(w) - 1).alias("slot"), "grown_shard"
    )

"""Prefix sums and ranks that no single task has to hold: rows are dealt to buckets, buckets get offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotline.session import cut


def buckets_for(rows: int, per_bucket: int = 4000) -> int:
    """A power of two of buckets, about ``per_bucket`` rows in each if the rows were one group."""
    n = 1
    while n * per_bucket < rows:
        n *= 2
    return n


def bucket_of(order: Column, buckets: int) -> Column:
    """Ascending buckets of a 64-bit hash: its upper bits."""
    bits = buckets.bit_length() - 1
    return (F.shiftright(order, 64 - bits) if bits else F.lit(0)).cast("long")


def offsets(rows: DataFrame, group: list[str], bucket: str, value: Column) -> DataFrame:
    """group, bucket, before: the sum of ``value`` over the group's earlier buckets."""
    sums = rows.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    w = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return sums.select(*group, bucket, F.coalesce(F.sum("_sum").over(w), F.lit(0)).cast("long").alias("before"))


def global_rank(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their rank (from 0) in ``order``: range partitions, a count of each, and the place in the partition."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    w = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = placed.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("_before"))  # a row for each partition
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")

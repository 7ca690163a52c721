"""Lists for people: filtered, sorted, limited, with what is left over counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotline.session import stored


def page(rows: DataFrame, by: str, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group with their place and how many more there are."""
    w = W.partitionBy(by)
    return rows.withColumns({"place": F.row_number().over(w.orderBy(*order)), "more": F.greatest(F.count("*").over(w) - limit, F.lit(0))}).where(F.col("place") <= limit)


def newest(rows: DataFrame, key: str, value: str, when: Column) -> DataFrame:
    """The value of the newest row of each key."""
    return rows.groupBy(key).agg(F.max_by(value, when).alias(value))


def evenly_spread(n: int, k: int) -> list[int]:
    """k of n positions, both ends included."""
    return sorted({round(i * (n - 1) / (k - 1)) for i in range(k)}) if k > 1 else [0]


def first_rule(rows: DataFrame, rules: list[tuple[str, Column]], default: str) -> Column:
    """Name of the first rule, in order, whose condition holds."""
    out = F.when(F.lit(False), "")
    for name, ok in rules:
        out = out.when(F.coalesce(ok, F.lit(False)), name)
    return out.otherwise(default)


def sessions(rows: DataFrame, key: str, order: Column, gap: float) -> DataFrame:
    """Rows with the number of their run: a run ends where the order value jumps by more than ``gap``."""
    w = W.partitionBy(key).orderBy(order)
    start = (order - F.lag(order).over(w) > gap).cast("int")
    return rows.withColumn("run", F.sum(F.coalesce(start, F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)))


def rolling_mean(rows: DataFrame, key: str, order: list[str], value: str, n: int) -> DataFrame:
    """Mean of the last n observations."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(-(n - 1), 0)
    return rows.withColumn("mean", F.avg(value).over(w))


def global_rank(rows: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """``rows`` with their rank in ``order``: range partitions, a count of each, and the place in the partition; no task holds all rows."""
    placed, _ = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranks")
    part = F.shiftright("_at", 33)
    w = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))  # a row for each partition
    before = counts.select("_part", (F.coalesce(F.sum("n").over(w), F.lit(0)) + start).alias("_before"))
    return placed.join(F.broadcast(before), part == F.col("_part")).select(*rows.columns, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def credit_lines(layers: DataFrame, text: str) -> DataFrame:
    """line: the distinct credit lines of all layers; a layer's credits are parted by semicolons."""
    return layers.select(F.explode(F.split(text, ";")).alias("line")).select(F.trim("line").alias("line")).where("line <> ''").distinct()


def addresses_of(rows: DataFrame, key: str, number: str, text: str) -> DataFrame:
    """key, addresses: a building's addresses by their number (unknown ones last), then by text."""
    listed = F.array_sort(F.collect_list(F.struct(F.coalesce(number, F.lit(99)).alias("n"), F.col(text).alias("t"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x.t), "; ").alias("addresses"))


def bounds(rows: DataFrame, key: str, x: str, z: str) -> DataFrame:
    """key, xmin, zmin, xmax, zmax of a relation's members."""
    return rows.groupBy(key).agg(F.min(x).alias("xmin"), F.min(z).alias("zmin"), F.max(x).alias("xmax"), F.max(z).alias("zmax"))


def with_context(rows: DataFrame, key: str, order: str, spike: Column) -> DataFrame:
    """Spikes and, before each run of them, the last ordinary row of the key: each context once, marked by ``spike``."""
    w = W.partitionBy(key).orderBy(order)
    x = rows.withColumn("spike", F.coalesce(spike, F.lit(False)))
    return x.withColumn("_next", F.lead("spike").over(w)).where(F.col("spike") | F.coalesce("_next", F.lit(False))).drop("_next")


def stale(packs: DataFrame, version: Column, current: int) -> DataFrame:
    """Packs that are to be built anew: those of an older version, or of none."""
    return packs.where(F.coalesce(version < current, F.lit(True)))

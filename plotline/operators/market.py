"""Land-value market and parcel summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def market(parcels: DataFrame, default: str = "SIHTOTSTARBETA_MAA") -> DataFrame:
    """tile, purpose ('all' for the whole tile), median, p25, p75 in hundredths of a euro a m2, n, totals: exact quantiles."""
    x = parcels.where("land_value > 0 AND area > 0").select("tile", F.coalesce("purpose", F.lit(default)).alias("purpose"), "area", "land_value", (F.col("land_value") / F.col("area")).alias("per_m2"))
    both = x.select("tile", F.explode(F.array(F.col("purpose"), F.lit("all"))).alias("purpose"), "area", "land_value", "per_m2")
    q = F.percentile("per_m2", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    cents = lambda i: F.floor(F.col("q")[i] * 100 + 0.5 + 1e-7).cast("long")
    out = both.groupBy("tile", "purpose").agg(q.alias("q"), F.count("*").alias("n"), F.sum("area").alias("total_area"), F.sum("land_value").alias("total_value"))
    return out.select("tile", "purpose", cents(1).alias("median"), cents(0).alias("p25"), cents(2).alias("p75"), "n", "total_area", "total_value")


def dearest_first(rows: DataFrame) -> DataFrame:
    """Market rows with their place: dearest first, the total last."""
    from pyspark.sql import Window as W

    w = W.partitionBy("tile").orderBy(F.col("purpose") == "all", F.desc("median"), "purpose")
    return rows.select("tile", "purpose", "median", F.row_number().over(w).alias("place"))


def summarize(parcels: DataFrame) -> DataFrame:
    """Per tile: sorted settlements and municipalities, the modal county (ties: the larger name), valued parcels and their total."""
    top = parcels.where("county IS NOT NULL").groupBy("tile", "county").count().groupBy("tile").agg(F.max_by("county", F.struct("count", "county")).alias("county"))
    out = parcels.groupBy("tile").agg(
        F.array_join(F.array_sort(F.collect_set("settlement")), ",").alias("settlements"), F.array_join(F.array_sort(F.collect_set("municipality")), ",").alias("municipalities"),
        F.count("land_value").alias("valued"), F.sum("land_value").alias("total"), F.count("*").alias("n"),
    )
    return out.join(top, "tile", "left")


def histogram(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def merged_parts(parcels: DataFrame) -> DataFrame:
    """Plots of one register entry merged: parts, total area, and the largest part as the outline's owner."""
    return parcels.where("land_registry IS NOT NULL").groupBy("land_registry").agg(F.count("*").alias("parts"), F.sum("area").alias("area"), F.max_by("pid", F.struct("area", -F.col("pid"))).alias("outline"))

"""Queries on binary files: the driver's rows are written as laser files and rasters and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.plans.demo import load, with_tables
from plotline.plans.registry import query
from plotline.session import new_path
from plotline.sources import binary


@query("s11_laser_points", with_tables("point", rest="SELECT cls, n_returns, count(*) AS n, sum(px * 100) AS sx, sum(py * 50) AS sy, CAST(round(sum(h) * 100) AS BIGINT) AS sz, max(h) AS top FROM point GROUP BY ALL"))
def s11(spark, d):
    path = new_path(spark, "laser")
    rows = load(spark, d, "point").select(F.col("px").cast("double").alias("x"), (F.col("py") / 2).cast("double").alias("y"), F.col("h").cast("double").alias("z"), F.col("n_returns").cast("int").alias("n_returns"), F.col("cls").cast("int").alias("cls"))
    binary.write_points(rows, path)
    whole = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    return binary.read_points(spark, path).groupBy("cls", "n_returns").agg(F.count("*").alias("n"), whole("x").alias("sx"), whole("y").alias("sy"), whole("z").alias("sz"), F.round(F.max("z"), 2).alias("top"))


@query("s12_rasters", with_tables("cell", rest="SELECT tile, y, x, CAST(v AS DOUBLE) AS v FROM cell"))
def s12(spark, d):
    path = new_path(spark, "rasters")
    binary.write_raster(load(spark, d, "cell"), path, 48, 48)
    return binary.read_raster(spark, path, 48).select(F.regexp_extract("file", r"(\d+)\.r32$", 1).cast("long").alias("tile"), "y", "x", "v")

"""Raster algebra over cells (tile, y, x, v): focal windows, gridding, zones, gradients, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotline.functions import cells as C
from plotline.functions import geometry as G
from plotline.operators.graph import connected
from plotline.session import dealt, forget, stored

#: Bits of the side of the squares in which components are looked for.
SQUARE = 9


def focal_sum(cells: DataFrame, radius: int, value: str = "v") -> DataFrame:
    """tile, y, x, total, n over the (2r+1)^2 box around each present cell: along rows, then along columns.

    The first pass adds up every present cell into the columns that its row window reaches, so that a window whose own row is empty
    still counts."""
    reach = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    across = cells.withColumn("d", reach).groupBy("tile", "y", (F.col("x") + F.col("d")).alias("x")).agg(F.sum(value).alias("s"), F.count(value).alias("k"))
    w = W.partitionBy("tile", "x").orderBy("y").rangeBetween(-radius, radius)
    both = across.withColumns({"total": F.sum("s").over(w), "n": F.sum("k").over(w)})
    return cells.select("tile", "y", "x").join(both.select("tile", "y", "x", "total", "n"), ["tile", "y", "x"])


def dilate(mask: DataFrame, radius: int, size: int) -> DataFrame:
    """tile, y, x of every cell within ``radius`` (box) of a set cell, inside size x size: along rows, then along columns, so that a cell is
    copied 2 (2 radius + 1) times at most."""
    along = lambda c: F.explode(F.sequence(F.greatest(F.col(c) - radius, F.lit(0)), F.least(F.col(c) + radius, F.lit(size - 1)))).alias(c)
    wide = mask.where(F.col("x").between(-radius, size - 1 + radius) & F.col("y").between(-radius, size - 1 + radius)).select("tile", "y", along("x")).distinct()
    return wide.select("tile", along("y"), "x").distinct()


def erode(mask: DataFrame, radius: int, size: int) -> DataFrame:
    """Set cells whose whole box is set; cells outside the raster count as set."""
    s = focal_sum(mask.withColumn("one", F.lit(1)), radius, "one")
    span = lambda c: F.least(F.col(c) + radius, F.lit(size - 1)) - F.greatest(F.col(c) - radius, F.lit(0)) + 1
    return s.where(F.col("n") == span("y") * span("x")).select("tile", "y", "x")


def opening(mask: DataFrame, radius: int, size: int) -> DataFrame:
    """Erosion, then dilation: what is narrower than the box goes, what is left keeps its outline."""
    return dilate(erode(mask, radius, size), radius, size)


def grid_points(points: DataFrame) -> DataFrame:
    """tile, y, x: mean ground (class 2), highest vegetation (5), highest roof (6), ground hits, all returns, water (9) and bridge (17) flags; noise
    (7, 18) is left out."""
    ok = points.where(~F.col("cls").isin(7, 18))
    is_class = lambda k: F.col("cls") == k
    return ok.groupBy("tile", F.col("py").alias("y"), F.col("px").alias("x")).agg(
        F.avg(F.when(is_class(2), F.col("h"))).alias("ground"), F.max(F.when(is_class(5), F.col("h"))).alias("vegetation"), F.max(F.when(is_class(6), F.col("h"))).alias("roof"),
        F.count_if(is_class(2)).alias("hits"), F.count("*").alias("returns"), (F.count_if(is_class(9)) > 0).alias("water"), (F.count_if(is_class(17)) > 0).alias("bridge"),
    )


def water_levels(points: DataFrame, least: int = 100) -> DataFrame:
    """tile, level: the median height of water returns where there are enough of them."""
    return points.where("cls = 9").groupBy("tile").agg(F.percentile("h", F.lit(0.5)).alias("level"), F.count("*").alias("n")).where(F.col("n") >= least).drop("n")


def split_pulses(points: DataFrame) -> DataFrame:
    """tile, y, x: highest return, hits, and hits of pulses that were split."""
    return points.groupBy("tile", F.col("py").alias("y"), F.col("px").alias("x")).agg(F.max("h").alias("top"), F.count("*").alias("hits"), F.count_if(F.col("n_returns") > 1).alias("split"))


def coverage(gridded: DataFrame) -> DataFrame:
    """tile: cells, share with ground, returns per cell."""
    return gridded.groupBy("tile").agg(F.count("*").alias("cells"), F.avg((F.col("hits") > 0).cast("int")).alias("with_ground"), (F.sum("returns") / F.count("*")).alias("density"))


def gradient(cells: DataFrame) -> DataFrame:
    """tile, y, x, gx, gy, slope: central differences along rows and columns between present neighbours, one-sided at the ends (0 for a
    lone cell), and the length of both together."""

    def along(line: str, axis: str):
        w = W.partitionBy("tile", line).orderBy(axis)
        a0, a1 = F.coalesce(F.lag(axis).over(w), F.col(axis)), F.coalesce(F.lead(axis).over(w), F.col(axis))
        rise = F.coalesce(F.lead("v").over(w), F.col("v")) - F.coalesce(F.lag("v").over(w), F.col("v"))
        return F.when(a1 > a0, rise / F.when(a1 > a0, a1 - a0).otherwise(1)).otherwise(0.0)

    both = cells.withColumn("gx", along("y", "x")).withColumn("gy", along("x", "y"))
    return both.select("tile", "y", "x", "gx", "gy", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("slope"))


def zonal(cells: DataFrame, zones: DataFrame, q: float, least: int) -> DataFrame:
    """zone, n, q-th quantile of the cells inside box zones (zone, tile, x0, x1, y0, y1), where there are enough cells.

    Zones are exploded to their cells, so the join is an equi-join."""
    at = zones.withColumn("y", F.explode(F.sequence("y0", "y1"))).withColumn("x", F.explode(F.sequence("x0", "x1"))).select("zone", "tile", "y", "x")
    return at.join(cells, ["tile", "y", "x"]).groupBy("zone").agg(F.count("*").alias("n"), F.percentile("v", F.lit(q)).alias("q")).where(F.col("n") >= least)


def components(mask: DataFrame) -> DataFrame:
    """tile, y, x, label of 8-connected components; the label is that of the first cell by y and x. Cells without a place are left out. Components are found square by square
    (at most 4 ** SQUARE cells), and only those that meet across the edge of a square are joined, and their labels spread until nothing changes. Nothing is sent
    through the driver: stored components are small, their rows are not."""
    bits, types = SQUARE, mask.schema
    cells, cells_path = stored(mask.select("tile", "y", "x").dropna(), "cells")
    ranked = W.partitionBy("tile", "_y", "_x").orderBy("y", "x")
    squares = cells.select("tile", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).withColumns({"_y": F.shiftright("y", bits), "_x": F.shiftright("x", bits)})
    squares = dealt(squares, "tile", "_y", "_x").withColumn("first", F.row_number().over(ranked) == 1).select("tile", "y", "x", "first")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (1 << bits) - 1
        for t in C.whole_groups(batches):
            first, y, x = (t.column(c).to_numpy() for c in ("first", "y", "x"))
            once = np.flatnonzero(first | (np.diff(y, prepend=y[:1]) != 0) | (np.diff(x, prepend=x[:1]) != 0))
            first, y, x = first[once], y[once], x[once]
            part = C.parts(*C.numbered(first, y, x))
            edge = np.isin(y & last, (0, last)) | np.isin(x & last, (0, last))
            is_open = np.zeros(len(y), bool)
            is_open[part[edge]] = True
            new = pa.table([t.column("tile").take(pa.array(once)), *map(pa.array, (y, x, y[part], x[part], edge, is_open[part]))], ["tile", "y", "x", "py", "px", "edge", "open"])
            yield from new.to_batches()

    long, flag = T.LongType(), T.BooleanType()
    found = squares.mapInArrow(run, T.StructType([T.StructField(c, t) for c, t in (("tile", types["tile"].dataType), ("y", long), ("x", long), ("py", long), ("px", long), ("edge", flag), ("open", flag))]))
    found, _ = stored(found, "components")
    forget(mask.sparkSession, cells_path)
    ends = found.where("edge").select("tile", "y", "x", F.struct("tile", "py", "px").alias("a"))
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))))
    asks = ends.withColumn("d", F.explode(steps)).select("tile", F.col("a").alias("b"), F.col("y").alias("_y"), F.col("x").alias("_x"), (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"))
    asks = asks.where((F.shiftright("y", bits) != F.shiftright("_y", bits)) | (F.shiftright("x", bits) != F.shiftright("_x", bits)))
    touch, touch_path = stored(asks.join(ends.hint("merge"), ["tile", "y", "x"]).select("a", "b").distinct(), "touching")
    named = found.select("tile", "y", "x", "py", "px", "open")
    if not touch.isEmpty():
        labels = connected(touch).select(F.col("v.tile").alias("tile"), F.col("v.py").alias("py"), F.col("v.px").alias("px"), "comp")
        joined = named.where("open").join(labels.hint("merge"), ["tile", "py", "px"], "left")
        joined = joined.select("tile", "y", "x", F.coalesce("comp.py", "py").alias("py"), F.coalesce("comp.px", "px").alias("px"))
        named = named.where("NOT open").select("tile", "y", "x", "py", "px").unionByName(joined)
    forget(mask.sparkSession, touch_path)
    return named.select("tile", *(F.col(c).cast(types[c].dataType).alias(c) for c in ("y", "x")), (F.shiftleft("py", 32) + F.col("px")).alias("label"))


def blob_shapes(labelled: DataFrame, cells: DataFrame) -> DataFrame:
    """tile, label: cells, box, fill of the box, median value."""
    x = labelled.join(cells, ["tile", "y", "x"])
    box = (F.max("x") - F.min("x") + 1) * (F.max("y") - F.min("y") + 1)
    return x.groupBy("tile", "label").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), (F.count("*") / box).alias("fill"), F.percentile("v", F.lit(0.5)).alias("median"))


def resample_box(cells: DataFrame, factor: int) -> DataFrame:
    """Box average to a grid coarser by ``factor``."""
    return cells.groupBy("tile", F.floor(F.col("y") / factor).alias("y"), F.floor(F.col("x") / factor).alias("x")).agg(F.avg("v").alias("v"))


def mosaic(sheets: DataFrame) -> DataFrame:
    """Later sheets win where they have data: cells (tile, y, x, v, sheet)."""
    return sheets.where("v IS NOT NULL").groupBy("tile", "y", "x").agg(F.max_by("v", "sheet").alias("v"))


def fill_from_neighbours(cells: DataFrame, size: int, times: int = 2) -> DataFrame:
    """Every missing cell of the raster that has neighbours takes the largest of them; ``times`` over, so that gaps of two cells close."""
    steps = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    for _ in range(times):
        around = cells.withColumn("dy", steps).withColumn("dx", steps).select("tile", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "v")
        around = around.where(F.col("y").between(0, size - 1) & F.col("x").between(0, size - 1)).groupBy("tile", "y", "x").agg(F.max("v").alias("m"))
        cells = around.join(cells, ["tile", "y", "x"], "left").select("tile", "y", "x", F.coalesce("v", "m").alias("v"))
    return cells


def pixel_indices(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Value, saturation and green excess of colours from 0 to 1."""
    value = F.greatest(r, g, b)
    return value, F.when(value == 0, 0.0).otherwise((value - F.least(r, g, b)) / value), g - F.greatest(r, b)


def classify_cover(pixels: DataFrame, r: Column, g: Column, b: Column, canopy: Column) -> DataFrame:
    """``pixels`` with cover: 0 meadow, 1 field, 2 canopy, 3 gravel or bright hard ground, 4 soil or water. Colour decides, and measured
    canopy height (null: unknown) overrides it: tall vegetation is canopy, and dark ground on which nothing stands is not."""
    value, saturation, green = pixel_indices(r, g, b)
    seen = (
        F.when((value > 0.62) & (saturation < 0.22), 3)
        .when(green > 0.03, F.when((value > 0.5) & (saturation > 0.35), 1).when(value > 0.36, 0).otherwise(2))
        .when(value < 0.25, 2)
        .otherwise(4)
    )
    tall, bare = F.coalesce(canopy >= 2.5, F.lit(False)), F.coalesce(canopy < 1.0, F.lit(False))
    return pixels.withColumn("cover", F.when(tall & (seen != 3), 2).when((seen == 2) & bare & (value < 0.3), 4).otherwise(seen))


def heights_above_ground(cells: DataFrame) -> DataFrame:
    """tile, y, x, canopy, roof: vegetation between 0.3 and 200 m above the ground counts, up to 60 m; roofs count from 0.5 m; else 0."""
    over = lambda c: F.col(c) - F.col("ground")
    canopy = F.when((over("vegetation") > 0.3) & (over("vegetation") < 200), F.least(over("vegetation"), F.lit(60.0))).otherwise(0.0)
    return cells.select("tile", "y", "x", canopy.alias("canopy"), F.when(over("roof") > 0.5, over("roof")).otherwise(0.0).alias("roof"))


def rasterise(shapes: DataFrame) -> DataFrame:
    """tile, shape, y, x of the cells whose middle lies inside a ring (tile, shape, ring)."""
    e = shapes.withColumn("e", G.envelope(F.col("ring")))
    span = lambda a, b: F.sequence(F.floor(F.col(f"e.{a}")), F.ceil(F.col(f"e.{b}")) - 1)
    cells = e.withColumn("x", F.explode(span("xmin", "xmax"))).withColumn("y", F.explode(span("zmin", "zmax")))
    return cells.where(G.inside(F.col("x") + 0.5, F.col("y") + 0.5, F.col("ring"))).select("tile", "shape", "y", "x")


def discs(points: DataFrame) -> DataFrame:
    """tile, y, x of the cells within ``radius`` of a point (tile, y, x, radius), each once."""
    reach = F.sequence(-F.col("radius"), F.col("radius"))
    x = points.withColumn("dy", F.explode(reach)).withColumn("dx", F.explode(reach)).where("dy * dy + dx * dx <= radius * radius")
    return x.select("tile", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x")).distinct()


def lowest_under(outlines: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """key, ground: the lowest value of the cells under an outline's vertices (key, tile, ring of x, y)."""
    at = outlines.select(key, "tile", F.explode("ring").alias("p")).select(key, "tile", "p.x", "p.y")
    return at.join(cells, ["tile", "y", "x"]).groupBy(key).agg(F.min("v").alias("ground"))


def bright_half_colour(pixels: DataFrame, zone: str) -> DataFrame:
    """zone, r, g, b: medians over the pixels of a zone that are at least as bright as its median brightness."""
    p = pixels.withColumn("value", F.greatest("r", "g", "b"))
    middle = p.groupBy(zone).agg(F.percentile("value", F.lit(0.5)).alias("middle"))
    return p.join(middle, zone).where("value >= middle").groupBy(zone).agg(*(F.percentile(c, F.lit(0.5)).alias(c) for c in "rgb"))


def blank(pixels: DataFrame, image: list[str], luminance: str) -> DataFrame:
    """Images without content: bright (mean over 240) and even (deviation under 12)."""
    stats = pixels.groupBy(*image).agg(F.avg(luminance).alias("mean"), F.stddev_pop(luminance).alias("spread"))
    return stats.where("mean > 240 AND spread < 12").select(*image)


def blend_west_edge(cells: DataFrame, neighbour: DataFrame, reach: int = 40) -> DataFrame:
    """tile, y, x, v: heights bent over ``reach`` cells so that column 0 meets the last column of the western neighbour (tile, y, v): the whole
    difference at the edge, none from ``reach`` on, smoothly between. Rows without a neighbour or without an edge cell stay."""
    edge = cells.where("x = 0").select("tile", "y", F.col("v").alias("own"))
    step = neighbour.select("tile", "y", F.col("v").alias("theirs")).join(edge, ["tile", "y"]).select("tile", "y", (F.col("theirs") - F.col("own")).alias("step"))
    w = G.smoothstep(1.0 - F.col("x") / float(reach))
    return cells.join(step, ["tile", "y"], "left").select("tile", "y", "x", (F.col("v") + F.coalesce("step", F.lit(0.0)) * w).alias("v"))


def masked_out(cells: DataFrame, mask: DataFrame, value: str = "v") -> DataFrame:
    """Cells with ``value`` set to 0 where the mask (tile, y, x) is set."""
    m = mask.select("tile", "y", "x").distinct().withColumn("_set", F.lit(True))
    x = cells.join(m, ["tile", "y", "x"], "left")
    return x.withColumn(value, F.when(F.col("_set"), F.lit(0).cast(cells.schema[value].dataType)).otherwise(F.col(value))).drop("_set")


def fill_holes(cells: DataFrame, size: int, reach: int) -> DataFrame:
    """tile, y, x, v, filled: every cell of the size x size rasters of the tiles that have any. A missing cell takes the mean of the nearest
    present cells to the left and right in its row and up and down in its column, as far as they are within ``reach`` cells, weighted by
    one over their distances; without any of them the median of its tile. Null and non-finite values are missing, cells outside the raster are
    left out, and tiles without a value have no rows. Each direction is a window along a row or a column, so nothing is paired."""
    fine = cells.where(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double")) & (F.abs("v") < float("inf")) & F.col("y").between(0, size - 1) & F.col("x").between(0, size - 1))
    fine = fine.groupBy("tile", "y", "x").agg(F.max(F.col("v").cast("double")).alias("v"))
    middle = fine.groupBy("tile").agg(F.percentile("v", F.lit(0.5)).alias("middle"))
    steps = F.sequence(F.lit(0), F.lit(size - 1)).cast("array<bigint>")
    grid = middle.withColumn("y", F.explode(steps)).withColumn("x", F.explode(steps))
    x = grid.join(fine.select("tile", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "v"), ["tile", "y", "x"], "left")
    weights, values = [], []
    for line, axis in (("y", "x"), ("x", "y")):
        known = F.when(F.col("v").isNotNull(), F.struct(F.col(axis).alias("at"), "v"))
        for name, order in (("lo", F.col(axis).asc()), ("hi", F.col(axis).desc())):
            w = W.partitionBy("tile", line).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
            x = x.withColumn(f"_{axis}{name}", F.last(known, ignorenulls=True).over(w))
            far = F.abs(F.col(axis) - F.col(f"_{axis}{name}.at"))
            weight = F.when(far <= reach, 1.0 / far).otherwise(0.0)
            weights.append(weight)
            values.append(F.when(far <= reach, weight * F.col(f"_{axis}{name}.v")).otherwise(0.0))
    total = sum(weights[1:], weights[0])
    guess = F.when(total > 0, sum(values[1:], values[0]) / F.when(total > 0, total)).otherwise(F.col("middle"))
    return x.select("tile", "y", "x", F.coalesce("v", guess).alias("v"), F.col("v").isNull().alias("filled"))

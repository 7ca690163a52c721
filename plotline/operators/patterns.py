"""Blobs that touch, and stripes in parcels."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotline.functions import cells as C
from plotline.operators.raster import components
from plotline.session import dealt, forget, stored

#: Cells of a blob that one task splits whole.
BLOB = 1 << 18

# Pixels that a parcel needs, the band of periods in metres, and the strength of a peak over the band's median.
STRIPE_PIXELS, STRIPE_PERIODS, STRIPE_PEAK = 200, (3.0, 20.0), 25.0


def _eroded(cells: DataFrame) -> DataFrame:
    """Cells (tile, y, x) whose eight neighbours are there too."""
    step = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    votes = cells.withColumn("dy", step).withColumn("dx", step).groupBy("tile", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x")).agg(F.count("*").alias("n"))
    return votes.where("n = 9").select("tile", "y", "x")


def _split(first: np.ndarray, y: np.ndarray, x: np.ndarray, most: int, least: int, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(places, parts, step) of the cells left when their blob came apart, for cells sorted by blob, y, x; ``first`` marks where a blob begins."""
    blob = np.cumsum(first) - 1
    key, width = C.numbered(first, y, x)
    left = np.arange(len(key))
    for step in range(1, steps + 1):
        left = left[C.eroded(key[left], width)]
        if not len(left):
            return
        heads, at, n = np.unique(left[C.parts(key[left], width)], return_inverse=True, return_counts=True)
        counts, of = n >= max(1, least // (step + 1)), blob[heads]
        several, largest = np.bincount(of[counts], minlength=blob[-1] + 1), np.zeros(blob[-1] + 1, int)
        np.maximum.at(largest, of[counts], n[counts])
        apart = (several >= 2) & (largest <= most)
        done = counts[at] & apart[blob[left]]
        yield left[done], (y[heads[at[done]]] << 32) + x[heads[at[done]]], step
        left = left[(several[blob[left]] > 0) & ~apart[blob[left]]]


def _split_many(cells: DataFrame, most: int, least: int, steps: int) -> DataFrame:
    """``split_blobs`` of the blobs of stored cells (tile, label, y, x), each of which one task can hold: whole blobs at a time."""
    ranked = dealt(cells, "tile", "label").withColumn("first", F.row_number().over(W.partitionBy("tile", "label").orderBy("y", "x")) == 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.whole_groups(batches):
            first, y, x = (t.column(c).to_numpy() for c in ("first", "y", "x"))
            for at, part, step in _split(first, y, x, most, least, steps):
                of = pa.array(at)
                new = [t.column("tile").take(of), t.column("label").take(of), pa.array(part), pa.array(y[at]), pa.array(x[at]), pa.array(np.full(len(at), step, np.int32))]
                yield from pa.table(new, ["tile", "label", "part", "y", "x", "eroded"]).to_batches()

    columns = [("tile", cells.schema["tile"].dataType), ("label", cells.schema["label"].dataType), ("part", T.LongType()), ("y", T.LongType()), ("x", T.LongType()), ("eroded", T.IntegerType())]
    return ranked.mapInArrow(run, T.StructType([T.StructField(*c) for c in columns]))


def _split_large(cells: DataFrame, most: int, least: int, steps: int) -> DataFrame | None:
    """``split_blobs`` of blobs of any size, cell by cell; none if nothing is left of them."""
    spark = cells.sparkSession
    left, path = stored(cells.select(F.struct("tile", "label").alias("tile"), "y", "x"), "blobs")
    out, done = None, []
    for step in range(1, steps + 1):
        shrunk, shrunk_path = stored(_eroded(left), "eroded")
        forget(spark, path)
        if shrunk.isEmpty():
            forget(spark, shrunk_path)
            break
        named, named_path = stored(components(shrunk), "parts")
        forget(spark, shrunk_path)
        parts = named.groupBy("tile", F.col("label").alias("part")).agg(F.count("*").alias("n")).where(F.col("n") >= max(1, least // (step + 1)))
        apart = parts.groupBy("tile").agg((F.count("*") >= 2).alias("several"), (F.max("n") <= most).alias("small")).select("tile", (F.col("several") & F.col("small")).alias("apart"))
        apart, apart_path = stored(apart, "apart")
        split = named.withColumnRenamed("label", "part").join(parts.select("tile", "part").hint("merge"), ["tile", "part"]).join(apart.where("apart").hint("merge"), "tile", "left_semi")
        split, split_path = stored(split.select("tile.tile", "tile.label", "part", "y", "x", F.lit(step).alias("eroded")), "split")
        out = split if out is None else out.unionByName(split)
        left, path = stored(named.select("tile", "y", "x").join(apart.where("NOT apart").hint("merge"), "tile", "left_semi"), "blobs")
        done += [named_path, apart_path]
    forget(spark, *done)
    return out


def split_blobs(labelled: DataFrame, most: int, least: int, steps: int = 4) -> DataFrame:
    """tile, label, part, y, x, eroded: the cells that are left of each part of the blobs (tile, y, x, label) that come apart.

    Blobs are eroded a cell at a time, at most ``steps`` times, all of them at once. After a step a blob's parts are its 8-connected
    components of at least least // (step + 1) cells. A blob is done at the first step with two parts or more, none larger than ``most``; one without parts, and one
    that never comes apart, has no rows. Repeated cells count once, cells without a place are left out. A part's name is that of its component. Blobs of at most BLOB cells
    are split whole, many in a task; the cells of larger ones are dealt to tasks."""
    cells = labelled.select("tile", "label", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).where("y IS NOT NULL AND x IS NOT NULL").distinct()
    cells, _ = stored(cells, "blobs")
    large, _ = stored(cells.groupBy("tile", "label").agg(F.count("*").alias("n")).where(F.col("n") > BLOB).select(F.struct("tile", "label").alias("blob")), "large-blobs")
    if large.isEmpty():
        return _split_many(cells, most, least, steps)
    among = lambda how: cells.withColumn("blob", F.struct("tile", "label")).join(large.hint("merge"), "blob", how).drop("blob")
    few = _split_large(among("left_semi"), most, least, steps)
    rest, _ = stored(among("left_anti"), "blobs")
    many = _split_many(rest, most, least, steps)
    return many if few is None else many.unionByName(few)


def stripe(y: np.ndarray, x: np.ndarray, v: np.ndarray, scale: float) -> tuple[float, float] | None:
    """(period in metres, angle of the rows in degrees from +x towards +y, below 180) of pixels, ``scale`` of them a metre."""
    if len(v) < STRIPE_PIXELS:
        return None
    patch = np.zeros((int(y.max() - y.min()) + 1, int(x.max() - x.min()) + 1))
    patch[(y - y.min()).astype(int), (x - x.min()).astype(int)] = v - v.mean()
    spectrum = np.abs(np.fft.fft2(patch))
    fy, fx = np.fft.fftfreq(patch.shape[0])[:, None], np.fft.fftfreq(patch.shape[1])[None, :]
    frequency = np.hypot(fy, fx) * scale
    period = np.divide(1.0, frequency, out=np.zeros_like(frequency), where=frequency > 0)
    band = (period > STRIPE_PERIODS[0]) & (period < STRIPE_PERIODS[1])
    if not band.any() or (middle := np.median(spectrum[band])) <= 0:
        return None
    strength = np.where(band, np.round(spectrum, 9), -1.0)
    at = np.unravel_index(np.argmax(strength), patch.shape)  # of a frequency and its mirror the first
    if strength[at] / middle < STRIPE_PEAK:
        return None
    angle = (np.degrees(np.arctan2(fy[at[0], 0], fx[0, at[1]])) + 90.0) % 180.0
    return float(period[at]), float(angle)


def stripes(pixels: DataFrame, scale: float) -> DataFrame:
    """shape, period, angle of the parcels (shape, y, x, v: their pixels) with regular rows: a peak of the spectrum between 3 and 20 m
    that is 25 times the band's median. A parcel's pixels are bounded by its tile, so one spectrum is one group; of pixels given twice the largest counts, null and
    non-finite ones are left out. Parcels of fewer than 200 pixels have no rows."""

    def run(t: pa.Table) -> pa.Table:
        found = stripe(*(t.column(c).to_numpy().astype(float) for c in ("y", "x", "v")), scale)
        rows = [(t.column("shape")[0].as_py(), *found)] if found else []
        return pa.table({"shape": pa.array([r[0] for r in rows], pa.int64()), "period": pa.array([r[1] for r in rows], pa.float64()), "angle": pa.array([r[2] for r in rows], pa.float64())})

    v = F.col("v").cast("double")
    p = pixels.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).groupBy(F.col("shape").cast("long").alias("shape"), "y", "x").agg(F.max(v).alias("v"))
    return p.groupBy("shape").applyInArrow(run, "shape long, period double, angle double")

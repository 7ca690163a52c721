"""Roofs from laser heights, and the axes of pixel blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions.hulls import rotated_rectangle
from plotline.operators.raster import rasterise

# Least height of a roof cell, cells and fill that a pitched roof needs, least width, least rise, margin over a flat roof,
# width of the band along the eaves and its least number of cells.
ROOF_OVER, CELLS, FILL, WIDTH, RISE, MARGIN, BAND, BAND_CELLS = 1.5, 12, 0.82, 4.0, 0.8, 0.85, 1.5, 4
#: Fixed order of the candidates: a later one must be better than all before it.
PITCHED = ("gable_long", "gable_short", "hip")


def _slopes(s: Column, t: Column, length: Column, width: Column) -> dict[str, Column]:
    """Share of the rise between eave and ridge at a place of the rectangle, for each pitched roof."""
    side = 1 - F.abs(t - width / 2) / (width / 2)
    end = 1 - F.abs(s - length / 2) / (length / 2)
    hip = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(side, F.least(s, length - s) / (width / 2))))
    return {"gable_long": side, "gable_short": end, "hip": hip}


def fit_roofs(footprints: DataFrame, cells: DataFrame) -> DataFrame:
    """shape, kind, eave, ridge, error for footprints (tile, shape, ring) with enough laser cells (tile, y, x, v: metres above the ground).

    Candidates are a flat roof and three pitched ones on the footprint's smallest rectangle. Ridge and flat height are the 95th and
    70th percentiles of the heights, an eave the 30th of the band along its edges (with fewer than four cells there, the 10th of
    all). The candidate with the least root mean square error wins; a pitched one needs 85 % of the flat error, a well filled
    rectangle at least 4 m wide and a rise of 0.8 m. Cells meet footprints by an equi-join on (tile, y, x); a footprint's cells are
    aggregated twice, for heights and for errors. Footprints without two different points, and those with fewer than 12 cells, have no roof."""
    laser = cells.where(F.col("v") > ROOF_OVER).select("tile", "y", "x", F.col("v").cast("double").alias("v"))
    rects = footprints.select("tile", "shape", rotated_rectangle(F.col("ring")).alias("r")).where("r IS NOT NULL").drop("tile")
    at = rasterise(footprints).join(laser, ["tile", "y", "x"]).join(rects, "shape")
    dx, dz = F.col("x") + 0.5 - F.col("r.x"), F.col("y") + 0.5 - F.col("r.z")
    s, t = dx * F.col("r.ux") + dz * F.col("r.uz") + F.col("r.length") / 2, dz * F.col("r.ux") - dx * F.col("r.uz") + F.col("r.width") / 2
    at = at.select("shape", "v", F.round(s, 6).alias("s"), F.round(t, 6).alias("t"), F.col("r.length").alias("length"), F.col("r.width").alias("width"), F.col("r.fill").alias("fill"))
    by_long, by_short = F.least(F.col("t"), F.col("width") - F.col("t")) < BAND, F.least(F.col("s"), F.col("length") - F.col("s")) < BAND
    bands = dict(zip(PITCHED, (by_long, by_short, by_long | by_short), strict=True))
    share = lambda q: F.lit(float(q))
    eaves = {k: F.when(F.count_if(b) >= BAND_CELLS, F.percentile(F.when(b, F.col("v")), share(0.3))).otherwise(F.percentile("v", share(0.1))).alias(f"eave_{k}") for k, b in bands.items()}
    heights = at.groupBy("shape").agg(F.count("*").alias("n"), F.percentile("v", share(0.95)).alias("ridge"), F.percentile("v", share(0.7)).alias("flat"), *eaves.values()).where(F.col("n") >= CELLS)
    x = at.join(heights, "shape")
    error = lambda surface: F.sqrt(F.avg((F.col("v") - surface) * (F.col("v") - surface)))
    slopes = _slopes(F.col("s"), F.col("t"), F.col("length"), F.col("width"))
    surface = {k: F.col(f"eave_{k}") + (F.col("ridge") - F.col(f"eave_{k}")) * v for k, v in slopes.items()}
    kept = ("ridge", "flat", "fill", "width", *(f"eave_{k}" for k in PITCHED))
    errors = x.groupBy("shape").agg(*(F.any_value(c).alias(c) for c in kept), error(F.col("flat")).alias("error_flat"), *(error(surface[k]).alias(f"error_{k}") for k in PITCHED))
    roof = lambda kind, eave, ridge, err: F.struct(F.lit(kind).alias("kind"), eave.alias("eave"), ridge.alias("ridge"), err.alias("error"))
    best = roof("flat", F.col("flat"), F.col("flat"), F.col("error_flat"))
    may_pitch = (F.col("fill") >= FILL) & (F.col("width") >= WIDTH)
    for k in PITCHED:
        most = best["error"] * F.when(best["kind"] == "flat", MARGIN).otherwise(1.0)
        ok = may_pitch & (F.col("ridge") - F.col(f"eave_{k}") >= RISE) & (F.col(f"error_{k}") < most)
        best = F.when(ok, roof(k, F.col(f"eave_{k}"), F.col("ridge"), F.col(f"error_{k}"))).otherwise(best)
    return errors.select("shape", best.alias("b")).select("shape", "b.kind", "b.eave", "b.ridge", "b.error")


def blob_axes(labelled: DataFrame, eroded: int = 0) -> DataFrame:
    """tile, label, n, x, y, length, heading of blobs (tile, y, x, label) of at least three cells: the middle, four standard deviations along the main axis
    (plus two cells for each erosion before), and the axis's degrees from +y towards +x, below 180. The eigenvalue of the 2 x 2
    covariance has a closed form, so that blobs are one aggregation."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    m = labelled.groupBy("tile", "label").agg(F.count("*").alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"), F.var_samp(x).alias("a"), F.var_samp(y).alias("c"), F.covar_samp(x, y).alias("b")).where("n >= 3")
    root = F.sqrt((F.col("a") - F.col("c")) * (F.col("a") - F.col("c")) / 4 + F.col("b") * F.col("b"))
    largest = (F.col("a") + F.col("c")) / 2 + root
    turned = F.degrees(F.atan2(2 * F.col("b"), F.col("c") - F.col("a"))) / 2
    folded = F.round(F.pmod(turned, F.lit(180.0)), 6)
    return m.select("tile", "label", "n", "x", "y", (4 * F.sqrt(F.greatest(largest, F.lit(0.01))) + 2.0 * eroded).alias("length"), F.when(folded >= 180, 0.0).otherwise(folded).alias("heading"))

"""Queries on turned rectangles, roofs and blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.functions.hulls import rotated_rectangle
from plotline.operators import raster, roofs
from plotline.plans.demo import load, with_tables
from plotline.plans.registry import query


def _rings(corners: DataFrame) -> DataFrame:
    """tile, shape, ring of corners (tile, shape, seq, x, z)."""
    ring = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "z"))), lambda p: F.struct(p.x.alias("x"), p.z.alias("z")))
    return corners.groupBy("tile", "shape").agg(ring.alias("ring"))


#: Every pair of corners with all others on one side is an edge of the hull; the rectangle on each, the least of them.
_RECTANGLE = """h AS (SELECT a.shape, (b.x - a.x) AS dx, (b.z - a.z) AS dz FROM {0} a JOIN {0} b ON a.shape = b.shape AND a.seq <> b.seq
  WHERE NOT EXISTS (SELECT 1 FROM {0} c WHERE c.shape = a.shape AND (b.x - a.x) * (c.z - a.z) - (b.z - a.z) * (c.x - a.x) < -1e-9)),
u AS (SELECT shape, dx / sqrt(dx * dx + dz * dz) AS ux, dz / sqrt(dx * dx + dz * dz) AS uz FROM h),
e AS (SELECT u.shape, ux, uz, min(x * ux + z * uz) AS s0, max(x * ux + z * uz) AS s1, min(z * ux - x * uz) AS t0, max(z * ux - x * uz) AS t1 FROM u JOIN {0} USING (shape) GROUP BY ALL),
k AS (SELECT *, s1 - s0 >= t1 - t0 - 1e-9 AS lies FROM e), m AS (SELECT *, CASE WHEN lies THEN ux ELSE -uz END AS lx, CASE WHEN lies THEN uz ELSE ux END AS lz FROM k),
o AS (SELECT *, degrees(atan2(lx, -lz)) AS turn FROM m), q AS (SELECT *, CASE WHEN turn < -1e-7 THEN turn + 180 WHEN turn > 180 - 1e-7 OR turn <= 0 THEN 0.0 ELSE turn END AS heading FROM o),
best AS (SELECT shape, (s0 + s1) / 2 * ux - (t0 + t1) / 2 * uz AS x, (s0 + s1) / 2 * uz + (t0 + t1) / 2 * ux AS z, greatest(s1 - s0, t1 - t0) AS length, least(s1 - s0, t1 - t0) AS width, heading, lx, lz
  FROM q QUALIFY row_number() OVER (PARTITION BY shape ORDER BY round((s1 - s0) * (t1 - t0), 6), round(heading, 6), lx) = 1),
ring AS (SELECT shape, seq, x, z, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(z) OVER w, first_value(z) OVER w) AS nz FROM {0} WINDOW w AS (PARTITION BY shape ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
size AS (SELECT shape, abs(sum(x * nz - nx * z)) / 2 AS area FROM ring GROUP BY shape),
rect AS (SELECT b.*, area / (length * width) AS fill FROM best b JOIN size USING (shape))"""
_ROUNDED = ", ".join(f"round({c}, 4) AS {c}" for c in ("x", "z", "length", "width", "heading", "fill"))


@query("g16_rotated_rectangle", with_tables("corner", rest=f"WITH {_RECTANGLE.format('corner')} SELECT shape, {_ROUNDED} FROM rect"))
def g16(spark, d):
    rings = _rings(load(spark, d, "corner")).withColumn("r", rotated_rectangle(F.col("ring")))
    return rings.select("shape", *(F.round(f"r.{c}", 4).alias(c) for c in ("x", "z", "length", "width", "heading", "fill")))


@query("r28_roofs", with_tables("wall", "roof_cell", rest=f"""WITH {_RECTANGLE.format('wall')}, tile_of AS (SELECT DISTINCT shape, tile FROM wall),
c AS (SELECT t.shape, c.y, c.x, c.v FROM tile_of t JOIN rect r USING (shape) JOIN roof_cell c ON c.tile = t.tile AND abs(c.x + 0.5 - r.x) < 20 AND abs(c.y + 0.5 - r.z) < 20 WHERE c.v > 1.5),
i AS (SELECT c.shape, c.y, c.x, any_value(c.v) AS v FROM c JOIN ring g ON g.shape = c.shape AND (g.z > c.y + 0.5) <> (g.nz > c.y + 0.5) AND c.x + 0.5 < (g.nx - g.x) * (c.y + 0.5 - g.z) / (g.nz - g.z) + g.x GROUP BY c.shape, c.y, c.x HAVING count(*) % 2 = 1),
f AS (SELECT i.shape, v, round((i.x + 0.5 - r.x) * lx + (i.y + 0.5 - r.z) * lz + length / 2, 6) AS s, round((i.y + 0.5 - r.z) * lx - (i.x + 0.5 - r.x) * lz + width / 2, 6) AS t, length AS l, width AS w, fill FROM i JOIN rect r USING (shape)),
b AS (SELECT *, least(t, w - t) < 1.5 AS gl, least(s, l - s) < 1.5 AS gs FROM f),
p AS (SELECT shape, quantile_cont(v, 0.95) AS ridge, quantile_cont(v, 0.7) AS flat, {", ".join(f"CASE WHEN count(*) FILTER ({c}) >= 4 THEN quantile_cont(v, 0.3) FILTER ({c}) ELSE quantile_cont(v, 0.1) END AS e{n}" for n, c in (("1", "gl"), ("2", "gs"), ("3", "gl OR gs")))} FROM b GROUP BY shape HAVING count(*) >= 12),
x AS (SELECT b.shape, ridge, flat, e1, e2, e3, any_value(fill) AS fill, any_value(w) AS w, sqrt(avg(pow(v - flat, 2))) AS f0, sqrt(avg(pow(v - e1 - (ridge - e1) * (1 - abs(t - w / 2) / (w / 2)), 2))) AS f1, sqrt(avg(pow(v - e2 - (ridge - e2) * (1 - abs(s - l / 2) / (l / 2)), 2))) AS f2,
  sqrt(avg(pow(v - e3 - (ridge - e3) * greatest(0, least(1, least(1 - abs(t - w / 2) / (w / 2), least(s, l - s) / (w / 2)))), 2))) AS f3 FROM b JOIN p USING (shape) GROUP BY ALL),
c0 AS (SELECT *, fill >= 0.82 AND w >= 4 AS may FROM x), c1 AS (SELECT *, CASE WHEN may AND ridge - e1 >= 0.8 AND f1 < 0.85 * f0 THEN 1 ELSE 0 END AS k1 FROM c0),
c2 AS (SELECT *, CASE WHEN may AND ridge - e2 >= 0.8 AND f2 < CASE k1 WHEN 0 THEN 0.85 * f0 ELSE f1 END THEN 2 ELSE k1 END AS k2 FROM c1),
c3 AS (SELECT *, CASE WHEN may AND ridge - e3 >= 0.8 AND f3 < CASE k2 WHEN 0 THEN 0.85 * f0 WHEN 1 THEN f1 ELSE f2 END THEN 3 ELSE k2 END AS k FROM c2)
SELECT shape, CASE k WHEN 0 THEN 'flat' WHEN 1 THEN 'gable_long' WHEN 2 THEN 'gable_short' ELSE 'hip' END AS kind, round(CASE k WHEN 0 THEN flat WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE e3 END, 4) AS eave, round(CASE k WHEN 0 THEN flat ELSE ridge END, 4) AS ridge, round(CASE k WHEN 0 THEN f0 WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END, 4) AS error FROM c3"""))
def r28(spark, d):
    got = roofs.fit_roofs(_rings(load(spark, d, "wall")), load(spark, d, "roof_cell"))
    return got.select("shape", "kind", *(F.round(c, 4).alias(c) for c in ("eave", "ridge", "error")))


@query("r5_blob_axes")
def r5_axes(spark, d):
    """Components have no short SQL; tests compare with eigenvectors."""
    labelled = raster.components(load(spark, d, "cell").where("v > 40"))
    return roofs.blob_axes(labelled)

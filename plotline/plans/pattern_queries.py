"""Queries on raster holes, touching blobs, stripes and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.functions import geometry as G
from plotline.operators import patterns, raster, regions
from plotline.plans.demo import load, with_tables
from plotline.plans.registry import query


def _side(name: str, near: str, far: str) -> str:
    """The nearest known cell on one side of each missing one, within six cells."""
    return f"""{name} AS (SELECT g.tile, g.y, g.x, arg_min(k.v, {near}) AS v, min({near}) AS d FROM g JOIN k ON k.tile = g.tile AND {far} AND {near} BETWEEN 1 AND 6 WHERE g.v IS NULL GROUP BY g.tile, g.y, g.x)"""


@query("r14_filled", with_tables("cell", rest=f"""WITH k AS (SELECT tile, y, x, v FROM cell WHERE (y * 7 + x * 3) % 11 > 6 AND (tile <> 3 OR y < 9)), m AS (SELECT tile, median(v) AS middle FROM k GROUP BY tile),
g AS (SELECT m.tile, middle, yy.y, xx.x, k.v FROM m, (SELECT unnest(range(48)) AS y) yy, (SELECT unnest(range(48)) AS x) xx LEFT JOIN k ON k.tile = m.tile AND k.y = yy.y AND k.x = xx.x),
{_side('l', 'g.x - k.x', 'k.y = g.y')}, {_side('r', 'k.x - g.x', 'k.y = g.y')}, {_side('u', 'g.y - k.y', 'k.x = g.x')}, {_side('d', 'k.y - g.y', 'k.x = g.x')},
a AS (SELECT tile, y, x, sum(v / d) / sum(1.0 / d) AS v FROM (SELECT * FROM l UNION ALL SELECT * FROM r UNION ALL SELECT * FROM u UNION ALL SELECT * FROM d) s GROUP BY tile, y, x)
SELECT g.tile, g.y, g.x, round(coalesce(g.v, a.v, middle), 6) AS v, g.v IS NULL AS filled FROM g LEFT JOIN a ON a.tile = g.tile AND a.y = g.y AND a.x = g.x"""))
def r14(spark, d):
    known = load(spark, d, "cell").where("(y * 7 + x * 3) % 11 > 6 AND (tile <> 3 OR y < 9)")
    return raster.fill_holes(known, 48, 6).withColumn("v", F.round("v", 6))


@query("r4_split_blobs")
def r4(spark, d):
    """No short SQL; tests compare with a loop over each blob."""
    lofts = load(spark, d, "roof_cell").where("v > 3.5 AND NOT (x % 34 BETWEEN 13 AND 18 AND y % 34 <> 16)")
    return patterns.split_blobs(raster.components(raster.dilate(lofts, 1, 1 << 20)), 400, 4)


@query("r27_stripes")
def r27(spark, d):
    """Spectra have no SQL; tests compare with known patterns. Every third patch has rows of its own period and angle."""
    k, a = F.col("tile") * 100000 + F.floor(F.col("y") / 68) * 100 + F.floor(F.col("x") / 68), F.radians((F.col("x") - F.col("x") % 68) * 7 % 180)
    rows = F.cos(2 * 3.141592653589793 / (4 + F.col("tile")) * (F.col("x") * F.cos(a) + F.col("y") * F.sin(a))) * 100
    noise = F.pmod(F.col("x") * 7919 + F.col("y") * 104729 + F.col("x") * F.col("y") * 31, F.lit(97))
    pixels = load(spark, d, "roof_cell").select(k.alias("shape"), "y", "x", F.when(F.col("tile") % 3 == 0, rows + noise / 10).otherwise(noise).alias("v"))
    return patterns.stripes(pixels, 1.0)


#: Three countries of boxes and a notched one, in units of a parcel's grid.
_LAND = (
    ("ee", ((0, 0), (500, 0), (500, 400), (250, 400), (250, 700), (0, 700))),
    ("lv", ((500, 0), (1100, 0), (1100, 400), (500, 400))),
    ("lv", ((250, 400), (600, 400), (600, 1100), (250, 1100))),
    ("fi", ((650, 500), (1000, 450), (1050, 1000), (700, 900))),
)
_ADAPTERS = (("lv", 1, True, 200, 0, 1100, 1100), ("fi", 2, True, 600, 400, 1100, 1100), ("ee", 3, False, 0, 0, 900, 900))
_SHEETS = (("lv", 600, 600, 700, 700), ("fi", 650, 950, 700, 1000))


def _regions(spark):
    land = spark.createDataFrame([(c, [(float(x), float(z)) for x, z in ring]) for c, ring in _LAND], "country string, ring array<struct<x:double,z:double>>")
    box = "xmin double, zmin double, xmax double, zmax double"
    f = lambda rows: [tuple(float(v) if type(v) is int and i > (1 if len(r) > 5 else 0) else v for i, v in enumerate(r)) for r in rows]
    return land, spark.createDataFrame(f(_ADAPTERS), f"country string, ord int, exact boolean, {box}"), spark.createDataFrame(f(_SHEETS), f"country string, {box}")


_EDGES = "edge(i, country, ax, az, bx, bz) AS (VALUES " + ", ".join(f"({i}, '{c}', {a[0]}.0, {a[1]}.0, {b[0]}.0, {b[1]}.0)" for i, (c, r) in enumerate(_LAND) for a, b in zip(r, r[1:] + r[:1], strict=True)) + ")"


@query("j26_countries", with_tables("poi", rest=f"""WITH {_EDGES}, a(country, ord, exact, x0, z0, x1, z1) AS (VALUES {', '.join(f"('{c}', {o}, {str(e).lower()}, {w}, {s}, {n}, {t})" for c, o, e, w, s, n, t in _ADAPTERS)}), s(country, x0, z0, x1, z1) AS (VALUES {', '.join(str(r) for r in _SHEETS)}),
p AS (SELECT poi AS point, x + 0.5 AS x, z + 0.5 AS z FROM poi), o AS (SELECT DISTINCT point, country FROM (SELECT point, i, country FROM p JOIN edge e ON (az > z) <> (bz > z) AND x < (bx - ax) * (z - az) / (bz - az) + ax GROUP BY point, i, country HAVING count(*) % 2 = 1) t)
SELECT point, (SELECT arg_min(country, ord) FROM a WHERE x BETWEEN x0 AND x1 AND z BETWEEN z0 AND z1 AND (NOT exact OR NOT EXISTS (SELECT 1 FROM o WHERE o.point = p.point AND o.country <> a.country) AND (EXISTS (SELECT 1 FROM o WHERE o.point = p.point AND o.country = a.country) OR EXISTS (SELECT 1 FROM s WHERE s.country = a.country AND x >= s.x0 AND x < s.x1 AND z >= s.z0 AND z < s.z1)))) AS country FROM p"""))
def j26(spark, d):
    land, adapters, sheets = _regions(spark)
    p = load(spark, d, "poi").select(F.col("poi").alias("point"), (F.col("x") + 0.5).alias("x"), (F.col("z") + 0.5).alias("z"))
    return regions.country_of(p, adapters, land, sheets, 100.0)


@query("j27_main_neighbour", with_tables("parcel", rest="""WITH b(country, x0, z0, x1, z1) AS (VALUES ('ee', 0, 0, 500, 400), ('ee', 0, 400, 250, 700), ('lv', 500, 0, 1100, 400), ('lv', 250, 400, 600, 1100)),
s AS (SELECT pid, country, sum(greatest(0, least(x + side * 9, x1) - greatest(x, x0)) * greatest(0, least(z + side * 9, z1) - greatest(z, z0))) / CAST(side * side * 81 AS DOUBLE) AS share FROM parcel, b GROUP BY pid, side, country)
SELECT pid AS tile, country AS other, round(share, 6) AS share FROM s WHERE country <> CASE pid % 3 WHEN 0 THEN 'lv' ELSE 'ee' END AND share >= 0.01 QUALIFY row_number() OVER (PARTITION BY pid ORDER BY round(share, 12) DESC, country) = 1"""))
def j27(spark, d):
    land = _regions(spark)[0].where("country <> 'fi'")
    p = load(spark, d, "parcel")
    tiles = p.select(F.col("pid").alias("tile"), F.when(F.col("pid") % 3 == 0, "lv").otherwise("ee").alias("country"), F.col("x").cast("double").alias("xmin"), F.col("z").cast("double").alias("zmin"), (F.col("x") + F.col("side") * 9).cast("double").alias("xmax"), (F.col("z") + F.col("side") * 9).cast("double").alias("zmax"))
    return regions.main_neighbour(tiles, land, 0.01, 128.0).withColumn("share", F.round("share", 6))


@query("q7_outline_areas", with_tables("building", rest="SELECT region, count(*) * 64.0 AS area FROM (SELECT DISTINCT tile AS region, floor(x / 8) AS i, floor(z / 8) AS j FROM building) t GROUP BY region"))
def q7(spark, d):
    """Squares of a grid that hold a building, dissolved by tile: the outer rings less their holes cover what the squares do."""
    b = load(spark, d, "building").select(F.col("tile").alias("region"), F.floor(F.col("x") / 8).alias("i"), F.floor(F.col("z") / 8).alias("j")).distinct()
    rings = regions.outlines(b.select("region", G.square(F.col("i") * 8, F.col("j") * 8, F.lit(8)).alias("ring")), 0.0, 0.0)
    return rings.groupBy("region").agg(F.sum("area").alias("area"))

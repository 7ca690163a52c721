"""Queries on positions, rasters, roads, timetables, search and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.functions import geometry as G
from plotline.operators import quality, raster, roads, search, spatial, transit
from plotline.plans.demo import load, with_tables
from plotline.plans.register_queries import FOLDED
from plotline.plans.registry import ORACLES, query


def _id(rows, name):
    return rows.select("tile", F.col(name).alias("id"), "x", "z")


def _ring(parcels):
    return parcels.select("tile", F.col("pid").alias("polygon"), G.square(F.col("x"), F.col("z"), F.col("side")).alias("ring"))


@query("g13_area", with_tables("parcel", rest="SELECT pid, CAST(side * side AS DOUBLE) AS area, CAST(4 * side AS DOUBLE) AS perimeter, CAST(side AS DOUBLE) / 2 AS width, x + side / 2.0 AS cx, z + side / 2.0 AS cz FROM parcel"))
def g13(spark, d):
    r = F.col("ring")
    return _ring(load(spark, d, "parcel")).select(F.col("polygon").alias("pid"), G.area(r).alias("area"), G.perimeter(r).alias("perimeter"), G.mean_width(r).alias("width"), G.vertex_mean(r).x.alias("cx"), G.vertex_mean(r).z.alias("cz"))


@query("g18_clip", with_tables("parcel", rest="SELECT pid, CAST(greatest(0, least(x + side, 600) - greatest(x, 200)) * greatest(0, least(z + side, 700) - greatest(z, 100)) AS DOUBLE) AS area FROM parcel"))
def g18(spark, d):
    return _ring(load(spark, d, "parcel")).select(F.col("polygon").alias("pid"), G.area(G.clip(F.col("ring"), 200, 100, 600, 700)).alias("area"))


_GRID = """WITH k AS (SELECT 1 / 298.257222101 AS f, 6378137.0 AS a, pi() / 180 AS d), e AS (SELECT a, d, sqrt(2 * f - f * f) AS e FROM k),
q AS (SELECT *, unnest([58.0, 59.3333333333333, 57.5175539305556]) * d AS p, unnest([1, 2, 0]) AS i FROM e),
c AS (SELECT i, cos(p) / sqrt(1 - pow(e * sin(p), 2)) AS m, tan(pi() / 4 - p / 2) / pow((1 - e * sin(p)) / (1 + e * sin(p)), e / 2) AS t FROM q),
o AS (SELECT max(m) FILTER (i = 1) AS m1, max(m) FILTER (i = 2) AS m2, max(t) FILTER (i = 1) AS t1, max(t) FILTER (i = 2) AS t2, max(t) FILTER (i = 0) AS t0 FROM c),
n AS (SELECT ln(m1 / m2) / ln(t1 / t2) AS n, m1, t1, t0 FROM o), g AS (SELECT n, m1 / (n * pow(t1, n)) AS f, t0 FROM n),
x AS (SELECT c_custkey, 57.6 + c_custkey % 100 / 50.0 AS lat, 22.0 + c_custkey % 77 / 12.0 AS lon FROM customer),
y AS (SELECT c_custkey, lat, lon, n * (lon - 24.0) * d AS theta, a * f * pow(tan(pi() / 4 - lat * d / 2) / pow((1 - e * sin(lat * d)) / (1 + e * sin(lat * d)), e / 2), n) AS r, a * f * pow(t0, n) AS r0 FROM x, e, g)
SELECT c_custkey, round(500000 + r * sin(theta), 3) AS e, round(6375000 + r0 - r * cos(theta), 3) AS n, round(lat, 7) AS lat, round(lon, 7) AS lon FROM y"""


@query("g1_grid_round_trip", _GRID)
def g1(spark, d):
    c = load(spark, d, "customer").select("c_custkey", (F.lit(57.6) + F.col("c_custkey") % 100 / 50.0).alias("lat"), (F.lit(22.0) + F.col("c_custkey") % 77 / 12.0).alias("lon"))
    e, n = G.to_grid(F.col("lat"), F.col("lon"))
    c = c.withColumns({"e": e, "n": n})
    lat, lon = G.from_grid(F.col("e"), F.col("n"))
    return c.select("c_custkey", F.round("e", 3).alias("e"), F.round("n", 3).alias("n"), F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


@query("g5_tile_ring", with_tables("parcel", rest="SELECT pid, CAST(floor(x / 256) AS BIGINT) + dx AS tx, CAST(floor(z / 256) AS BIGINT) + dz AS tz FROM parcel, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dz) WHERE dx <> 0 OR dz <> 0"))
def g5(spark, d):
    s = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    p = load(spark, d, "parcel").select("pid", spatial.cell(F.col("x"), 256).alias("tx"), spatial.cell(F.col("z"), 256).alias("tz"))
    return p.withColumn("dx", s).withColumn("dz", s).where("dx <> 0 OR dz <> 0").select("pid", (F.col("tx") + F.col("dx")).alias("tx"), (F.col("tz") + F.col("dz")).alias("tz"))


@query("f1_box", with_tables("poi", rest="SELECT key, count(*) AS n FROM poi WHERE x >= 100 AND x < 400 AND z >= 50 AND z < 800 GROUP BY 1"))
def f1(spark, d):
    return spatial.box_filter(load(spark, d, "poi"), 100, 50, 400, 800).groupBy("key").agg(F.count("*").alias("n"))


@query("f7_exclusions", with_tables("poi", "building", rest="SELECT poi FROM poi p WHERE NOT EXISTS (SELECT 1 FROM building b WHERE b.tile = p.tile AND (p.x - b.x) * (p.x - b.x) + (p.z - b.z) * (p.z - b.z) <= 900)"))
def f7(spark, d):
    return spatial.outside_circles(load(spark, d, "poi"), load(spark, d, "building").select("tile", "x", "z", F.lit(30).alias("r"))).select("poi")


@query("j5_point_in_polygon", with_tables("parcel", "poi", rest="SELECT q.tile, poi AS point, min(pid) AS polygon FROM poi q JOIN parcel p ON p.tile = q.tile AND q.x >= p.x AND q.x < p.x + side AND q.z >= p.z AND q.z < p.z + side GROUP BY ALL"))
def j5(spark, d):
    return spatial.point_in_polygon(load(spark, d, "poi").select("tile", F.col("poi").alias("point"), "x", "z"), _ring(load(spark, d, "parcel")))


_D2 = "(l.x - r.x) * (l.x - r.x) + (l.z - r.z) * (l.z - r.z)"


@query("j8_nearest", with_tables("poi", "building", rest=f"SELECT tile, \"left\", \"right\", d2 FROM (SELECT l.tile, l.poi AS \"left\", r.bid AS \"right\", {_D2} AS d2, row_number() OVER (PARTITION BY l.poi ORDER BY {_D2}, r.bid) AS k FROM poi l JOIN building r ON l.tile = r.tile AND {_D2} <= 6400) WHERE k = 1"))
def j8(spark, d):
    return spatial.nearest(_id(load(spark, d, "poi"), "poi"), _id(load(spark, d, "building"), "bid"), 80)


@query("o6_things_nearby", with_tables("building", "parcel", rest=f"SELECT tile, \"left\", \"right\", d2, rank FROM (SELECT l.tile, l.bid AS \"left\", r.pid AS \"right\", {_D2} AS d2, CAST(row_number() OVER (PARTITION BY l.bid ORDER BY {_D2}, r.pid) AS INT) AS rank FROM building l JOIN parcel r ON l.tile = r.tile AND {_D2} <= 40000) WHERE rank <= 8"))
def o6(spark, d):
    return spatial.nearest_k(_id(load(spark, d, "building"), "bid"), _id(load(spark, d, "parcel"), "pid"), 200, 8)


@query("j7_largest_overlap", with_tables("building", "parcel", rest="""WITH x AS (SELECT b.tile, bid AS a, p.pid AS b, greatest(0, least(b.x + w * 4, p.x + side * 4) - greatest(b.x, p.x)) * greatest(0, least(b.z + d * 4, p.z + side * 4) - greatest(b.z, p.z)) AS overlap, w * d * 16 AS whole FROM building b JOIN parcel p USING (tile))
SELECT tile, a, b, overlap FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY overlap DESC, b) AS r FROM x WHERE overlap > whole * 0.1) WHERE r = 1"""))
def j7(spark, d):
    b, p = load(spark, d, "building"), load(spark, d, "parcel")
    box = lambda t, i, w, h: t.select("tile", F.col(i).alias("id"), F.col("x").alias("xmin"), F.col("z").alias("zmin"), (F.col("x") + F.col(w) * 4).alias("xmax"), (F.col("z") + F.col(h) * 4).alias("zmax"))
    return spatial.largest_overlap(box(b, "bid", "w", "d"), box(p, "pid", "side", "side"), 0.1)


@query("j24_plots_without_poi", with_tables("parcel", "poi", rest="SELECT pid FROM parcel p WHERE NOT EXISTS (SELECT 1 FROM poi q WHERE p.tile = q.tile AND q.x >= p.x AND q.x < p.x + side AND q.z >= p.z AND q.z < p.z + side)"))
def j24(spark, d):
    p = load(spark, d, "parcel")
    rings = p.select("pid", "tile", G.square(F.col("x"), F.col("z"), F.col("side")).alias("ring"))
    return spatial.without_points(rings, load(spark, d, "poi")).select("pid")


@query("r1_focal_sum", with_tables("cell", rest="SELECT c.tile, c.y, c.x, sum(o.v) AS total, count(o.v) AS n FROM cell c JOIN cell o ON o.tile = c.tile AND o.y BETWEEN c.y - 2 AND c.y + 2 AND o.x BETWEEN c.x - 2 AND c.x + 2 GROUP BY ALL"))
def r1(spark, d):
    return raster.focal_sum(load(spark, d, "cell"), 2)


@query("r2_dilate", with_tables("cell", rest="SELECT DISTINCT tile, y + dy AS y, x + dx AS x FROM cell, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx) WHERE v > 45 AND y + dy BETWEEN 0 AND 47 AND x + dx BETWEEN 0 AND 47"))
def r2(spark, d):
    return raster.dilate(load(spark, d, "cell").where("v > 45"), 1, 48)


@query("r2_erode", with_tables("cell", rest="WITH m AS (SELECT tile, y, x FROM cell WHERE v > 5) SELECT a.tile, a.y, a.x FROM m a JOIN m b ON a.tile = b.tile AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL HAVING count(*) = (least(a.y + 1, 47) - greatest(a.y - 1, 0) + 1) * (least(a.x + 1, 47) - greatest(a.x - 1, 0) + 1)"))
def r2e(spark, d):
    return raster.erode(load(spark, d, "cell").where("v > 5"), 1, 48)


_SLOPE = """WITH s AS (SELECT tile, y, x, {0} FROM cell WINDOW h AS (PARTITION BY tile, y ORDER BY x), v AS (PARTITION BY tile, x ORDER BY y))
SELECT tile, y, x, gx, gy, sqrt(gx * gx + gy * gy) AS slope FROM s""".format(", ".join(f"CASE WHEN coalesce(lead({a}) OVER {w}, {a}) > coalesce(lag({a}) OVER {w}, {a}) THEN (coalesce(lead(v) OVER {w}, v) - coalesce(lag(v) OVER {w}, v)) / (coalesce(lead({a}) OVER {w}, {a}) - coalesce(lag({a}) OVER {w}, {a})) ELSE 0.0 END AS g{a}" for a, w in (("x", "h"), ("y", "v"))))


@query("r2_opening", with_tables("cell", rest="""WITH m AS (SELECT tile, y, x FROM cell WHERE v > 5),
e AS (SELECT a.tile, a.y, a.x FROM m a JOIN m b ON a.tile = b.tile AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL HAVING count(*) = (least(a.y + 1, 47) - greatest(a.y - 1, 0) + 1) * (least(a.x + 1, 47) - greatest(a.x - 1, 0) + 1))
SELECT DISTINCT tile, y + dy AS y, x + dx AS x FROM e, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx) WHERE y + dy BETWEEN 0 AND 47 AND x + dx BETWEEN 0 AND 47"""))
def r2o(spark, d):
    return raster.opening(load(spark, d, "cell").where("v > 5"), 1, 48)


@query("r8_gradient", with_tables("cell", rest=_SLOPE))
def r8(spark, d):
    return raster.gradient(load(spark, d, "cell"))


@query("r3_components")
def r3(spark, d):
    return raster.components(load(spark, d, "cell").where("v > 30"))


@query("r5_blob_shapes")
def r5(spark, d):
    c = load(spark, d, "cell")
    return raster.blob_shapes(raster.components(c.where("v > 30")), c)


_FILL = "{1} AS (SELECT a.tile, a.y, a.x, coalesce(s.v, a.m) AS v FROM (SELECT tile, y + dy AS y, x + dx AS x, max(v) AS m FROM {0}, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx) WHERE y + dy BETWEEN 0 AND 47 AND x + dx BETWEEN 0 AND 47 GROUP BY ALL) a LEFT JOIN {0} s USING (tile, y, x))"


@query("r15_fill_gaps", with_tables("cell", rest=f"WITH f0 AS (SELECT tile, y, x, v FROM cell WHERE (y + x) % 7 > 3), {_FILL.format('f0', 'f1')}, {_FILL.format('f1', 'f2')} SELECT tile, y, x, v FROM f2"))
def r15(spark, d):
    return raster.fill_from_neighbours(load(spark, d, "cell").where("(y + x) % 7 > 3"), 48)


@query("r23_resample", with_tables("cell", rest="SELECT tile, CAST(floor(y / 4) AS BIGINT) AS y, CAST(floor(x / 4) AS BIGINT) AS x, avg(v) AS v FROM cell GROUP BY ALL"))
def r23(spark, d):
    return raster.resample_box(load(spark, d, "cell"), 4)


@query("r23_mosaic", with_tables("cell", rest="SELECT 0 AS tile, y, x, arg_max(v, tile) AS v FROM cell GROUP BY y, x"))
def r23b(spark, d):
    c = load(spark, d, "cell")
    return raster.mosaic(c.select(F.lit(0).alias("tile"), "y", "x", "v", F.col("tile").alias("sheet")))


@query("a13_grid_points", with_tables("point", rest="SELECT tile, py AS y, px AS x, avg(h) FILTER (cls = 2) AS ground, max(h) FILTER (cls = 5) AS vegetation, max(h) FILTER (cls = 6) AS roof, count(*) FILTER (cls = 2) AS hits, count(*) AS returns, count(*) FILTER (cls = 9) > 0 AS water, count(*) FILTER (cls = 17) > 0 AS bridge FROM point WHERE cls NOT IN (7, 18) GROUP BY ALL"))
def a13(spark, d):
    return raster.grid_points(load(spark, d, "point"))


@query("a13_water_level", with_tables("point", rest="SELECT tile, quantile_cont(h, 0.5) AS level FROM point WHERE cls = 9 GROUP BY tile HAVING count(*) >= 100"))
def a13b(spark, d):
    return raster.water_levels(load(spark, d, "point"))


@query("a14_split_pulses", with_tables("point", rest="SELECT tile, py AS y, px AS x, max(h) AS top, count(*) AS hits, count(*) FILTER (n_returns > 1) AS split FROM point GROUP BY ALL"))
def a14(spark, d):
    return raster.split_pulses(load(spark, d, "point"))


@query("a15_coverage", with_tables("point", rest="WITH g AS (SELECT tile, py, px, count(*) FILTER (cls = 2) AS hits, count(*) AS returns FROM point WHERE cls NOT IN (7, 18) GROUP BY ALL) SELECT tile, count(*) AS cells, avg((hits > 0)::INT) AS with_ground, sum(returns) / count(*)::DOUBLE AS density FROM g GROUP BY tile"))
def a15(spark, d):
    return raster.coverage(raster.grid_points(load(spark, d, "point")))


@query("a16_zonal_p90", with_tables("cell", "building", rest="SELECT bid AS zone, count(*) AS n, quantile_cont(v, 0.9) AS q FROM building b JOIN cell c ON c.tile = b.tile % 4 AND c.y BETWEEN b.z % 40 AND b.z % 40 + 6 AND c.x BETWEEN b.x % 40 AND b.x % 40 + 5 GROUP BY bid HAVING count(*) >= 3"))
def a16(spark, d):
    z = load(spark, d, "building").selectExpr("bid AS zone", "tile % 4 AS tile", "x % 40 AS x0", "x % 40 + 5 AS x1", "z % 40 AS y0", "z % 40 + 6 AS y1")
    return raster.zonal(load(spark, d, "cell"), z, 0.9, 3)


@query("gr3_node_degrees", with_tables("road", rest="SELECT tile, x, z, count(*) AS arms FROM (SELECT tile, ax AS x, az AS z FROM road WHERE kind IN ('main', 'local') UNION ALL SELECT tile, bx, bz FROM road WHERE kind IN ('main', 'local')) GROUP BY ALL"))
def gr3(spark, d):
    return roads.node_degrees(load(spark, d, "road"), ("main", "local"))


@query("gr2_edges_near", with_tables("road", rest="SELECT kind, count(*) AS n FROM road WHERE pow((ax + bx) / 2.0 - 128, 2) + pow((az + bz) / 2.0 - 128, 2) BETWEEN 400 AND 10000 GROUP BY kind"))
def gr2(spark, d):
    return roads.length_by_kind(load(spark, d, "road"), 128, 128, 20, 100)


@query("gr4_straightest_next", with_tables("road", rest="SELECT rid, next FROM (SELECT l.rid, r.rid AS next, row_number() OVER (PARTITION BY l.rid ORDER BY ((l.bx - l.ax) * (r.bx - r.ax) + (l.bz - l.az) * (r.bz - r.az)) / sqrt(((pow(l.bx - l.ax, 2) + pow(l.bz - l.az, 2)) * (pow(r.bx - r.ax, 2) + pow(r.bz - r.az, 2)))::DOUBLE) DESC, r.rid) AS k FROM road l JOIN road r ON l.tile = r.tile AND l.bx = r.ax AND l.bz = r.az AND l.rid <> r.rid) WHERE k = 1"))
def gr4(spark, d):
    return roads.straightest_next(load(spark, d, "road"))


@query("a24_longest_stretch", with_tables("road", rest="SELECT tile, name, rid FROM (SELECT *, row_number() OVER (PARTITION BY tile, name ORDER BY pow(bx - ax, 2) + pow(bz - az, 2) DESC, rid) AS k FROM road) WHERE k = 1"))
def a24(spark, d):
    return roads.longest_per_name(load(spark, d, "road"))


@query("j11_stop_to_road", with_tables("road", "poi", rest="""WITH s AS (SELECT q.tile, poi AS id, rid, width, (bx - ax) * (q.z % 256 - az) - (bz - az) * (q.x % 256 - ax) AS c,
 CASE WHEN (bx - ax) * (bx - ax) + (bz - az) * (bz - az) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, ((q.x % 256 - ax) * (bx - ax) + (q.z % 256 - az) * (bz - az)) / ((bx - ax) * (bx - ax) + (bz - az) * (bz - az))::DOUBLE)) END AS u, q.x % 256 AS px, q.z % 256 AS pz, ax, az, bx, bz FROM poi q JOIN road r ON q.tile = r.tile),
e AS (SELECT *, sqrt(pow(px - (ax + u * (bx - ax)), 2) + pow(pz - (az + u * (bz - az)), 2)) AS d FROM s)
SELECT tile, id, rid, round(d, 6) AS d, CAST(sign(c) AS INT) AS side FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d / greatest(width, 1), rid) AS k FROM e WHERE d <= 25) WHERE k = 1"""))
def j11(spark, d):
    stops = load(spark, d, "poi").selectExpr("tile", "poi AS id", "x % 256 AS x", "z % 256 AS z")
    return spatial.nearest_segment(stops, load(spark, d, "road").select("tile", "rid", "ax", "az", "bx", "bz", "width"), 25.0).select("tile", "id", "rid", F.round("d", 6).alias("d"), "side")


@query("j11_all_points_to_road", ORACLES["j11_stop_to_road"])
def j11_all(spark, d):
    points = load(spark, d, "poi").selectExpr("tile", "poi AS id", "x % 256 AS x", "z % 256 AS z")
    return spatial.nearest_segment(points, load(spark, d, "road").select("tile", "rid", "ax", "az", "bx", "bz", "width"), 25.0).select("tile", "id", "rid", F.round("d", 6).alias("d"), "side")


@query("w5_arclength", with_tables("stop_time", rest="SELECT id, seq, round(sum(coalesce(sqrt(pow(x - px, 2) + pow(z - pz, 2)), 0)) OVER (PARTITION BY id ORDER BY seq), 6) AS cum FROM (SELECT *, lag(x) OVER w AS px, lag(z) OVER w AS pz FROM (SELECT trip AS id, seq, stop % 97 AS x, stop % 89 AS z FROM stop_time) WINDOW w AS (PARTITION BY id ORDER BY seq))"))
def w5(spark, d):
    p = load(spark, d, "stop_time").selectExpr("trip AS id", "seq", "stop % 97 AS x", "stop % 89 AS z")
    return roads.arclength(p).select("id", "seq", F.round("cum", 6).alias("cum"))


@query("w7_split_ways", with_tables("stop_time", rest="""WITH n AS (SELECT trip AS id, seq, stop * 100 + trip % 100 AS node FROM stop_time), u AS (SELECT node, count(*) AS uses FROM n GROUP BY 1),
c AS (SELECT n.*, uses > 1 AND row_number() OVER w > 1 AND seq < max(seq) OVER (PARTITION BY id) AS cut FROM n JOIN u USING (node) WINDOW w AS (PARTITION BY id ORDER BY seq)),
p AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece FROM c)
SELECT id, CAST(piece AS BIGINT) AS piece, seq, node FROM p UNION ALL SELECT id, CAST(piece + 1 AS BIGINT), seq, node FROM p WHERE cut"""))
def w7(spark, d):
    return roads.split_at_shared(load(spark, d, "stop_time").selectExpr("trip AS id", "seq", "stop * 100 + trip % 100 AS node"))


_CLOCK = "lpad(CAST(CAST(floor(m / 60) AS BIGINT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(m % 60 AS VARCHAR), 2, '0')"


@query("a20_departures", with_tables("trip", "stop_time", rest=f"""WITH f AS (SELECT trip, arg_min(minute, seq) % 1440 AS m FROM stop_time GROUP BY trip)
SELECT line, headsign, CASE WHEN service < 5 THEN 'weekday' WHEN service = 5 THEN 'saturday' ELSE 'sunday' END AS day, array_to_string(list_sort(list(DISTINCT {_CLOCK})), ' ') AS times FROM f JOIN trip USING (trip) GROUP BY ALL"""))
def a20(spark, d):
    return transit.departures(load(spark, d, "trip"), load(spark, d, "stop_time"))


@query("a20_all_departures", ORACLES["a20_departures"])
def a20_all(spark, d):
    return transit.departures(load(spark, d, "trip"), load(spark, d, "stop_time"))


@query("j22_calls", with_tables("stop_time", rest="SELECT trip, array_to_string(list(CAST(stop AS VARCHAR) ORDER BY seq, stop), '>') AS calls FROM stop_time GROUP BY trip"))
def j22(spark, d):
    return transit.calls_in_order(load(spark, d, "stop_time"))


@query("o4_departure_board", with_tables("trip", "stop_time", rest="SELECT stop, place, line, wait FROM (SELECT stop, line, (minute - 1000 + 2880) % 1440 AS wait, CAST(row_number() OVER (PARTITION BY stop ORDER BY (minute - 1000 + 2880) % 1440, lpad(regexp_extract(line, '^(\\d*)', 1), 9, '0') || line, trip, seq) AS INT) AS place FROM stop_time JOIN trip USING (trip)) WHERE place <= 5"))
def o4(spark, d):
    return transit.board(load(spark, d, "stop_time"), load(spark, d, "trip"), 1000, 5, calls=load(spark, d, "lineitem").count())


@query("j35_on_the_road", with_tables("stop_time", rest="WITH f AS (SELECT trip, arg_min(minute, seq) % 1440 AS m FROM stop_time GROUP BY trip), c AS (SELECT unnest(range(0, 1440, 90)) AS now) SELECT now, trip, (now - m + 1440) % 1440 AS age FROM f, c WHERE (now - m + 1440) % 1440 <= 45"))
def j35(spark, d):
    return transit.on_the_road(load(spark, d, "stop_time"), spark.range(0, 1440, 90).withColumnRenamed("id", "now"), 45)


@query("w12_thinned", with_tables("stop_time", rest="SELECT stop, trip, seq FROM (SELECT *, row_number() OVER (PARTITION BY stop ORDER BY trip * 100 + seq) AS i FROM stop_time) WHERE (i - 1) % 3 = 0"))
def w12(spark, d):
    return transit.thinned(load(spark, d, "stop_time").withColumn("o", F.col("trip") * 100 + F.col("seq")), "stop", "o", 3, size=load(spark, d, "lineitem").count()).select("stop", "trip", "seq")


@query("tm1_opening_hours", with_tables("poi", rest="""WITH r AS (SELECT * FROM (VALUES ('24/7', [0,1,2,3,4,5,6], [[0,1440]]), ('Mo-Fr 08:00-12:00,13:00-17:00', [0,1,2,3,4], [[480,720],[780,1020]]), ('Fr,Sa 11:00-02:00', [4,5], [[660,1560]]), ('Mo-Su 10:00-20:00; Su off', [0,1,2,3,4,5], [[600,1200]]), ('Sa-Mo 09:00-15:30', [5,6,0], [[540,930]])) AS t(h, days, spans))
SELECT poi, day, s[1] AS open, s[2] AS close FROM (SELECT poi, unnest(days) AS day, spans FROM poi JOIN r ON h = opening_hours), unnest(spans) AS u(s)"""))
def tm1(spark, d):
    return transit.opening_hours(load(spark, d, "poi"))


@query("tm2_open_now", with_tables("poi", rest="SELECT DISTINCT poi FROM poi WHERE opening_hours = '24/7' OR opening_hours = 'Fr,Sa 11:00-02:00'"))
def tm2(spark, d):
    return transit.open_at(transit.opening_hours(load(spark, d, "poi")), 6, 60)


_SC = "CASE WHEN length(n) < 2 THEN 0 WHEN h = n THEN 4 WHEN starts_with(h, n) THEN 3 WHEN contains(h, n) THEN 2 ELSE 0 END"
_FD = FOLDED


@query("q1_score", with_tables("parcel", rest=f"SELECT pid, q, {_SC} AS score FROM (SELECT pid, q, {_FD.format('address')} AS h, {_FD.format('q')} AS n FROM parcel, (VALUES ('joe'), ('tänav 1'), ('a'), ('Aeru tn 1')) AS t(q))"))
def q1(spark, d):
    asked = spark.createDataFrame([("joe",), ("tänav 1",), ("a",), ("Aeru tn 1",)], "q string")
    return load(spark, d, "parcel").join(F.broadcast(asked)).select("pid", "q", search.score(F.col("address"), F.col("q")).alias("score"))


@query("q2_place_search", with_tables("parcel", "building", rest=f"""WITH a AS (SELECT q, 'plot' AS kind, label, {_SC} + 1 AS score, {_SC} AS s FROM (SELECT q, address AS label, {_FD.format('address')} AS h, {_FD.format('q')} AS n FROM parcel, (VALUES ('joe'), ('kesk mnt 2'), ('aeru')) AS t(q))
 UNION ALL SELECT q, 'building', label, {_SC}, {_SC} FROM (SELECT q, address AS label, {_FD.format('address')} AS h, {_FD.format('q')} AS n FROM building, (VALUES ('joe'), ('kesk mnt 2'), ('aeru')) AS t(q))),
b AS (SELECT *, row_number() OVER (PARTITION BY q, kind ORDER BY score DESC, label) = 1 AS lead FROM a WHERE s > 0)
SELECT q, place, kind, label FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY lead DESC, score DESC, label, kind) AS INT) AS place FROM b) WHERE place <= 10"""))
def q2(spark, d):
    asked = spark.createDataFrame([("joe",), ("kesk mnt 2",), ("aeru",)], "q string")
    label = lambda t: load(spark, d, t).select(F.col("address").alias("label"))
    return search.find(asked, {"plot": (label("parcel"), 1), "building": (label("building"), 0)}, 10)


@query("q3_words", "SELECT q, place, key FROM (SELECT q, key, CAST(row_number() OVER (PARTITION BY q ORDER BY length(key), key) AS INT) AS place FROM (SELECT DISTINCT q, p_name AS key FROM part, (VALUES ('a e'), ('part 1'), ('in o')) AS t(q) WHERE list_bool_and(list_transform(string_split(q, ' '), lambda w: contains(lower(p_name), w))))) WHERE place <= 7")
def q3(spark, d):
    asked = spark.createDataFrame([("a e",), ("part 1",), ("in o",)], "q string")
    return search.words_in_key(load(spark, d, "part").select(F.col("p_name").alias("key")), asked, 7)


@query("a11_streets", with_tables("parcel", rest="SELECT regexp_extract(address, '^(\\D*)\\s\\d', 1) AS street, count(*) AS n, avg(x) AS x, avg(z) AS z FROM parcel GROUP BY 1"))
def a11(spark, d):
    return search.streets(load(spark, d, "parcel"))


_SECTORS = ("farm", "industry", "construction", "trade", "transport", "hospitality", "media", "finance", "property", "services", "public", "culture")


@query("d2_rules", with_tables("company", "parcel", rest=f"""WITH t AS (SELECT CAST(code AS VARCHAR) || CASE WHEN code % 8 = 0 THEN '-7' ELSE '' END AS code, CASE WHEN code % 31 > 0 THEN name END AS name, CASE WHEN code % 5 = 4 THEN 'near' ELSE match END AS match, CASE WHEN code % 4 > 0 THEN tunnus END AS pid, legal_form, lower(sector) AS sector FROM company)
SELECT 'code' AS rule, code AS key, 'error' AS severity FROM t WHERE NOT (regexp_matches(code, '^[0-9]+$') OR regexp_matches(code, '^[0-9]{{7}}-[0-9]$')) OR name IS NULL
UNION ALL SELECT 'match', code, 'error' FROM t WHERE match NOT IN ('exact', 'street', 'none') UNION ALL SELECT 'target', code, 'error' FROM t WHERE match = 'exact' AND pid IS NULL
UNION ALL SELECT 'person', code, 'error' FROM t WHERE legal_form = 'FIE' UNION ALL SELECT 'sector', code, 'warning' FROM t WHERE sector NOT IN {_SECTORS}"""))
def d2(spark, d):
    c, col = load(spark, d, "company"), F.col
    t = c.select(
        F.concat(col("code").cast("string"), F.when(col("code") % 8 == 0, "-7").otherwise("")).alias("code"), F.when(col("code") % 31 > 0, col("name")).alias("name"), F.when(col("code") % 5 == 4, "near").otherwise(col("match")).alias("match"),
        F.when(col("code") % 4 > 0, col("tunnus")).alias("pid"), "legal_form", F.lower("sector").alias("sector"),
    )
    return quality.violations(t, "code", quality.tenant_rules("code", "name", "match", "pid", "legal_form", "sector", ("FIE",), _SECTORS))


@query("d3_dangling", with_tables("company", "parcel", rest="SELECT 'tunnus' AS rule, CAST(code AS VARCHAR) AS key, 'error' AS severity FROM company WHERE tunnus NOT IN (SELECT tunnus FROM parcel)"))
def d3(spark, d):
    return quality.dangling(load(spark, d, "company"), "code", "tunnus", load(spark, d, "parcel"), "tunnus", "tunnus")


@query("d3_all_dangling", ORACLES["d3_dangling"])
def d3_all(spark, d):
    return quality.dangling(load(spark, d, "company"), "code", "tunnus", load(spark, d, "parcel"), "tunnus", "tunnus")


@query("d4_private_text", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS emails FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')")
def d4(spark, d):
    return quality.private_text(load(spark, d, "documents"), "doc_id", "text")


@query("d7_duplicates", with_tables("company", rest="SELECT address, count(*) AS n FROM company GROUP BY address HAVING count(*) > 1"))
def d7(spark, d):
    return quality.duplicates(load(spark, d, "company"), "address")


@query("d8_severity", with_tables("company", rest="SELECT rule, severity, count(*) AS n FROM (SELECT 'overdue' AS rule, 'warning' AS severity FROM company WHERE overdue UNION ALL SELECT 'staff', 'error' FROM company WHERE employees > 45 UNION ALL SELECT 'sector', 'error' FROM company WHERE active AND sector IS NULL) GROUP BY ALL"))
def d8(spark, d):
    rules = {"overdue": (~F.col("overdue"), "warning"), "staff": (F.col("employees") <= 45, "error"), "sector": (~F.col("active") | F.col("sector").isNotNull(), "error")}
    return quality.severity_counts(quality.violations(load(spark, d, "company"), "code", rules))

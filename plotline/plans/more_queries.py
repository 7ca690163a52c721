"""Queries on register rows, sheets, rasters, timetables and packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.functions import geometry as G
from plotline.functions import text as T
from plotline.operators import quality, raster, registers, spatial, transit
from plotline.plans.demo import load, with_tables
from plotline.plans.register_queries import _J1, _UUID, _matched, _with
from plotline.plans.registry import query


@query("f2_settlements", with_tables("company", "parcel", rest="SELECT code, settlement FROM company WHERE settlement IN (SELECT settlement FROM parcel)"))
def f2(spark, d):
    return registers.in_settlements(load(spark, d, "company"), load(spark, d, "parcel"), "settlement").select("code", "settlement")


@query("f3_legal_persons", with_tables("company", rest="SELECT code, legal_form FROM company WHERE legal_form NOT IN ('FIE', 'Korteriühistu')"))
def f3(spark, d):
    return registers.legal_persons(load(spark, d, "company"), "legal_form", ("FIE", "Korteriühistu")).select("code", "legal_form")


_HOLDER = f"CASE WHEN lower(raw) IN ('--', 'pole') THEN NULL WHEN regexp_matches(raw, '^[0-9]+$') THEN raw ELSE {_UUID} END"


@query("a8_holders", with_tables("officer", rest=f"""WITH x AS (SELECT code, role IN ('JUHL', 'JUHE', 'JUHT', 'TEGJ', 'PROK') AS board, role = 'OSAN' AS owner, {_HOLDER} AS id FROM (SELECT *, sha1(unhex('{T.NAMESPACE}') || encode(lower(raw))) AS h FROM officer WHERE NOT ended) y)
SELECT code, CASE WHEN count(*) FILTER (board) > 0 THEN CAST(count(DISTINCT id) FILTER (board) AS INT) END AS board_size, CASE WHEN count(*) FILTER (owner) > 0 THEN CAST(count(DISTINCT id) FILTER (owner) AS INT) END AS shareholders,
 CASE WHEN count(*) FILTER (board) > 0 AND count(*) FILTER (owner) > 0 THEN count(DISTINCT id) FILTER (board) + count(DISTINCT id) FILTER (owner) > count(DISTINCT id) FILTER (board OR owner) END AS owner_managed, coalesce(array_to_string(list_sort(list(DISTINCT id) FILTER ((board OR owner) AND id IS NOT NULL)), ','), '') AS holders
FROM x GROUP BY code"""))
def a8(spark, d):
    return registers.holders(load(spark, d, "officer")).withColumn("holders", F.array_join("holders", ","))


@query("f4_open_board", with_tables("officer", rest="SELECT role, count(*) AS n, count(DISTINCT code) AS companies FROM officer WHERE NOT ended AND role IN ('JUHL', 'JUHE', 'JUHT', 'TEGJ', 'PROK') GROUP BY role"))
def f4(spark, d):
    o = load(spark, d, "officer").where(~F.col("ended") & F.col("role").isin(*registers.BOARD_ROLES))
    return o.groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("code").alias("companies"))


@query("f6_standing", with_tables("building", rest="SELECT bid FROM building b WHERE (year <= 1960 OR year IS NULL) AND NOT EXISTS (SELECT 1 FROM building e WHERE e.kind = 'outbuilding' AND e.bid <> b.bid AND e.tile = b.tile AND (e.x - b.x) * (e.x - b.x) + (e.z - b.z) * (e.z - b.z) <= 400)"))
def f6(spark, d):
    b = load(spark, d, "building")
    near = spatial.near_pairs(b.select("tile", F.col("bid").alias("id"), "x", "z"), b.where("kind = 'outbuilding'").select("tile", F.col("bid").alias("id"), "x", "z"), 20)
    gone = near.where(F.col("left") != F.col("right")).select(F.col("left").alias("bid")).distinct()
    return registers.standing_in(b, 1960, True).join(gone, "bid", "left_anti").select("bid")


@query("f8_route_types", with_tables("trip", rest="SELECT trip, route_type FROM (SELECT trip, CASE trip % 6 WHEN 0 THEN '3' WHEN 1 THEN '11' WHEN 2 THEN '0' WHEN 3 THEN '700' WHEN 4 THEN '2' ELSE '715' END AS route_type FROM trip) x WHERE route_type IN ('3', '11', '700', '701', '702', '704', '711', '715', '800')"))
def f8(spark, d):
    t = load(spark, d, "trip").selectExpr("trip", "CASE trip % 6 WHEN 0 THEN '3' WHEN 1 THEN '11' WHEN 2 THEN '0' WHEN 3 THEN '700' WHEN 4 THEN '2' ELSE '715' END AS route_type")
    return t.where(F.col("route_type").isin(*registers.BUS_TYPES))


@query("f11_blank_tiles", with_tables("cell", rest="SELECT tile, y FROM (SELECT tile, y, avg(255 - v / 2.5 / (1 + y % 3)) AS m, stddev_pop(255 - v / 2.5 / (1 + y % 3)) AS s FROM cell GROUP BY ALL) x WHERE m > 240 AND s < 12"))
def f11(spark, d):
    return raster.blank(load(spark, d, "cell").withColumn("luminance", 255 - F.col("v") / 2.5 / (1 + F.col("y") % 3)), ["tile", "y"], "luminance")


@query("f12_finite", "SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 11 = 0 THEN CAST('-Infinity' AS DOUBLE) WHEN event_id % 13 = 0 THEN NULL ELSE value END AS v FROM events) x WHERE v IS NOT NULL AND isfinite(v)")
def f12(spark, d):
    e = load(spark, d, "events").selectExpr("event_id", "CASE WHEN event_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 11 = 0 THEN CAST('-Infinity' AS DOUBLE) WHEN event_id % 13 = 0 THEN NULL ELSE value END AS v")
    return registers.finite(e, "v").select("event_id")


@query("j6_one_point_per_outline", with_tables("parcel", "poi", rest="""WITH h AS (SELECT poi, min(pid) AS pid FROM poi q JOIN parcel p ON p.tile = q.tile AND q.x >= p.x AND q.x < p.x + side AND q.z >= p.z AND q.z < p.z + side GROUP BY poi)
SELECT pid, poi FROM (SELECT pid, poi, row_number() OVER (PARTITION BY pid ORDER BY poi * 37 % 211 DESC, poi) AS r FROM h) x WHERE r = 1"""))
def j6(spark, d):
    p = load(spark, d, "parcel").select("tile", F.col("pid").alias("polygon"), G.square(F.col("x"), F.col("z"), F.col("side")).alias("ring"))
    hit = spatial.point_in_polygon(load(spark, d, "poi").select("tile", F.col("poi").alias("point"), "x", "z"), p)
    return hit.groupBy(F.col("polygon").alias("pid")).agg(F.max_by("point", F.struct(F.col("point") * 37 % 211, -F.col("point"))).alias("poi"))


@query("j18_status", with_tables("company", "proceeding", rest="""SELECT code, CASE WHEN n THEN 'N' WHEN l THEN 'L' WHEN p THEN 'P' ELSE 'R' END AS status FROM (SELECT c.code, coalesce(bool_or(form = 'INSOLVENCY' AND NOT ended), false) AS n, coalesce(bool_or(form = 'LIQUIDATION'), false) AS l, coalesce(bool_or(coalesce(form, '') NOT IN ('INSOLVENCY', 'LIQUIDATION') AND NOT ended), false) AS p
 FROM company c LEFT JOIN proceeding q ON q.code = c.code GROUP BY c.code) x"""))
def j18(spark, d):
    return registers.statuses(load(spark, d, "company"), load(spark, d, "proceeding"))


@query("j19_yearly_reports", with_tables("statement", "income", rest="""SELECT code, year, t AS turnover, employees FROM (SELECT s.code, s.year, i.turnover * CASE WHEN thousands THEN 1000 ELSE 1 END AS t, s.employees, row_number() OVER (PARTITION BY s.code, s.year ORDER BY i.turnover IS NULL, s.sid DESC) AS r
 FROM statement s LEFT JOIN income i ON i.sid = s.sid WHERE s.year IS NOT NULL) x WHERE r = 1"""))
def j19(spark, d):
    return registers.yearly_reports(load(spark, d, "statement"), load(spark, d, "income"))


@query("a7_taxes_of_year", with_tables("company_quarter", rest="SELECT code, year, taxes FROM (SELECT code, year, CAST(sum(coalesce(taxes, 0)) AS BIGINT) AS taxes, row_number() OVER (PARTITION BY code ORDER BY count(*) = 4 DESC, year DESC) AS r FROM company_quarter GROUP BY code, year) x WHERE r = 1"))
def a7(spark, d):
    return registers.taxes_of_latest_year(load(spark, d, "company_quarter"))


@query("j20_first_property", with_tables("holding", rest="""WITH k AS (SELECT owner, array_to_string(list_sort(list(DISTINCT CASE (owner + CAST(tunnus AS BIGINT)) % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'company' ELSE 'state' END)), ', ') AS kinds FROM holding GROUP BY owner)
SELECT tunnus, property, kinds FROM (SELECT tunnus, owner AS property, row_number() OVER (PARTITION BY tunnus ORDER BY owner % 100, owner) AS r FROM holding) x JOIN k ON k.owner = property WHERE r = 1"""))
def j20(spark, d):
    h = load(spark, d, "holding").selectExpr("tunnus", "owner AS property", "owner % 100 AS ord", "CASE (owner + CAST(tunnus AS BIGINT)) % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'company' ELSE 'state' END AS kind")
    return registers.first_property(h)


@query("j21_purposes", """WITH a AS (SELECT l_partkey AS tunnus, l_returnflag || l_linestatus AS purpose, CAST(sum(l_quantity) AS BIGINT) AS area FROM lineitem GROUP BY ALL)
SELECT tunnus, array_to_string(list(purpose ORDER BY area DESC, purpose), ',') AS purposes, array_to_string(list(CAST(CAST(round(area * 100 / CAST(whole AS DOUBLE)) AS BIGINT) AS VARCHAR) ORDER BY area DESC, purpose), ',') AS pct
FROM (SELECT *, sum(area) OVER (PARTITION BY tunnus) AS whole FROM a) x GROUP BY tunnus""")
def j21(spark, d):
    a = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("tunnus"), F.concat("l_returnflag", "l_linestatus").alias("purpose")).agg(F.sum("l_quantity").cast("long").alias("area"))
    return registers.purposes_by_area(a)


@query("j32_straddling", with_tables("building", rest="WITH c AS (SELECT bid, unnest([pid, (bid * 31) % 190 + 1, CASE WHEN bid % 5 = 0 THEN (bid * 7) % 190 + 1 END]) AS p FROM building), e AS (SELECT DISTINCT bid, p FROM c WHERE p IS NOT NULL) SELECT DISTINCT l.p AS a, r.p AS b FROM e l JOIN e r ON l.bid = r.bid AND l.p < r.p"))
def j32(spark, d):
    return registers.straddling_pairs(load(spark, d, "building").selectExpr("bid", "array(pid, (bid * 31) % 190 + 1, CASE WHEN bid % 5 = 0 THEN (bid * 7) % 190 + 1 END) AS cadastral"))


@query("j39_strangers", _with("company", "parcel", "building", rest=_J1 + """ SELECT m.code, CASE WHEN m.pid IS NOT NULL AND p.pid IS NULL AND m.bid IS NULL THEN 'street' ELSE m.match END AS match, m.via, p.pid, m.bid FROM matched m LEFT JOIN (SELECT pid FROM parcel WHERE ownership <> 'state') p ON p.pid = m.pid"""))
def j39(spark, d):
    return registers.without_strangers(_matched(spark, d), load(spark, d, "parcel").where("ownership <> 'state'"))


@query("w14_first_of_each", with_tables("building", rest="SELECT bid, pid FROM (SELECT bid, pid, row_number() OVER (PARTITION BY pid ORDER BY floors DESC, bid) AS r FROM building WHERE pid IS NOT NULL) x WHERE r = 1"))
def w14(spark, d):
    b = load(spark, d, "building").where("pid IS NOT NULL").withColumn("low", -F.col("floors"))
    return registers.first_of_each(b, "pid", ["low", "bid"]).select("bid", "pid")


@query("u1_union_of_extracts", "SELECT kind, id, name FROM (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY i) AS r FROM (SELECT c_nationkey % 2 AS kind, c_custkey AS id, 'a ' || c_name AS name, 0 AS i FROM customer WHERE c_nationkey < 15 UNION ALL SELECT c_nationkey % 2, c_custkey, 'b ' || c_name, 1 FROM customer WHERE c_nationkey >= 8) x) y WHERE r = 1")
def u1(spark, d):
    c = load(spark, d, "customer")
    part = lambda rows, tag: rows.select((F.col("c_nationkey") % 2).alias("kind"), F.col("c_custkey").alias("id"), F.concat(F.lit(tag), "c_name").alias("name"))
    return registers.union_of_extracts([part(c.where("c_nationkey < 15"), "a "), part(c.where("c_nationkey >= 8"), "b ")], ["kind", "id"])


@query("u2_nearest_copy", with_tables("parcel", rest="WITH c AS (SELECT tunnus, tile, area FROM parcel UNION ALL SELECT tunnus, (tile + 2) % 9, area + 1 FROM parcel WHERE pid % 3 = 0) SELECT tunnus, tile, area FROM (SELECT *, row_number() OVER (PARTITION BY tunnus ORDER BY abs(tile - 4), tile) AS r FROM c) x WHERE r = 1"))
def u2(spark, d):
    p = load(spark, d, "parcel").select("pid", "tunnus", "tile", "area")
    copies = p.drop("pid").unionByName(p.where("pid % 3 = 0").select("tunnus", ((F.col("tile") + 2) % 9).alias("tile"), (F.col("area") + 1).alias("area")))
    return registers.nearest_copy(copies, "tunnus", F.struct(F.abs(F.col("tile") - 4), "tile"))


@query("u3_union_of_feeds", with_tables("trip", rest="SELECT 'city:' || CAST(trip AS VARCHAR) AS trip, line FROM trip WHERE service < 4 UNION ALL SELECT 'region:' || CAST(trip AS VARCHAR), line FROM trip WHERE service > 2"))
def u3(spark, d):
    t = load(spark, d, "trip").select("trip", "line", "service")
    return registers.union_of_feeds({"city": t.where("service < 4"), "region": t.where("service > 2")}, ["trip"]).select("trip", "line")


@query("a21_lines", with_tables("trip", rest="SELECT service, count(*) AS trips, count(DISTINCT line) AS n, array_to_string(list(DISTINCT line ORDER BY length(line), line), ',') AS lines FROM trip GROUP BY service"))
def a21(spark, d):
    return transit.lines_by(load(spark, d, "trip"), "service")


@query("o5_routes_at_stop", with_tables("trip", "stop_time", rest="SELECT stop, array_to_string(list(line || ' ' || headsign ORDER BY lpad(regexp_extract(line, '^(\\d*)', 1), 9, '0') || line, headsign), ';') AS routes FROM (SELECT DISTINCT stop, line, headsign FROM stop_time JOIN trip USING (trip)) x GROUP BY stop"))
def o5(spark, d):
    return transit.routes_at(load(spark, d, "stop_time"), load(spark, d, "trip"))


@query("d1_required", with_tables("parcel", rest="""WITH p AS (SELECT CASE WHEN pid % 17 > 0 THEN tunnus END AS tunnus, pid, CASE WHEN pid % 11 = 0 THEN 'unknown' ELSE CAST(land_value AS VARCHAR) END AS land_value, CASE WHEN pid % 19 = 3 THEN '' ELSE address END AS address FROM parcel)
SELECT 'tunnus' AS rule, CAST(pid AS VARCHAR) AS key, 'error' AS severity FROM p WHERE tunnus IS NULL UNION ALL SELECT 'land_value', CAST(pid AS VARCHAR), 'error' FROM p WHERE land_value IS NOT NULL AND TRY_CAST(land_value AS DOUBLE) IS NULL UNION ALL SELECT 'address', CAST(pid AS VARCHAR), 'warning' FROM p WHERE address = ''"""))
def d1(spark, d):
    p = load(spark, d, "parcel").selectExpr("CASE WHEN pid % 17 > 0 THEN tunnus END AS tunnus", "pid", "CASE WHEN pid % 11 = 0 THEN 'unknown' ELSE CAST(land_value AS STRING) END AS land_value", "CASE WHEN pid % 19 = 3 THEN '' ELSE address END AS address")
    rules = {"tunnus": (F.col("tunnus").isNotNull(), "error"), "land_value": (quality.number_or_null("land_value"), "error"), "address": (F.col("address") != "", "warning")}
    return quality.violations(p, "pid", rules)


@query("d5_departures", with_tables("trip", "stop_time", rest="""WITH t AS (SELECT trip, CASE WHEN service < 5 THEN 'weekday' WHEN service = 5 THEN 'saturday' ELSE 'holiday' END AS day, count(*) AS points, lpad(CAST(CAST(floor(min(minute) / 60.0) AS BIGINT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(min(minute) % 60 AS VARCHAR), 2, '0') AS clock FROM stop_time JOIN trip USING (trip) GROUP BY trip, service)
SELECT 'day' AS rule, CAST(trip AS VARCHAR) AS key, 'error' AS severity FROM t WHERE day NOT IN ('weekday', 'saturday', 'sunday') UNION ALL SELECT 'time', CAST(trip AS VARCHAR), 'error' FROM t WHERE NOT regexp_matches(clock, '^[0-2][0-9]:[0-5][0-9]$') UNION ALL SELECT 'shape', CAST(trip AS VARCHAR), 'error' FROM t WHERE points < 2"""))
def d5(spark, d):
    day = F.when(F.col("service") < 5, "weekday").when(F.col("service") == 5, "saturday").otherwise("holiday")
    t = load(spark, d, "stop_time").groupBy("trip").agg(F.count("*").alias("points"), F.min("minute").alias("m")).join(load(spark, d, "trip").select("trip", day.alias("day")), "trip")
    at = F.concat(F.lpad(F.floor(F.col("m") / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("m") % 60).cast("string"), 2, "0"))
    return quality.violations(t.withColumn("at", at), "trip", quality.departure_rules("day", "at", "points"))


@query("d6_market", with_tables("parcel", rest="WITH m AS (SELECT tile, purpose, count(land_value) AS n, median(land_value) - 20000 AS median FROM parcel GROUP BY ALL) SELECT 'median' AS rule, tile || ' ' || coalesce(purpose, '') AS key, 'error' AS severity FROM m WHERE median < 0 UNION ALL SELECT 'n', tile || ' ' || coalesce(purpose, ''), 'error' FROM m WHERE n < 25"))
def d6(spark, d):
    m = load(spark, d, "parcel").groupBy("tile", "purpose").agg(F.count("land_value").alias("n"), (F.percentile("land_value", F.lit(0.5)) - 20000).alias("median"))
    m = m.withColumn("key", F.concat_ws(" ", F.col("tile").cast("string"), F.coalesce("purpose", F.lit(""))))
    return quality.violations(m, "key", {"median": (F.col("median") >= 0, "error"), "n": (F.col("n") >= 25, "error")})


@query("r12_cover", with_tables("pixel", rest="""WITH i AS (SELECT pixel, canopy, greatest(r, g, b) AS v, CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) END AS s, g - greatest(r, b) AS e FROM pixel),
c AS (SELECT *, CASE WHEN v > 0.62 AND s < 0.22 THEN 3 WHEN e > 0.03 THEN CASE WHEN v > 0.5 AND s > 0.35 THEN 1 WHEN v > 0.36 THEN 0 ELSE 2 END WHEN v < 0.25 THEN 2 ELSE 4 END AS id FROM i)
SELECT pixel, CASE WHEN canopy >= 2.5 AND id <> 3 THEN 2 WHEN id = 2 AND canopy < 1.0 AND v < 0.3 THEN 4 ELSE id END AS cover FROM c"""))
def r12(spark, d):
    return raster.classify_cover(load(spark, d, "pixel"), F.col("r"), F.col("g"), F.col("b"), F.col("canopy")).select("pixel", "cover")


@query("r13_rasterise", with_tables("building", rest="SELECT bid AS shape, tile, x + u AS cx, z + v AS cz FROM (SELECT *, unnest(range(w)) AS u FROM building) a, (SELECT unnest(range(12)) AS v) b WHERE v < d"))
def r13(spark, d):
    b = load(spark, d, "building")
    at = lambda a, c: F.struct((F.col("x") + a).cast("double").alias("x"), (F.col("z") + c).cast("double").alias("z"))
    ring = F.array(at(F.lit(0), F.lit(0)), at(F.col("w"), F.lit(0)), at(F.col("w"), F.col("d")), at(F.lit(0), F.col("d")))
    return raster.rasterise(b.select("tile", F.col("bid").alias("shape"), ring.alias("ring"))).select("shape", "tile", F.col("x").alias("cx"), F.col("y").alias("cz"))


@query("r13_discs", with_tables("poi", rest="SELECT DISTINCT tile, cx, cz FROM (SELECT tile, x + u AS cx, z + v AS cz FROM poi, (SELECT unnest(range(-3, 4)) AS u), (SELECT unnest(range(-3, 4)) AS v) WHERE u * u + v * v <= 9 AND key = 'bank') t"))
def r13b(spark, d):
    p = load(spark, d, "poi").where("key = 'bank'").select("tile", "x", F.col("z").alias("y"), F.lit(3).alias("radius"))
    return raster.discs(p).select("tile", F.col("x").alias("cx"), F.col("y").alias("cz"))


@query("r17_heights", with_tables("point", rest="""WITH g AS (SELECT tile, py AS y, px AS x, avg(h) FILTER (cls = 2) AS ground, max(h) FILTER (cls = 5) AS vegetation, max(h) FILTER (cls = 6) AS roof FROM point WHERE cls NOT IN (7, 18) GROUP BY ALL)
SELECT tile, y, x, CASE WHEN vegetation - ground > 0.3 AND vegetation - ground < 200 THEN least(vegetation - ground, 60.0) ELSE 0.0 END AS canopy, CASE WHEN roof - ground > 0.5 THEN roof - ground ELSE 0.0 END AS roof FROM g"""))
def r17(spark, d):
    return raster.heights_above_ground(raster.grid_points(load(spark, d, "point")))


@query("a18_ground_under", with_tables("building", "cell", rest="""WITH v AS (SELECT bid, tile % 4 AS tile, unnest([x % 40, x % 40 + w, x % 40 + w, x % 40]) AS x, unnest([z % 40, z % 40, z % 40 + d, z % 40 + d]) AS y FROM building)
SELECT bid, min(c.v) AS ground FROM v JOIN cell c USING (tile, y, x) GROUP BY bid"""))
def a18(spark, d):
    b = load(spark, d, "building").selectExpr("bid", "tile % 4 AS tile", "x % 40 AS x", "z % 40 AS y", "w", "d")
    corners = F.array(F.struct("x", "y"), F.struct((F.col("x") + F.col("w")).alias("x"), "y"), F.struct((F.col("x") + F.col("w")).alias("x"), (F.col("y") + F.col("d")).alias("y")), F.struct("x", (F.col("y") + F.col("d")).alias("y")))
    return raster.lowest_under(b.select("bid", "tile", corners.alias("ring")), load(spark, d, "cell"), "bid")


@query("a17_bright_half", with_tables("pixel", rest="""WITH p AS (SELECT CAST(floor(pixel / 40.0) AS BIGINT) AS zone, r, g, b, greatest(r, g, b) AS v FROM pixel), m AS (SELECT zone, quantile_cont(v, 0.5) AS m FROM p GROUP BY zone)
SELECT zone, round(quantile_cont(r, 0.5), 6) AS r, round(quantile_cont(g, 0.5), 6) AS g, round(quantile_cont(b, 0.5), 6) AS b FROM p JOIN m USING (zone) WHERE v >= m GROUP BY zone"""))
def a17(spark, d):
    p = load(spark, d, "pixel").withColumn("zone", F.floor(F.col("pixel") / 40.0))
    return raster.bright_half_colour(p, "zone").select("zone", *(F.round(c, 6).alias(c) for c in "rgb"))


@query("g32_circle", with_tables("company", rest="SELECT code, round(greatest(3.0, least(40.0, 3 + 2.2 * sqrt(coalesce(employees, 0)))), 6) AS radius FROM company"))
def g32(spark, d):
    return load(spark, d, "company").select("code", F.round(G.circle_radius(F.col("employees")), 6).alias("radius"))


@query("g9_sheets_over", with_tables("parcel", rest="SELECT pid, sx * 100 AS sx, sz * 100 AS sz FROM (SELECT *, unnest(range(CAST(floor(x / 100.0) AS BIGINT), CAST(floor((x + side * 20) / 100.0) AS BIGINT) + 1)) AS sx FROM parcel) a, (SELECT unnest(range(0, 20)) AS sz) b WHERE sz BETWEEN floor(z / 100.0) AND floor((z + side * 20) / 100.0)"))
def g9(spark, d):
    p, s = load(spark, d, "parcel"), F.col("side") * 20
    cells = spatial.cover(p, F.col("x"), F.col("z"), F.col("x") + s, F.col("z") + s, 100)
    return cells.select("pid", (F.col("cx") * 100).alias("sx"), (F.col("cz") * 100).alias("sz"))


@query("g10_recentred", with_tables("parcel", rest="SELECT pid, CAST(floor(x * 7 / 1000.0) AS BIGINT) * 1000 + 500 AS cx, CAST(floor(z * 7 / 1000.0) AS BIGINT) * 1000 + 500 AS cz FROM parcel"))
def g10(spark, d):
    p = load(spark, d, "parcel")
    return p.select("pid", G.sheet_centre(F.col("x") * 7).alias("cx"), G.sheet_centre(F.col("z") * 7).alias("cz"))


@query("g24_point_at", with_tables("stop_time", rest="""WITH p AS (SELECT trip AS id, seq, stop % 97 AS x, stop % 89 AS z FROM stop_time), s AS (SELECT *, lead(x) OVER w AS nx, lead(z) OVER w AS nz, coalesce(sum(sqrt(pow(x - px, 2) + pow(z - pz, 2))) OVER (PARTITION BY id ORDER BY seq), 0) AS cum FROM (SELECT *, lag(x) OVER w AS px, lag(z) OVER w AS pz FROM p WINDOW w AS (PARTITION BY id ORDER BY seq)) q WINDOW w AS (PARTITION BY id ORDER BY seq)),
l AS (SELECT *, sqrt(pow(nx - x, 2) + pow(nz - z, 2)) AS len FROM s WHERE nx IS NOT NULL)
SELECT id, round(x + (25 - cum) / len * (nx - x), 5) AS x, round(z + (25 - cum) / len * (nz - z), 5) AS z FROM l WHERE cum <= 25 AND 25 < cum + len"""))
def g24(spark, d):
    from plotline.operators import roads

    p = load(spark, d, "stop_time").selectExpr("trip AS id", "seq", "stop % 97 AS x", "stop % 89 AS z")
    return roads.point_at(p, 25.0).select("id", F.round("x", 5).alias("x"), F.round("z", 5).alias("z"))


@query("t13_house_label", with_tables("company", rest=r"SELECT code, regexp_extract(full_address, '(\d+[A-Za-z]?(?:[-/]\d+[A-Za-z]?)?)$', 1) AS label FROM company"))
def t13(spark, d):
    return load(spark, d, "company").select("code", T.house_label(F.col("full_address")).alias("label"))


@query("t34_asked_place", with_tables("parcel", rest=r"""WITH q AS (SELECT pid, CASE pid % 4 WHEN 0 THEN CAST(500000 + pid AS VARCHAR) || ' ' || CAST(6400000 + pid AS VARCHAR) WHEN 1 THEN '58.' || CAST(pid AS VARCHAR) || ', 26.5' WHEN 2 THEN '12 34' ELSE address END AS q FROM parcel),
n AS (SELECT pid, TRY_CAST(nullif(regexp_extract(q, '^\s*(-?\d+(?:\.\d+)?)\s*[ ,]\s*(-?\d+(?:\.\d+)?)\s*$', 1), '') AS DOUBLE) AS a, TRY_CAST(nullif(regexp_extract(q, '^\s*(-?\d+(?:\.\d+)?)\s*[ ,]\s*(-?\d+(?:\.\d+)?)\s*$', 2), '') AS DOUBLE) AS b FROM q)
SELECT pid, CASE WHEN a BETWEEN 300000 AND 800000 AND b BETWEEN 6300000 AND 6700000 THEN 'grid' WHEN a BETWEEN 57 AND 60 AND b BETWEEN 21 AND 29 THEN 'degrees' ELSE 'text' END AS kind, CASE WHEN a BETWEEN 300000 AND 800000 AND b BETWEEN 6300000 AND 6700000 OR a BETWEEN 57 AND 60 AND b BETWEEN 21 AND 29 THEN a END AS a FROM n"""))
def t34(spark, d):
    q = load(spark, d, "parcel").selectExpr("pid", "CASE pid % 4 WHEN 0 THEN CAST(500000 + pid AS STRING) || ' ' || CAST(6400000 + pid AS STRING) WHEN 1 THEN '58.' || CAST(pid AS STRING) || ', 26.5' WHEN 2 THEN '12 34' ELSE address END AS q")
    return q.select("pid", T.asked_place(F.col("q")).alias("p")).select("pid", "p.kind", "p.a")


@query("t8_house_forms", with_tables("company", rest="""SELECT code, CASE code % 4 WHEN 0 THEN CAST(n AS VARCHAR) WHEN 1 THEN CAST(n AS VARCHAR) || 'a,' || CAST(n AS VARCHAR) WHEN 2 THEN CAST(n AS VARCHAR) || ',' || CAST(n + 3 AS VARCHAR) || ',' || CAST(n + 1 AS VARCHAR) || ',' || CAST(n + 2 AS VARCHAR) ELSE CAST(n AS VARCHAR) || ',' || CAST(n + 20 AS VARCHAR) END AS forms
FROM (SELECT code, 1 + code % 60 AS n FROM company) x"""))
def t8(spark, d):
    c = load(spark, d, "company").selectExpr("code", "CASE code % 4 WHEN 0 THEN CAST(1 + code % 60 AS STRING) WHEN 1 THEN CAST(1 + code % 60 AS STRING) || ' A' WHEN 2 THEN CAST(1 + code % 60 AS STRING) || '-' || CAST(4 + code % 60 AS STRING) ELSE CAST(1 + code % 60 AS STRING) || ' – ' || CAST(21 + code % 60 AS STRING) END AS num")
    return c.select("code", F.array_join(T.house_forms(F.col("num")), ",").alias("forms"))


@query("a29_building_stats", with_tables("building", rest="SELECT kind, count(*) AS n, count(year) AS dated, quantile_cont(floors, 0.5) AS floors FROM building GROUP BY kind"))
def a29(spark, d):
    return load(spark, d, "building").groupBy("kind").agg(F.count("*").alias("n"), F.count("year").alias("dated"), F.percentile("floors", F.lit(0.5)).alias("floors"))


@query("o8_match_order", with_tables("company", rest="SELECT code, row_number() OVER (ORDER BY CASE match WHEN 'exact' THEN 0 WHEN 'street' THEN 1 ELSE 2 END, name, code) AS place FROM company"))
def o8(spark, d):
    from plotline.operators.lists import global_rank

    rank = F.when(F.col("match") == "exact", 0).when(F.col("match") == "street", 1).otherwise(2)
    return global_rank(load(spark, d, "company").select("code", "name", rank.alias("k")), ["k", "name", "code"], "place", 1).select("code", "place")


#: Latvian and Finnish rows: addresses in the registers' manner, from the driver's tables.
_LV = """CASE {k} % 4 WHEN 0 THEN 'Kaļķu iela ' WHEN 1 THEN 'Tirgoņu iela ' WHEN 2 THEN 'Republikas laukums ' ELSE 'Pils iela ' END || CAST(1 + {k} % 30 AS {s}) || CASE {k} % 5 WHEN 1 THEN 'A' WHEN 2 THEN '/13;15' WHEN 3 THEN ' - 8' ELSE '' END"""
_LV_C = "CASE c_custkey % 7 WHEN 0 THEN 'Cēsis, ' WHEN 1 THEN 'Ādažu nov., Rīga, ' ELSE 'Rīga, ' END || " + _LV.format(k="(c_custkey * 7)", s="{s}")
_LV_P = "SELECT p_partkey AS pid, CASE WHEN p_partkey % 6 = 0 THEN 'V' || CAST(p_partkey % 80 AS {s}) END AS ads_oid, " + _LV.format(k="p_partkey", s="{s}") + " AS address, CASE WHEN p_partkey % 9 > 0 THEN 'Rīga' END AS settlement FROM part"
_LV_B = "SELECT s_suppkey AS bid, CASE WHEN s_suppkey % 3 = 0 THEN 'V' || CAST(s_suppkey % 90 AS {s}) END AS var_code, " + _LV.format(k="(s_suppkey * 3)", s="{s}") + " AS address, CASE s_suppkey % 3 WHEN 1 THEN 'outbuilding' ELSE 'dwelling' END AS kind, 6 + s_suppkey % 7 AS w, 5 + s_suppkey % 5 AS d, CASE WHEN s_suppkey % 4 > 0 THEN (s_suppkey * 17) % 190 + 1 END AS pid FROM supplier"
_LV_Q = "SELECT c_custkey AS code, CASE WHEN c_custkey % 8 = 0 THEN 'V' || CAST(c_custkey % 100 AS {s}) END AS addressid, " + _LV_C + " AS address FROM customer"
#: The keys of an address, alternates numbered; written for the forms that the rows above have.
_LV_KEYS = r"""SELECT {id}, i AS ord, street, lower(CASE i WHEN 0 THEN regexp_extract(rest, '^([0-9]+[A-Za-z]?(/[0-9]+)?)', 1) ELSE '15' END) AS num FROM (SELECT {id}, lower(regexp_extract({a}, '^(.*?) [0-9]', 1)) AS street, regexp_extract({a}, ' ([0-9].*)$', 1) AS rest, unnest(range(CASE WHEN contains({a}, ';') THEN 2 ELSE 1 END)) AS i FROM {t}) k"""


def _lv(spark, d, sql):
    return spark.sql(sql.format(s="STRING").replace("FROM part", "FROM {part}").replace("FROM supplier", "FROM {supplier}").replace("FROM customer", "FROM {customer}"), **{n: load(spark, d, n) for n in ("part", "supplier", "customer") if f"FROM {n}" in sql})


_LV_ALL = f"""WITH p AS ({_LV_P.format(s='VARCHAR')}), b AS ({_LV_B.format(s='VARCHAR')}), c AS ({_LV_Q.format(s='VARCHAR')}),
t AS (SELECT code, addressid, CASE code % 7 WHEN 0 THEN 'cēsis' ELSE 'rīga' END AS town, regexp_extract(address, '([^,]*)$', 1) AS part FROM c),
kp AS ({_LV_KEYS.format(id='pid', a='address', t='p')}), kb AS ({_LV_KEYS.format(id='bid', a='address', t='b')}), kc AS ({_LV_KEYS.format(id='code', a='trim(part)', t='t')})"""


@query("t6_lv_keys", _LV_ALL + " SELECT pid, CAST(ord AS INT) AS ord, street, num FROM kp")
def t6(spark, d):
    return _lv(spark, d, _LV_P).select("pid", F.posexplode(T.lv_address_keys(F.col("address"))).alias("ord", "k")).select("pid", "ord", "k.street", "k.num")


@query("t7_lv_town", _LV_ALL + " SELECT code, town, trim(part) AS part FROM t")
def t7(spark, d):
    return _lv(spark, d, _LV_Q).select("code", T.lv_town_and_street(F.col("address")).alias("p")).select("code", "p.town", "p.part")


@query("j2_match_lv", _LV_ALL + """, vb AS (SELECT var_code, max(bid) AS bid FROM b WHERE var_code IS NOT NULL GROUP BY 1), vp AS (SELECT ads_oid, max(pid) AS pid FROM p WHERE ads_oid IS NOT NULL GROUP BY 1),
best AS (SELECT street, num, bid FROM (SELECT kb.street, kb.num, b.bid, row_number() OVER (PARTITION BY kb.street, kb.num ORDER BY b.kind = 'outbuilding', w * d DESC, b.bid) AS r FROM kb JOIN b USING (bid)) x WHERE r = 1), fst AS (SELECT street, num, min(pid) AS pid FROM kp GROUP BY ALL), st AS (SELECT street FROM kb UNION SELECT street FROM kp),
h AS (SELECT code, bid, pid FROM (SELECT kc.code, best.bid, fst.pid, row_number() OVER (PARTITION BY kc.code ORDER BY ord) AS r FROM kc LEFT JOIN best USING (street, num) LEFT JOIN fst USING (street, num) WHERE best.bid IS NOT NULL OR fst.pid IS NOT NULL) x WHERE r = 1), kn AS (SELECT DISTINCT code FROM kc WHERE street IN (SELECT street FROM st)),
m AS (SELECT t.code, vb.bid AS b1, vp.pid AS p1, town = 'rīga' AS here, h.bid AS b2, h.pid AS p2, kn.code IS NOT NULL AS known FROM t LEFT JOIN vb ON var_code = addressid LEFT JOIN vp ON ads_oid = addressid LEFT JOIN h ON h.code = t.code LEFT JOIN kn ON kn.code = t.code),
v AS (SELECT *, CASE WHEN b1 IS NOT NULL OR p1 IS NOT NULL THEN 'var' WHEN here AND (b2 IS NOT NULL OR p2 IS NOT NULL) THEN 'address' END AS via FROM m)
SELECT v.code, CASE WHEN via IS NOT NULL THEN 'exact' WHEN here AND known THEN 'street' ELSE 'none' END AS match, via, CASE via WHEN 'var' THEN CASE WHEN b1 IS NOT NULL THEN x.pid ELSE p1 END WHEN 'address' THEN CASE WHEN b2 IS NOT NULL THEN x.pid ELSE p2 END END AS pid, CASE via WHEN 'var' THEN b1 WHEN 'address' THEN b2 END AS bid
FROM v LEFT JOIN b x ON x.bid = CASE via WHEN 'var' THEN b1 WHEN 'address' THEN b2 END""")
def j2(spark, d):
    from plotline.operators import match

    return match.match_lv(_lv(spark, d, _LV_Q), _lv(spark, d, _LV_P), _lv(spark, d, _LV_B))


_FI = "CASE {k} % 4 WHEN 0 THEN 'Aleksanterinkatu ' WHEN 1 THEN 'Mariankatu ' WHEN 2 THEN 'Pohjoinen Makasiinikatu ' ELSE 'Unioninkatu ' END"
_FI_P = "SELECT p_partkey AS pid, " + _FI.format(k="p_partkey") + " || CAST(1 + p_partkey % 25 AS {s}) AS address, CAST(91 + p_partkey % 2 AS {s}) AS municipality FROM part"
_FI_B = "SELECT s_suppkey AS bid, " + _FI.format(k="(s_suppkey * 3)") + " || CAST(1 + s_suppkey % 40 AS {s}) || CASE WHEN s_suppkey % 3 = 0 THEN ' A' ELSE '' END AS address, CASE s_suppkey % 3 WHEN 1 THEN 'outbuilding' ELSE 'dwelling' END AS kind, 6 + s_suppkey % 7 AS w, 5 + s_suppkey % 5 AS d, CASE WHEN s_suppkey % 4 > 0 THEN (s_suppkey * 17) % 190 + 1 END AS pid FROM supplier"
_FI_A = "SELECT c_custkey AS code, CASE WHEN ord = 0 THEN 2 ELSE 1 END AS type, ord, trim(" + _FI.format(k="(c_custkey * 5 + ord)") + ") AS street, CAST(1 + (c_custkey + ord * 3) % 60 AS {s}) || CASE c_custkey % 3 WHEN 1 THEN 'a' ELSE '' END AS number, CASE c_custkey % 5 WHEN 0 THEN '49' WHEN 1 THEN NULL ELSE '91' END AS municipality FROM (SELECT c_custkey, 0 AS ord FROM customer UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_custkey % 2 = 0) x"


@query("j3_match_fi", f"""WITH p AS ({_FI_P.format(s='VARCHAR')}), b AS ({_FI_B.format(s='VARCHAR')}), a AS ({_FI_A.format(s='VARCHAR')}),
kp AS (SELECT pid, lower(regexp_extract(address, '^(.*) [0-9]', 1)) AS street, regexp_extract(address, '([0-9]+)$', 1) AS num FROM p),
kb AS (SELECT bid, lower(regexp_extract(address, '^(.*?) [0-9]', 1)) AS street, unnest(CASE WHEN address LIKE '% A' THEN [regexp_extract(address, ' ([0-9]+)', 1) || 'a', regexp_extract(address, ' ([0-9]+)', 1)] ELSE [regexp_extract(address, ' ([0-9]+)', 1)] END) AS num FROM b),
best AS (SELECT street, num, bid, pid FROM (SELECT kb.street, kb.num, b.bid, b.pid, row_number() OVER (PARTITION BY kb.street, kb.num ORDER BY b.kind = 'outbuilding', w * d DESC, b.bid) AS r FROM kb JOIN b USING (bid)) x WHERE r = 1), fst AS (SELECT street, num, min(pid) AS pid FROM kp GROUP BY ALL), st AS (SELECT street FROM kb UNION SELECT street FROM kp),
ok AS (SELECT code, type, ord, lower(street) AS street, number FROM a WHERE municipality IS NULL OR municipality IN (SELECT municipality FROM p)),
f AS (SELECT code, type, ord, street, unnest(range(CASE WHEN number LIKE '%a' THEN 2 ELSE 1 END)) AS i, number FROM ok), kc AS (SELECT code, type, ord, street, i, CASE WHEN i = 1 THEN replace(number, 'a', '') ELSE number END AS num FROM f),
h AS (SELECT code, bid, pid FROM (SELECT kc.code, best.bid, CASE WHEN best.bid IS NOT NULL THEN best.pid ELSE fst.pid END AS pid, row_number() OVER (PARTITION BY kc.code ORDER BY type <> 1, ord, i) AS r FROM kc LEFT JOIN best USING (street, num) LEFT JOIN fst USING (street, num) WHERE best.bid IS NOT NULL OR fst.pid IS NOT NULL) x WHERE r = 1)
SELECT c.code, CASE WHEN h.code IS NOT NULL THEN 'exact' WHEN c.code IN (SELECT code FROM ok WHERE street IN (SELECT street FROM st)) THEN 'street' ELSE 'none' END AS match, h.pid, h.bid FROM (SELECT DISTINCT code FROM a) c LEFT JOIN h ON h.code = c.code""")
def j3(spark, d):
    from plotline.operators import match

    return match.match_fi(_lv(spark, d, _FI_A), _lv(spark, d, _FI_P), _lv(spark, d, _FI_B))


@query("t16_sign_name", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'SIA \"' || c_name || '\"' WHEN 1 THEN 'AS \"' || c_name || '\" Rīga' WHEN 2 THEN 'Biedrība \"' || c_name || '\"' ELSE c_name END AS sign FROM customer")
def t16(spark, d):
    k, c = F.col("c_custkey") % 4, load(spark, d, "customer")
    before = F.when(k == 0, "Sabiedrība ar ierobežotu atbildību").when(k == 1, "akciju sabiedrība").when(k == 2, "Biedrība")
    after, quoted = F.when(k == 1, "Rīga"), F.when(k < 3, F.col("c_name"))
    name = F.when(k < 3, F.concat(before, F.lit(' "'), "c_name", F.lit('"'), F.coalesce(F.concat(F.lit(" "), after), F.lit("")))).otherwise(F.col("c_name"))
    return c.select("c_custkey", T.sign_name(name, before, quoted, after).alias("sign"))


@query("tm5_service_day", "SELECT o_orderkey, CASE isodow(o_orderdate) WHEN 6 THEN 'saturday' WHEN 7 THEN 'sunday' ELSE 'weekday' END AS day FROM orders")
def tm5(spark, d):
    return load(spark, d, "orders").select("o_orderkey", T.day_of(F.to_date("o_orderdate")).alias("day"))


@query("t18_money", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS n FROM orders")
def t18(spark, d):
    whole = F.floor("o_totalprice").cast("string")
    text = F.when(F.col("o_orderkey") % 4 == 0, " ").when(F.col("o_orderkey") % 4 == 1, F.concat(F.expr("left(floor(o_totalprice), length(floor(o_totalprice)) - 2)"), F.lit(" "), F.expr("right(floor(o_totalprice), 2)"), F.lit(",9"))).otherwise(whole)
    return load(spark, d, "orders").select("o_orderkey", T.whole_money(text).alias("n"))


@query("t19_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders")
def t19(spark, d):
    text = F.when(F.col("o_orderkey") % 5 > 0, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "yyyy"))
    return load(spark, d, "orders").select("o_orderkey", T.iso_date(text).cast("string").alias("day"))


@query("t20_parcel_label", "SELECT p_partkey, CASE WHEN p_partkey % 6 > 0 THEN '91-' || CAST(p_partkey % 900 AS VARCHAR) || '-' || CAST(p_size AS VARCHAR) || '-' || CAST(p_partkey % 7000 AS VARCHAR) END AS label FROM part")
def t20(spark, d):
    p = load(spark, d, "part")
    code = F.concat(F.lit("091"), F.lpad((F.col("p_partkey") % 900).cast("string"), 3, "0"), F.lpad(F.col("p_size").cast("string"), 4, "0"), F.lpad((F.col("p_partkey") % 7000).cast("string"), 4, "0"))
    return p.select("p_partkey", T.parcel_label(F.when(F.col("p_partkey") % 6 > 0, code).otherwise("91-1")).alias("label"))


@query("j36_adjacent_tiles", """WITH t AS (SELECT r * 5 + c AS tile, c * 1000 AS xmin, r * 1000 AS ymin, c * 1000 + 1000 AS xmax, r * 1000 + 1000 AS ymax FROM (SELECT DISTINCT n_nationkey % 5 AS c, CAST(floor(n_nationkey / 5) AS BIGINT) AS r FROM nation) x)
SELECT a.tile, b.tile AS other, CASE WHEN a.xmin = b.xmax AND a.ymin = b.ymin THEN 'w' WHEN a.xmax = b.xmin AND a.ymin = b.ymin THEN 'e' WHEN a.ymin = b.ymax AND a.xmin = b.xmin THEN 's' ELSE 'n' END AS side FROM t a JOIN t b ON (a.xmin = b.xmax OR a.xmax = b.xmin) AND a.ymin = b.ymin OR (a.ymin = b.ymax OR a.ymax = b.ymin) AND a.xmin = b.xmin""")
def j36(spark, d):
    c, r = F.col("n_nationkey") % 5, F.floor(F.col("n_nationkey") / 5)
    t = load(spark, d, "nation").select(c.alias("c"), r.alias("r")).distinct()
    jitter = F.when(F.col("c") % 2 == 0, 0.3).otherwise(0.0)  # edges need only be within a metre
    t = t.select((F.col("r") * 5 + F.col("c")).cast("long").alias("tile"), (F.col("c") * 1000 + jitter).alias("xmin"), (F.col("r") * 1000).alias("ymin"), (F.col("c") * 1000 + 1000 + jitter).alias("xmax"), (F.col("r") * 1000 + 1000).alias("ymax"))
    return spatial.adjacent_tiles(t)


@query("g25_nearest_arclength", with_tables("road", "poi", rest="""WITH s AS (SELECT poi AS id, q.tile, rid, ax, az, bx - ax AS ux, bz - az AS uz, q.x % 256 AS px, q.z % 256 AS pz FROM poi q JOIN road r ON q.tile = r.tile),
u AS (SELECT *, greatest(0.0, least(1.0, ((px - ax) * ux + (pz - az) * uz) / CAST(ux * ux + uz * uz AS DOUBLE))) AS u FROM s), e AS (SELECT *, sqrt(pow(px - ax - u * ux, 2) + pow(pz - az - u * uz, 2)) AS d, 10 + u * sqrt(ux * ux + uz * uz) AS s FROM u)
SELECT tile, id, rid AS line, round(s, 5) AS s, round(d, 5) AS d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d, 9), rid, s) AS k FROM e WHERE d <= 25) x WHERE k = 1"""))
def g25(spark, d):
    points = load(spark, d, "poi").selectExpr("tile", "poi AS id", "x % 256 AS x", "z % 256 AS z")
    lines = load(spark, d, "road").selectExpr("tile", "rid AS line", "CAST(10 AS DOUBLE) AS cum", "ax", "az", "bx", "bz")
    return spatial.nearest_arclength(points, lines, 25.0).select("tile", "id", "line", F.round("s", 5).alias("s"), F.round("d", 5).alias("d"))


@query("w13_thinned_stops")
def w13(spark, d):
    return spatial.thinned_stops(_stops(spark, d), 15.0).select("id")


def _stops(spark, d):
    return load(spark, d, "poi").selectExpr("tile", "poi AS id", "key AS kind", "CASE WHEN poi % 7 > 0 THEN key || CAST(poi % 2 AS STRING) END AS name", "x % 200 AS x", "z % 200 AS z")


_WAY = """SELECT o_orderkey AS way, CASE o_orderkey % 9 WHEN 0 THEN 'primary' WHEN 1 THEN 'residential' WHEN 2 THEN 'footway' WHEN 3 THEN 'track' WHEN 4 THEN 'trunk_link' WHEN 5 THEN 'odd_link' WHEN 6 THEN 'busway' WHEN 7 THEN 'service' ELSE 'steps' END AS highway,
 CASE o_custkey % 4 WHEN 0 THEN 'gravel' WHEN 1 THEN 'asphalt' END AS surface, CASE o_orderkey % 7 WHEN 0 THEN '3,5 m' WHEN 1 THEN '70' WHEN 2 THEN 'wide' END AS width, CASE o_orderkey % 5 WHEN 0 THEN '2' WHEN 1 THEN '3;2' WHEN 2 THEN '20' END AS lanes FROM {t}"""
_WIDTH = "CASE w " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in T.WIDTHS) + " ELSE CASE WHEN highway LIKE '%\\_link' ESCAPE '\\' THEN 6.0 ELSE 4.0 END END"


@query("t25_roads", f"""WITH x AS ({_WAY.format(t='orders')}), y AS (SELECT *, replace(highway, '_link', '') AS w FROM x)
SELECT way, CASE WHEN highway IN ('footway', 'steps') THEN 'path' WHEN highway = 'track' THEN 'trail' WHEN surface = 'gravel' THEN 'road' ELSE 'street' END AS kind, CASE WHEN width = '3,5 m' THEN 3.5 WHEN lanes = '2' THEN 6.4 WHEN lanes = '3;2' THEN 9.6 ELSE {_WIDTH} END AS width FROM y""")
def t25(spark, d):
    w = spark.sql(_WAY.format(t="{orders}"), orders=load(spark, d, "orders"))
    c = F.col
    return w.select("way", T.road_kind(c("highway"), c("surface")).alias("kind"), F.round(T.road_width(c("highway"), c("width"), c("lanes")), 6).alias("width"))


_USE = "SELECT bid, CASE bid % 5 WHEN 0 THEN 'Elu- ja ühiskondlik' WHEN 1 THEN 'Kõrvalhoone' WHEN 2 THEN 'Muu' END AS words, CASE bid % 7 WHEN 0 THEN '11101' WHEN 1 THEN '12744' WHEN 2 THEN '12711' WHEN 3 THEN '12201' END AS code FROM {t}"


@query("t24_building_class", with_tables("building", rest=f"SELECT bid, CASE WHEN code = '11101' OR words LIKE 'Elu-%' THEN CASE WHEN code = '12744' THEN 'outbuilding' ELSE 'dwelling' END WHEN words LIKE 'Kõrval%' OR code IN ('12711', '12744') THEN 'outbuilding' WHEN code IS NOT NULL THEN 'other' ELSE 'outbuilding' END AS cls FROM ({_USE.format(t='building')}) x"))
def t24(spark, d):
    b = spark.sql(_USE.format(t="{building}"), building=load(spark, d, "building"))
    return b.select("bid", T.building_class(F.col("words"), F.col("code")).alias("cls"))


@query("t33_blended", with_tables("pixel", rest="SELECT pixel, round(0.75 * r + 0.25 * 0.6012, 3) AS r, round(0.75 * g + 0.25 * 0.3012, 3) AS g, round(0.75 * b + 0.25 * 0.2012, 3) AS b FROM pixel"))
def t33(spark, d):
    c = T.blended(F.array("r", "g", "b"), F.array(F.lit(0.6012), F.lit(0.3012), F.lit(0.2012)))
    return load(spark, d, "pixel").select("pixel", c.alias("c")).select("pixel", F.col("c")[0].alias("r"), F.col("c")[1].alias("g"), F.col("c")[2].alias("b"))


@query("g27_photo_square", with_tables("parcel", rest="SELECT pid, x + side * 5 / 2.0 - s / 2.0 AS x, z + side * 5 / 2.0 - s / 2.0 AS z, s AS span FROM (SELECT *, greatest(side * 5 + 16, 60) * 1.0 AS s FROM parcel) p"))
def g27(spark, d):
    q = G.photo_square(G.square(F.col("x"), F.col("z"), F.col("side") * 5))
    return load(spark, d, "parcel").select("pid", q.alias("q")).select("pid", "q.x", "q.z", "q.span")


@query("g31_pond_depth", with_tables("parcel", rest="""WITH p AS (SELECT pid, least(side * 2 / 2.0 - abs(x % 30 - 10), side * 3 / 2.0 - abs(z % 30 - 10)) AS edge, greatest(0.7, least(2.5, sqrt(side * side * 6) / 18.0)) AS most FROM parcel), q AS (SELECT *, greatest(0.0, least(1.0, edge / 3.0)) AS t FROM p)
SELECT pid, round(CASE WHEN edge <= 0 THEN 0.0 ELSE most * t * t * (3.0 - 2.0 * t) END, 6) AS depth FROM q"""))
def g31(spark, d):
    c = F.col
    depth = G.pond_depth(c("x") % 30 - 10, c("z") % 30 - 10, c("side") * 2, c("side") * 3, c("side") * c("side") * 6, 2.5)
    return load(spark, d, "parcel").select("pid", F.round(depth, 6).alias("depth"))


@query("gr5_arm_groups", with_tables("road", rest="""WITH e AS (SELECT tile, ax AS x, az AS z, rid, bx - ax AS dx, bz - az AS dz FROM road UNION ALL SELECT tile, bx, bz, rid, ax - bx, az - bz FROM road), f AS (SELECT *, first_value(dx) OVER w AS ux, first_value(dz) OVER w AS uz FROM e WINDOW w AS (PARTITION BY tile, x, z ORDER BY rid))
SELECT tile, x, z, count(*) FILTER (g) AS along, count(*) FILTER (NOT g) AS across FROM (SELECT *, abs((dx * ux + dz * uz) / sqrt(CAST((dx * dx + dz * dz) * (ux * ux + uz * uz) AS DOUBLE))) >= 0.7071 AS g FROM f) y GROUP BY ALL"""))
def gr5(spark, d):
    r, c = load(spark, d, "road"), F.col
    a = r.select("tile", c("ax").alias("x"), c("az").alias("z"), "rid", (c("bx") - c("ax")).alias("dx"), (c("bz") - c("az")).alias("dz"))
    e = a.unionByName(r.select("tile", c("bx").alias("x"), c("bz").alias("z"), "rid", (c("ax") - c("bx")).alias("dx"), (c("az") - c("bz")).alias("dz")))
    axis = e.groupBy("tile", "x", "z").agg(F.min_by(F.struct("dx", "dz"), "rid").alias("u"))
    e = e.join(axis, ["tile", "x", "z"]).withColumn("g", G.arm_group(c("dx"), c("dz"), c("u.dx"), c("u.dz")))
    return e.groupBy("tile", "x", "z").agg(F.count_if(c("g") == 0).alias("along"), F.count_if(c("g") == 1).alias("across"))


@query("j9_home_of_points", with_tables("building", "poi", rest="""WITH p AS (SELECT q.tile, poi AS point, bid AS polygon, q.x >= b.x AND q.x < b.x + w * 3 AND q.z >= b.z AND q.z < b.z + d * 3 AS ins, sqrt(pow(greatest(b.x - q.x, 0, q.x - b.x - w * 3), 2) + pow(greatest(b.z - q.z, 0, q.z - b.z - d * 3), 2)) AS far FROM poi q JOIN building b USING (tile)),
k AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY NOT ins, CASE WHEN ins THEN 0 ELSE round(far, 9) END, polygon) AS r FROM p WHERE ins OR far < 8)
SELECT tile, point, polygon, round(CASE WHEN ins THEN 0.0 ELSE far END, 6) AS d FROM k WHERE r = 1"""))
def j9(spark, d):
    c = F.col
    at = lambda a, b: F.struct((c("x") + a).cast("double").alias("x"), (c("z") + b).cast("double").alias("z"))
    w, h, o = c("w") * 3, c("d") * 3, F.lit(0)
    b = load(spark, d, "building").select("tile", c("bid").alias("polygon"), F.array(at(o, o), at(w, o), at(w, h), at(o, h)).alias("ring"))
    return spatial.home_of_points(load(spark, d, "poi").select("tile", c("poi").alias("point"), "x", "z"), b, 8.0).withColumn("d", F.round("d", 6))


@query("tm3_day_text", with_tables("poi", rest="SELECT poi, day, CASE opening_hours WHEN '24/7' THEN '00:00-24:00' WHEN 'Mo-Fr 08:00-12:00,13:00-17:00' THEN '08:00-12:00, 13:00-17:00' WHEN 'Fr,Sa 11:00-02:00' THEN '11:00-26:00' WHEN 'Sa-Mo 09:00-15:30' THEN '09:00-15:30' ELSE '10:00-20:00' END AS text FROM (SELECT poi, opening_hours, unnest(CASE opening_hours WHEN '24/7' THEN [0,1,2,3,4,5,6] WHEN 'Mo-Fr 08:00-12:00,13:00-17:00' THEN [0,1,2,3,4] WHEN 'Fr,Sa 11:00-02:00' THEN [4,5] WHEN 'Sa-Mo 09:00-15:30' THEN [0,5,6] ELSE [0,1,2,3,4,5] END) AS day FROM poi WHERE opening_hours NOT IN ('PH off', 'sunrise-sunset')) x"))
def tm3(spark, d):
    return transit.day_text(transit.opening_hours(load(spark, d, "poi")))


@query("a25_credits", with_tables("trip", rest="SELECT DISTINCT line FROM (SELECT unnest(['feed ' || line, 'service ' || CAST(service AS VARCHAR)]) AS line FROM trip) x"))
def a25(spark, d):
    from plotline.operators import lists

    t = load(spark, d, "trip").select(F.concat(F.lit("feed "), "line", F.lit("; service "), F.col("service").cast("string"), F.lit(" ;")).alias("credit"))
    return lists.credit_lines(t, "credit")


@query("a22_addresses", with_tables("company", rest="SELECT tunnus, array_to_string(list(name ORDER BY coalesce(employees, 99), name), '; ') AS addresses FROM company GROUP BY tunnus"))
def a22(spark, d):
    from plotline.operators import lists

    return lists.addresses_of(load(spark, d, "company"), "tunnus", "employees", "name")


@query("a28_bounds", with_tables("parcel", rest="SELECT settlement, min(x) AS xmin, min(z) AS zmin, max(x) AS xmax, max(z) AS zmax FROM parcel GROUP BY settlement"))
def a28(spark, d):
    from plotline.operators import lists

    return lists.bounds(load(spark, d, "parcel"), "settlement", "x", "z")


@query("a26_place_page", with_tables("parcel", "company", rest="SELECT p.tile, p.parcels, c.exact, p.locality FROM (SELECT tile, count(*) AS parcels, arg_min(county, pid) FILTER (county IS NOT NULL) AS locality FROM parcel GROUP BY tile) p LEFT JOIN (SELECT q.tile, count(*) AS exact FROM company k JOIN parcel q ON q.tunnus = k.tunnus WHERE match = 'exact' GROUP BY q.tile) c ON c.tile = p.tile"))
def a26(spark, d):
    p = load(spark, d, "parcel")
    page = p.groupBy("tile").agg(F.count("*").alias("parcels"), F.min_by("county", F.when(F.col("county").isNotNull(), F.col("pid"))).alias("locality"))
    exact = load(spark, d, "company").where("match = 'exact'").select("tunnus").join(p.select("tunnus", "tile"), "tunnus").groupBy("tile").agg(F.count("*").alias("exact"))
    return page.join(exact, "tile", "left").select("tile", "parcels", "exact", "locality")


@query("w8_node_uses", with_tables("stop_time", rest="""WITH n AS (SELECT trip, seq, stop % 40 AS node, max(seq) OVER (PARTITION BY trip) AS m FROM stop_time), e AS (SELECT DISTINCT trip, node FROM n WHERE seq = 1 OR seq = m), a AS (SELECT DISTINCT n.trip, n.node FROM n JOIN e ON e.trip = n.trip AND e.node = n.node WHERE seq > 1 AND seq < m)
SELECT node, count(*) AS uses FROM (SELECT node FROM n UNION ALL SELECT node FROM a) x GROUP BY node"""))
def w8(spark, d):
    from plotline.operators import roads

    w = load(spark, d, "stop_time").groupBy("trip").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", (F.col("stop") % 40).alias("node")))), lambda x: x.node).alias("nodes"))
    return roads.node_uses(w)


@query("r16_seam", with_tables("cell", rest="""WITH n AS (SELECT tile + 1 AS tile, y, v FROM cell WHERE x = 47), s AS (SELECT n.tile, n.y, n.v - c.v AS step FROM n JOIN cell c ON c.tile = n.tile AND c.y = n.y AND c.x = 0)
SELECT c.tile, c.y, c.x, round(c.v + coalesce(step, 0) * t * t * (3 - 2 * t), 9) AS v FROM (SELECT *, greatest(0.0, 1.0 - x / 40.0) AS t FROM cell) c LEFT JOIN s ON s.tile = c.tile AND s.y = c.y"""))
def r16(spark, d):
    c = load(spark, d, "cell")
    west = c.where("x = 47").select((F.col("tile") + 1).alias("tile"), "y", "v")
    return raster.blend_west_edge(c, west).withColumn("v", F.round("v", 9))


@query("q5_address_prefix", with_tables("parcel", rest="""WITH a AS (SELECT address AS f, replace(address, 'Aeru', 'Årgatan') AS s, municipality AS m FROM parcel), q AS (SELECT * FROM (VALUES ('aeru', NULL), ('argat', 'vald1'), ('kesk maantee 2', NULL)) AS t(q, town)),
z AS (SELECT q, town, f, s, m, trim(replace(replace(translate(lower(' ' || f || ' '), 'õäöüå', 'oaoua'), ' tanav ', ' tn '), ' maantee ', ' mnt ')) AS ff, trim(replace(replace(translate(lower(' ' || s || ' '), 'õäöüå', 'oaoua'), ' tanav ', ' tn '), ' maantee ', ' mnt ')) AS fs, trim(replace(' ' || q || ' ', ' maantee ', ' mnt ')) AS fq FROM a, q),
n AS (SELECT DISTINCT q, CASE WHEN NOT starts_with(ff, fq) THEN s ELSE f END || ', ' || upper(m[1]) || m[2:] AS name FROM z WHERE (starts_with(ff, fq) OR starts_with(fs, fq)) AND (town IS NULL OR starts_with(m, town)))
SELECT q, place, name FROM (SELECT q, name, CAST(row_number() OVER (PARTITION BY q ORDER BY name) AS INT) AS place FROM n) x WHERE place <= 8"""))
def q5(spark, d):
    from plotline.operators import search

    rows = load(spark, d, "parcel").select(F.col("address").alias("first"), F.replace(F.col("address"), F.lit("Aeru"), F.lit("Årgatan")).alias("second"), F.col("municipality").alias("town"))
    asked = spark.createDataFrame([("aeru", None), ("argat", "vald1"), ("kesk maantee 2", None)], "q string, town string")
    return search.addresses_starting(rows, asked, 8)


@query("j10_entrances", with_tables("building", "poi", rest="""WITH e AS (SELECT tile, bid AS id, x, z, kind = 'dwelling' AS main FROM building UNION ALL SELECT tile, bid + 1000000, x, z, kind <> 'dwelling' FROM building)
SELECT tile, "left", "right", d2 FROM (SELECT q.tile, q.poi AS "left", e.id AS "right", (q.x - e.x) * (q.x - e.x) + (q.z - e.z) * (q.z - e.z) AS d2, row_number() OVER (PARTITION BY q.poi ORDER BY (q.x - e.x) * (q.x - e.x) + (q.z - e.z) * (q.z - e.z), NOT main, e.id) AS r FROM poi q JOIN e ON e.tile = q.tile AND (q.x - e.x) * (q.x - e.x) + (q.z - e.z) * (q.z - e.z) <= 3600) y WHERE r = 1"""))
def j10(spark, d):
    b, c = load(spark, d, "building"), F.col
    doors = b.select("tile", c("bid").alias("id"), "x", "z", (c("kind") == "dwelling").alias("main"))
    doors = doors.unionByName(b.select("tile", (c("bid") + 1000000).alias("id"), "x", "z", (c("kind") != "dwelling").alias("main")))
    return spatial.entrance_of_points(load(spark, d, "poi").select("tile", c("poi").alias("id"), "x", "z"), doors, 60.0)


@query("w16_spikes_with_context", "WITH x AS (SELECT user_id, event_id, coalesce(value >= 90, false) AS spike, lead(value >= 90) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT user_id, event_id, spike FROM x WHERE spike OR coalesce(n, false)")
def w16(spark, d):
    from plotline.operators import lists

    return lists.with_context(load(spark, d, "events"), "user_id", "event_id", F.col("value") >= 90).select("user_id", "event_id", "spike")


@query("st8_stale_packs", with_tables("building", rest="SELECT bid FROM building WHERE year IS NULL OR year < 1980"))
def st8(spark, d):
    from plotline.operators import lists

    return lists.stale(load(spark, d, "building"), F.col("year"), 1980).select("bid")


_SIDES = "o AS (SELECT pid, area FROM parcel WHERE ownership IN ('private', 'municipal')), t AS (SELECT pid, area + 1 AS area FROM parcel WHERE ownership IN ('municipal', 'state') AND purpose IS NOT NULL), k AS (SELECT * FROM o UNION ALL SELECT * FROM t WHERE pid NOT IN (SELECT pid FROM o))"


@query("j38_merged_parcels", with_tables("parcel", rest=f"WITH {_SIDES} SELECT pid, area FROM k"))
def j38(spark, d):
    p = load(spark, d, "parcel")
    return registers.merged_across(p.where("ownership IN ('private', 'municipal')").select("pid", "area"), p.where("ownership IN ('municipal', 'state') AND purpose IS NOT NULL").select("pid", (F.col("area") + 1).alias("area")), "pid")


@query("j38_merged_tenants", _with("company", "parcel", "building", rest=_J1 + f", {_SIDES}, kb AS (SELECT bid FROM building WHERE kind <> 'other') SELECT m.code, m.match, k.pid, kb.bid FROM matched m LEFT JOIN k ON k.pid = m.pid LEFT JOIN kb ON kb.bid = m.bid WHERE m.match = 'exact' AND (k.pid IS NOT NULL OR kb.bid IS NOT NULL)"))
def j38b(spark, d):
    return registers.tenants_across(_matched(spark, d), j38(spark, d), load(spark, d, "building").where("kind <> 'other'"))


@query("r18_canopy_masked", with_tables("cell", "building", rest="WITH f AS (SELECT DISTINCT tile % 4 AS tile, z % 40 + b AS y, x % 40 + a AS x FROM building, (SELECT unnest(range(0, 12)) AS a), (SELECT unnest(range(0, 9)) AS b) WHERE a < w AND b < d) SELECT c.tile, c.y, c.x, CASE WHEN f.tile IS NOT NULL THEN 0 ELSE v END AS v FROM cell c LEFT JOIN f ON f.tile = c.tile AND f.y = c.y AND f.x = c.x"))
def r18(spark, d):
    b = load(spark, d, "building").selectExpr("tile % 4 AS tile", "z % 40 AS y0", "x % 40 AS x0", "w", "d")
    at = b.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("w") - 1))).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("d") - 1)))
    return raster.masked_out(load(spark, d, "cell"), at.select("tile", (F.col("y0") + F.col("b")).alias("y"), (F.col("x0") + F.col("a")).alias("x"))).select("tile", "y", "x", "v")


@query("a31_all_bounds", with_tables("parcel", rest="SELECT min(x) AS xmin, min(z) AS zmin, max(x + side) AS xmax, max(z + side) AS zmax FROM parcel"))
def a31(spark, d):
    e = load(spark, d, "parcel").select(G.envelope(G.square(F.col("x"), F.col("z"), F.col("side"))).alias("e"))
    return e.agg(*(f(f"e.{c}").cast("long").alias(c) for f, c in ((F.min, "xmin"), (F.min, "zmin"), (F.max, "xmax"), (F.max, "zmax"))))

"""Queries on map extracts: the driver's tables are written as XML files and read back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotline.operators import osm
from plotline.plans.demo import load
from plotline.plans.registry import query
from plotline.session import new_path
from plotline.sources.osm import Extract, read_osm


def _tags(*pairs) -> Column:
    """Tag children of (condition, key, value)."""
    escaped = lambda v: F.replace(F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    each = (F.when(F.coalesce(c, F.lit(False)), F.concat(F.lit(f'\n    <tag k="{k}" v="'), escaped(F.lit(v) if isinstance(v, str) else v), F.lit('"/>'))) for c, k, v in pairs)
    return F.concat_ws("", *each)


def _place(row: str) -> Column:
    lat, lon = F.lit(57) + F.col(row) % 100 / 50.0, F.lit(22) + F.col(row) % 77 / 12.0
    return F.format_string('lat="%.6f" lon="%.6f"', lat, lon)


def _extract(spark, d) -> Extract:
    """Suppliers are nodes (every 17th is missing), orders are ways along the suppliers of their lines, customers are relations of their
    orders, a node and another relation."""
    s = load(spark, d, "supplier").where("s_suppkey % 17 <> 0")
    k, name = F.col("s_suppkey") % 6, F.concat(F.lit('Pood & "'), F.col("s_name"), F.lit('" >'))
    children = _tags((k == 0, "highway", "bus_stop"), (k == 1, "amenity", "cafe"), (k == 2, "shop", "yes"), (k == 2, "name", name), (k == 3, "office", "it"), ((k == 3) & (F.col("s_suppkey") % 4 > 1), "name", name), (k == 4, "natural", "rock"))
    head = F.concat(F.format_string('  <node id="%d" version="1" ', "s_suppkey"), _place("s_suppkey"))
    nodes = s.select(F.when(children == "", F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">"), children, F.lit("\n  </node>"))).alias("value"))
    nd = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda p: F.concat(F.lit('\n    <nd ref="'), p.l_suppkey.cast("string"), F.lit('"/>')))
    k = F.col("l_orderkey") % 5
    kinds = _tags((k == 0, "highway", "residential"), (k == 0, "name", "Kesk > tn"), (k == 1, "building", "yes"), (k == 2, "barrier", "fence"), (k == 3, "railway", "rail"))
    ways = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat_ws("", nd).alias("nd")).select(F.concat(F.format_string('  <way id="%d">', "l_orderkey"), "nd", kinds, F.lit("\n  </way>")).alias("value"))
    of = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders"))
    c = load(spark, d, "customer").select("c_custkey").join(of, "c_custkey", "left")
    member = lambda kind, ref: F.concat(F.lit(f'\n    <member type="{kind}" ref="'), ref.cast("string"), F.lit('" role=""/>'))
    members = F.concat(member("node", F.col("c_custkey") % 150 + 1), F.coalesce(F.concat_ws("", F.transform("orders", lambda o: member("way", o))), F.lit("")), member("relation", F.col("c_custkey") + 1))
    k = F.col("c_custkey") % 4
    kinds = _tags((k < 2, "amenity", "clinic"), (k == 2, "tourism", "hotel"), (k == 3, "type", "site"))
    relations = c.select(F.concat(F.format_string("  <relation id='%d'>", "c_custkey"), members, kinds, F.lit("\n  </relation>")).alias("value"))
    path = new_path(spark, "extract")
    for part in (nodes, ways, relations):
        part.write.mode("append").text(path)
    return read_osm(spark, path)


_WAYS = """WITH n AS (SELECT s_suppkey AS id, round(57 + s_suppkey % 100 / 50.0, 6) AS lat, round(22 + s_suppkey % 77 / 12.0, 6) AS lon FROM supplier WHERE s_suppkey % 17 <> 0),
r AS (SELECT l_orderkey AS id, l_suppkey AS ref, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS pos FROM lineitem)"""


@query("s9_osm_ways", _WAYS + """, g AS (SELECT r.id, count(*) AS n, count(n.id) AS found, arg_min(lat, pos) AS lat0, arg_max(lat, pos) AS lat1, arg_max(lon, pos) AS lon1, round(sum(lat * pos), 6) AS moment FROM r LEFT JOIN n ON r.ref = n.id GROUP BY r.id)
SELECT id, n, lat0, lat1, lon1, moment, CASE id % 5 WHEN 0 THEN 'Kesk > tn' END AS name FROM g WHERE n = found AND id % 5 IN (0, 2, 3)""")
def s9_ways(spark, d):
    e = _extract(spark, d)
    w = osm.complete_ways(e.ways.where(osm.wanted("way")), e.coords)
    g, end = F.col("geometry"), F.element_at("geometry", -1)
    moment = F.aggregate(F.transform(g, lambda p, i: p.lat * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return w.select("id", F.size(g).cast("long").alias("n"), g[0].lat.alias("lat0"), end.lat.alias("lat1"), end.lon.alias("lon1"), F.round(moment, 6).alias("moment"), F.try_element_at("tags", F.lit("name")).alias("name"))


@query("s9_osm_relations", _WAYS + """, m AS (SELECT c_custkey AS id, c_custkey % 150 + 1 AS ref FROM customer UNION ALL SELECT o_custkey, ref FROM orders JOIN r ON r.id = o_orderkey)
SELECT m.id, min(lat) AS minlat, min(lon) AS minlon, max(lat) AS maxlat, max(lon) AS maxlon FROM m JOIN n ON n.id = m.ref WHERE m.id % 4 < 3 GROUP BY m.id""")
def s9_relations(spark, d):
    e = _extract(spark, d)
    return osm.relation_bounds(e.relations.where(osm.wanted("relation")), e.ways, e.coords)


@query("s10_osm_wanted", """SELECT 'node' AS kind, count(*) AS n FROM supplier WHERE s_suppkey % 17 <> 0 AND (s_suppkey % 6 < 3 OR s_suppkey % 6 = 3 AND s_suppkey % 4 > 1)
UNION ALL SELECT 'way', count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey % 5 IN (0, 2, 3) UNION ALL SELECT 'relation', count(*) FROM customer WHERE c_custkey % 4 < 3""")
def s10(spark, d):
    e = _extract(spark, d)
    counts = [t.where(osm.wanted(kind)).agg(F.lit(kind).alias("kind"), F.count("*").alias("n")).select("kind", "n") for kind, t in (("node", e.nodes), ("way", e.ways), ("relation", e.relations))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("t26_poi_keys", """SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 1 THEN 'amenity' WHEN 2 THEN 'shop' ELSE 'office' END AS key, CASE WHEN s_suppkey % 6 > 1 THEN 'Pood & "' || s_name || '" >' END AS name
FROM supplier WHERE s_suppkey % 17 <> 0 AND (s_suppkey % 6 IN (1, 2) OR s_suppkey % 6 = 3 AND s_suppkey % 4 > 1)""")
def t26(spark, d):
    return _extract(spark, d).nodes.select("id", osm.poi_key().alias("key"), F.try_element_at("tags", F.lit("name")).alias("name")).where("key IS NOT NULL")

"""Map elements: which ones count, their geometry, and the layers that they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tags by which an element is wanted.
NODE_HIGHWAYS = ("bus_stop", "street_lamp", "traffic_signals", "crossing")
NODE_AMENITIES = ("bench", "waste_basket", "bicycle_parking")
NODE_RAILWAYS = ("tram_stop", "halt", "station", "stop")
WAY_AMENITIES = ("parking", "parking_space")
POI_AMENITIES = (
    "restaurant", "cafe", "bar", "pub", "fast_food", "pharmacy", "bank", "ice_cream", "nightclub", "biergarten", "food_court", "fuel", "car_wash", "marketplace", "cinema", "theatre",
    "dentist", "doctors", "clinic", "veterinary",
)
LODGING = ("hotel", "hostel", "guest_house", "motel")
NAMED_LEISURE_WANTED = ("fitness_centre", "sauna", "escape_game", "amusement_arcade")


def _tag(key: str) -> Column:
    return F.try_element_at("tags", F.lit(key))


def _has(key: str) -> Column:
    return F.map_contains_key("tags", key)


def _is(key: str, *values: str) -> Column:
    return F.coalesce(_tag(key).isin(*values), F.lit(False))


def wanted(kind: str) -> Column:
    """Whether a node, way or relation with these ``tags`` is one that some layer reads."""
    poi = _has("shop") | _is("amenity", *POI_AMENITIES) | ((_has("office") | _has("craft")) & _has("name")) | _is("tourism", *LODGING) | (_is("leisure", *NAMED_LEISURE_WANTED) & _has("name"))
    if kind == "node":
        street = _is("highway", *NODE_HIGHWAYS) | _is("amenity", *NODE_AMENITIES) | _is("natural", "tree") | _is("railway", *NODE_RAILWAYS) | _has("entrance")
        return poi | street | (_is("public_transport", "stop_position") & _is("tram", "yes")) | _has("barrier")
    if kind == "way":
        drawn = _is("leisure", "pitch") | _is("natural", "tree_row") | _is("landuse", "flowerbed") | _is("man_made", "pier") | _is("amenity", *WAY_AMENITIES) | _has("railway")
        return poi | (F.coalesce(_tag("highway"), F.lit("")) != "") | _has("barrier") | drawn
    return poi


def poi_key() -> Column:
    """The tag that makes an element a place of business, in this order; null for the rest. Offices, crafts and leisure count by name only."""
    named = F.coalesce(_tag("name"), F.lit("")) != ""
    return (
        F.when(_has("shop"), "shop").when(_is("amenity", *POI_AMENITIES), "amenity").when(_has("office") & named, "office").when(_has("craft") & named, "craft")
        .when(_is("tourism", *LODGING), "tourism").when(_is("leisure", *NAMED_LEISURE_WANTED) & named, "leisure")
    )


def complete_ways(ways: DataFrame, coords: DataFrame) -> DataFrame:
    """id, tags, refs, geometry ARRAY<STRUCT<lat, lon>> of ways all of whose nodes have a place; a way with a missing node, or without nodes, is
    left out. References are exploded and meet their nodes by id, so that neither long ways nor nodes of many ways gather."""
    at = ways.select("id", F.size("refs").alias("n"), F.posexplode("refs").alias("pos", "ref"))  # grouped by id alone, as ways are dealt
    placed = at.join(coords.select(F.col("id").alias("ref"), "lat", "lon"), "ref")
    line = F.transform(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))), lambda p: F.struct(p.lat.alias("lat"), p.lon.alias("lon")))
    whole = placed.groupBy("id").agg(F.max("n").alias("n"), F.count("*").alias("found"), line.alias("geometry")).where("found = n")
    return ways.join(whole.select("id", "geometry"), "id")


def relation_bounds(relations: DataFrame, ways: DataFrame, coords: DataFrame) -> DataFrame:
    """id, minlat, minlon, maxlat, maxlon over the nodes of a relation and of its ways, as far as they are there. Members that are relations
    add nothing; relations without any node are left out. A way's box is made once, however many relations it belongs to."""
    places = coords.select(F.col("id").alias("ref"), *(F.struct("lat", "lon").alias(c) for c in ("least", "most")))
    m = relations.select("id", F.explode("members").alias("m")).select("id", "m.type", "m.ref")
    reach = [F.min("least.lat").alias("minlat"), F.min("least.lon").alias("minlon"), F.max("most.lat").alias("maxlat"), F.max("most.lon").alias("maxlon")]
    ends = [F.struct(F.col(f"{c}lat").alias("lat"), F.col(f"{c}lon").alias("lon")).alias(n) for c, n in (("min", "least"), ("max", "most"))]
    boxes = ways.select("id", F.explode("refs").alias("ref")).join(places, "ref").groupBy("id").agg(*reach).select(F.col("id").alias("ref"), *ends)
    of = lambda kind, with_: m.where(F.col("type") == kind).select("id", "ref").join(with_, "ref")
    return of("node", places).unionByName(of("way", boxes)).groupBy("id").agg(*reach)


def in_box(nodes: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Nodes inside a box, edges included."""
    return nodes.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))

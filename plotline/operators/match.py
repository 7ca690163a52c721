"""Matching companies to buildings and parcels by address, and names to names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.functions import text as T
from plotline.operators import spatial


def address_keys(rows: DataFrame, key: str, address: str) -> DataFrame:
    """key, pos, stem, num, sub: a row for each alternate of an address."""
    return rows.select(key, F.posexplode(T.address_alternates(F.col(address))).alias("pos", "_parts")).select(key, "pos", "_parts.stem", "_parts.num", "_parts.sub")


def best_building(buildings: DataFrame, key: list[str]) -> DataFrame:
    """The building of each key: no outbuilding if possible, then the largest footprint, then the smallest id."""
    return buildings.groupBy(*key).agg(F.max_by("bid", F.struct(F.col("kind") != "outbuilding", F.col("w") * F.col("d"), -F.col("bid"))).alias("bid"))


def parcel_of_building(buildings: DataFrame, parcels: DataFrame) -> DataFrame:
    """bid, pid: the parcel that a building (bid, pid, tile, x, z) names, else the one (pid, tile, ring) that holds it; the smallest id if several do."""
    lost = buildings.where("pid IS NULL").select("tile", F.col("bid").alias("point"), "x", "z")
    held = spatial.point_in_polygon(lost, parcels.where("ring IS NOT NULL").select("tile", F.col("pid").alias("polygon"), "ring"))
    return buildings.where("pid IS NOT NULL").select("bid", "pid").unionByName(held.select(F.col("point").alias("bid"), F.col("polygon").alias("pid")))


def match_cascade(companies: DataFrame, parcels: DataFrame, buildings: DataFrame) -> DataFrame:
    """code, match, via, pid, bid for companies (code, address, adr_id), parcels (pid, address, tile, ring) and buildings (bid, address, addresses
    ARRAY, ids ARRAY, kind, w, d, pid, tile, x, z): the building with the company's address id among its own; the first parcel with the
    full address; the only parcel with street and number, for companies without a letter; the best building of the full address,
    under any of its addresses; the street is known; without a number, the first parcel of that farm name. A matched building brings its
    parcel along, or the one around it.

    All keys are one table, aggregated once: full addresses, street and number, street, and address ids, each with the parcels and
    buildings there. A company asks for the keys that concern it, so there is one join, and one row for each company again."""
    home = buildings.join(parcel_of_building(buildings, parcels).withColumnRenamed("pid", "b_pid"), "bid", "left")
    rank = F.struct(F.coalesce(F.col("kind") != "outbuilding", F.lit(True)).alias("main"), (F.col("w") * F.col("d")).cast("double").alias("size"), (-F.col("bid")).alias("first"))
    home = home.select("bid", "address", "addresses", "ids", F.struct(rank.alias("rank"), "bid", "b_pid").alias("b"))
    known = F.array_distinct(F.filter(F.concat(F.array("address"), F.coalesce("addresses", F.array().cast("array<string>"))), lambda a: a.isNotNull()))
    none = F.lit(None)
    parts = T.address_alternates(F.col("a"))
    each = parcels.select(F.col("address").alias("a"), "pid", none.cast(home.schema["b"].dataType).alias("b")).withColumn("k", F.explode(parts))
    each = each.select("k", F.col("pid").cast("long").alias("pid"), "b").union(home.select(F.explode(known).alias("a"), "b").select(F.explode(parts).alias("k"), none.cast("long").alias("pid"), "b"))
    key = lambda level, a, b, c: F.struct(F.lit(level).alias("level"), a.alias("a"), b.alias("b"), c.alias("c"))
    blank, at = F.lit(""), F.col("k")
    numbered = at["num"] != ""
    levels = F.array(key("full", at["stem"], at["num"], at["sub"]), key("house", at["stem"], at["num"], blank), key("street", at["stem"], blank, blank))
    rows = each.where((at["stem"] != "") & (numbered | F.col("pid").isNotNull())).select(F.explode(F.when(numbered, levels).otherwise(F.slice(levels, 1, 1))).alias("key"), "pid", "b")
    by_id = home.select(F.explode("ids").alias("id"), "b").where("id IS NOT NULL").select(key("id", F.col("id"), blank, blank).alias("key"), none.cast("long").alias("pid"), "b")
    table = rows.union(by_id).groupBy("key").agg(F.min("pid").alias("pid"), F.count("pid").alias("pids"), F.max("b").alias("b"))
    c = companies.select("code", "adr_id", T.address_parts(F.coalesce("address", F.lit(""))).alias("k"))
    asked = F.filter(F.concat(F.array(key("id", F.col("adr_id"), blank, blank)), F.when(at["num"] != "", levels).otherwise(F.slice(levels, 1, 1))), lambda x: x["a"].isNotNull())
    found = c.select("code", "k", F.explode(asked).alias("key")).join(table, "key", "left")
    of = lambda level, what: F.any_value(F.when(F.col("key.level") == level, what), ignoreNulls=True)
    x = found.groupBy("code").agg(
        F.any_value("k").alias("k"), of("id", F.col("b")).alias("own"), of("full", F.col("pid")).alias("p_full"), of("full", F.col("b")).alias("here"),
        of("house", F.when(F.col("pids") == 1, F.col("pid"))).alias("p_alone"), of("street", F.col("pids")).alias("on_street"),
    )
    has_number = at["num"] != ""
    alone = F.when(at["sub"] == "", F.col("p_alone"))
    via = F.when(F.col("own").isNotNull(), "ads").when(has_number & F.coalesce("p_full", alone).isNotNull(), "address").when(has_number & F.col("here").isNotNull(), "building").when(~has_number & F.col("p_full").isNotNull(), "farm")
    x = x.withColumn("via", via)
    building = F.when(F.col("via") == "ads", F.col("own")).when(F.col("via") == "building", F.col("here"))
    pid = F.when(F.col("via").isin("ads", "building"), building["b_pid"]).otherwise(F.when(F.col("via").isNotNull(), F.coalesce("p_full", F.when(has_number, alone))))
    kind = F.when(F.col("via").isNotNull(), "exact").when(has_number & F.col("on_street").isNotNull(), "street").otherwise("none")
    return x.select("code", kind.alias("match"), "via", pid.alias("pid"), building["bid"].alias("bid"))


def match_lv(companies: DataFrame, parcels: DataFrame, buildings: DataFrame) -> DataFrame:
    """code, match, via, pid, bid for companies (code, addressid, address), parcels (pid, ads_oid, address, settlement) and buildings
    (bid, var_code, address, kind, w, d, pid): the building, then the parcel with the company's address code; for companies of a town that
    has parcels, the first of the address's keys that a building or, failing that, a parcel has; one of its streets is known."""
    shape = buildings.select("bid", "kind", "w", "d")
    b_pid = buildings.select("bid", F.col("pid").alias("b_pid"))
    code_b = buildings.where("var_code IS NOT NULL").groupBy(F.col("var_code").alias("addressid")).agg(F.max("bid").alias("c_bid"))
    code_p = parcels.where("ads_oid IS NOT NULL").groupBy(F.col("ads_oid").alias("addressid")).agg(F.max("pid").alias("c_pid"))
    keys = lambda rows, key: rows.select(key, F.explode(T.lv_address_keys(F.col("address"))).alias("_k")).select(key, "_k.street", "_k.num")
    kb, kp = keys(buildings, "bid"), keys(parcels, "pid")
    best = best_building(kb.join(shape, "bid"), ["street", "num"])
    first = kp.groupBy("street", "num").agg(F.min("pid").alias("k_pid"))
    streets = kb.select("street").union(kp.select("street")).distinct().withColumn("known", F.lit(True))
    towns = parcels.where("settlement IS NOT NULL").select(F.lower("settlement").alias("town")).distinct().withColumn("here", F.lit(True))
    place = T.lv_town_and_street(F.col("address"))
    c = companies.select("code", "addressid", place.alias("_p")).select("code", "addressid", "_p.town", "_p.part")
    asked = c.select("code", F.posexplode(T.lv_address_keys(F.col("part"))).alias("ord", "_k")).select("code", "ord", "_k.street", "_k.num")
    hits = asked.join(best, ["street", "num"], "left").join(first, ["street", "num"], "left").join(streets, "street", "left")
    found = F.col("bid").isNotNull() | F.col("k_pid").isNotNull()
    hits = hits.groupBy("code").agg(F.min_by(F.struct("bid", "k_pid"), F.when(found, F.col("ord"))).alias("h"), F.bool_or(F.coalesce("known", F.lit(False))).alias("known"))
    x = c.join(code_b, "addressid", "left").join(code_p, "addressid", "left").join(towns, "town", "left").join(hits, "code", "left")
    here = F.coalesce("here", F.lit(False))
    via = F.when(F.col("c_bid").isNotNull() | F.col("c_pid").isNotNull(), "var").when(here & (F.col("h.bid").isNotNull() | F.col("h.k_pid").isNotNull()), "address")
    x = x.withColumn("via", via).withColumn("bid", F.when(F.col("via") == "var", F.col("c_bid")).when(F.col("via") == "address", F.col("h.bid"))).join(b_pid, "bid", "left")
    pid = F.when(F.col("bid").isNotNull(), F.col("b_pid")).when(F.col("via") == "var", F.col("c_pid")).when(F.col("via") == "address", F.col("h.k_pid"))
    kind = F.when(F.col("via").isNotNull(), "exact").when(here & F.col("known"), "street").otherwise("none")
    return x.select("code", kind.alias("match"), "via", pid.alias("pid"), "bid")


def match_fi(addresses: DataFrame, parcels: DataFrame, buildings: DataFrame) -> DataFrame:
    """code, match, pid, bid for company addresses (code, type, ord, street, number, municipality), parcels (pid, address, municipality) and
    buildings (bid, address, kind, w, d, pid): visiting addresses (type 1) first, those of other municipalities left out; of the forms of
    the house number the first that a building or, failing that, a parcel has; else the street is known."""
    parts = lambda rows, key: rows.select(key, T.fi_street_and_number(F.col("address")).alias("_a")).where("_a.street IS NOT NULL").select(key, F.col("_a.street").alias("street"), F.explode("_a.forms").alias("num"))
    kb, kp = parts(buildings, "bid"), parts(parcels, "pid")
    best = best_building(kb.join(buildings.select("bid", "kind", "w", "d"), "bid"), ["street", "num"]).join(buildings.select("bid", F.col("pid").alias("b_pid")), "bid")
    first = kp.groupBy("street", "num").agg(F.min("pid").alias("k_pid"))
    streets = kb.select("street").union(kp.select("street")).distinct().withColumn("known", F.lit(True))
    towns = parcels.where("municipality IS NOT NULL").select("municipality").distinct().withColumn("here", F.lit(True))
    a = addresses.join(towns, "municipality", "left").where("municipality IS NULL OR here")
    a = a.select("code", (F.col("type") != 1).cast("int").alias("later"), "ord", F.trim(F.regexp_replace(F.lower("street"), r"\s+", " ")).alias("street"), T.house_forms(F.col("number")).alias("forms"))
    asked = a.select("code", "later", "ord", "street", F.posexplode_outer("forms").alias("at", "num"))
    hits = asked.join(best, ["street", "num"], "left").join(first, ["street", "num"], "left").join(streets, "street", "left")
    found = F.col("bid").isNotNull() | F.col("k_pid").isNotNull()
    hit = F.min_by(F.struct("bid", F.when(F.col("bid").isNotNull(), F.col("b_pid")).otherwise(F.col("k_pid")).alias("pid")), F.when(found, F.struct("later", "ord", "at")))
    x = hits.groupBy("code").agg(hit.alias("h"), F.bool_or(found).alias("exact"), F.bool_or(F.coalesce("known", F.lit(False))).alias("known"))
    x = addresses.select("code").distinct().join(x, "code", "left")
    return x.select("code", F.when(F.col("exact"), "exact").when(F.col("known"), "street").otherwise("none").alias("match"), "h.pid", "h.bid")


def name_matches(left: DataFrame, right: DataFrame, block: str, least: float = 0.5) -> DataFrame:
    """left_id, right_id, score: for each left name the best right name of its block with a score of at least ``least`` (ties: smallest id). Names of
    equal words meet once in a block, however many rows have them."""
    names = left.select(block, "left_tokens").distinct()
    first = right.groupBy(block, "right_tokens").agg(F.min("right_id").alias("right_id"))
    pairs = names.join(first, block).withColumn("score", T.name_score(F.col("left_tokens"), F.col("right_tokens"))).where(F.col("score") >= least)
    best = pairs.groupBy(block, "left_tokens").agg(F.max_by(F.struct("right_id", "score"), F.struct(F.col("score"), -F.col("right_id"))).alias("m"))
    return left.join(best, [block, "left_tokens"]).select("left_id", "m.right_id", "m.score")

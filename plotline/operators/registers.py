"""Register rows: who is kept, proceedings, statements, holders, properties, and unions of extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotline.functions.text import holder_id
from plotline.operators.links import pairs_within

#: Roles of board members in the companies register.
BOARD_ROLES = ("JUHL", "JUHE", "JUHT", "TEGJ", "PROK")
#: Timetable route types of buses and trolleybuses.
BUS_TYPES = ("3", "11", "700", "701", "702", "704", "711", "715", "800")


def in_settlements(rows: DataFrame, places: DataFrame, code: str) -> DataFrame:
    """Rows whose settlement code some place has."""
    return rows.join(places.select(code).distinct(), code, "left_semi")


def legal_persons(rows: DataFrame, form: str, left_out: tuple[str, ...]) -> DataFrame:
    """Rows of other legal forms than those left out (people, housing associations); an unknown form stays."""
    return rows.where(F.coalesce(~F.col(form).isin(*left_out), F.lit(True)))


def holders(officers: DataFrame) -> DataFrame:
    """code, board, owners, board_size, shareholders, owner_managed, holders: sets of opaque ids over records (code, raw, role, ended) that
    have not ended. A side without records is null, not empty; holders joins both sides."""
    open_ = officers.where(~F.col("ended")).withColumn("id", holder_id(F.col("raw")))
    on_board = F.col("role").isin(*BOARD_ROLES)
    sets = open_.groupBy("code").agg(
        F.count_if(on_board).alias("b"), F.count_if(F.col("role") == "OSAN").alias("o"),
        F.array_sort(F.collect_set(F.when(on_board, F.col("id")))).alias("board"), F.array_sort(F.collect_set(F.when(F.col("role") == "OSAN", F.col("id")))).alias("owners"),
    )
    has = lambda n, x: F.when(F.col(n) > 0, x)
    both = (F.col("b") > 0) & (F.col("o") > 0)
    return sets.select(
        "code", has("b", F.size("board")).alias("board_size"), has("o", F.size("owners")).alias("shareholders"),
        F.when(both, F.arrays_overlap("board", "owners")).alias("owner_managed"), F.array_sort(F.array_union("board", "owners")).alias("holders"),
    )


def statuses(companies: DataFrame, proceedings: DataFrame) -> DataFrame:
    """code, status: N (insolvent), L (in liquidation), P (legal protection) or R, in this order, by proceedings (code, form, ended) that
    have not ended: any form but insolvency and liquidation, or none, protects. Liquidations count whether or not they have."""
    form, running = F.coalesce("form", F.lit("")), F.coalesce(~F.col("ended"), F.lit(True))
    is_n, is_l = form == "INSOLVENCY", form == "LIQUIDATION"
    any_of = lambda c: F.count_if(c) > 0
    p = proceedings.groupBy("code").agg(any_of(is_n & running).alias("n"), any_of(is_l).alias("l"), any_of(~is_n & ~is_l & running).alias("p"))
    return companies.select("code").join(p, "code", "left").select("code", F.when(F.col("n"), "N").when(F.col("l"), "L").when(F.col("p"), "P").otherwise("R").alias("status"))


def yearly_reports(statements: DataFrame, incomes: DataFrame) -> DataFrame:
    """code, year, turnover, employees: statements (sid, code, year, employees, thousands) with their income (sid, turnover), which may be
    in thousands; of several for a year that with an income and the largest number is kept. A statement without an income still dates a
    filing; one without a year does not."""
    x = statements.where("year IS NOT NULL").join(incomes, "sid", "left")
    x = x.withColumn("turnover", F.col("turnover") * F.when(F.col("thousands"), 1000).otherwise(1))
    best = F.max_by(F.struct("turnover", "employees"), F.struct(F.col("turnover").isNotNull(), "sid"))
    return x.groupBy("code", "year").agg(best.alias("r")).select("code", "year", "r.turnover", "r.employees")


def taxes_of_latest_year(quarters: DataFrame) -> DataFrame:
    """code, year, taxes: of the latest year with four quarters, else of the latest year."""
    years = quarters.groupBy("code", "year").agg(F.count("*").alias("n"), F.sum(F.coalesce("taxes", F.lit(0))).alias("taxes"))
    return years.groupBy("code").agg(F.max_by(F.struct("year", "taxes"), F.struct(F.col("n") == 4, "year")).alias("y")).select("code", "y.year", "y.taxes")


def first_property(objects: DataFrame) -> DataFrame:
    """tunnus, property, kinds: the first property (property, ord, tunnus, kind) that holds an object, with the kinds of its owners."""
    first = objects.groupBy("tunnus").agg(F.min_by("property", F.struct("ord", "property")).alias("property"))
    kinds = objects.groupBy("property").agg(F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("kinds"))
    return first.join(kinds, "property").select("tunnus", "property", "kinds")


def purposes_by_area(rows: DataFrame) -> DataFrame:
    """tunnus, purposes, pct: land purposes (tunnus, purpose, area) from the largest, and their whole percentages of the parcel."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("area")).alias("order"), "purpose")))
    x = rows.groupBy("tunnus").agg(listed.alias("l"), F.sum("area").alias("whole"))
    return x.select("tunnus", F.array_join(F.transform("l", lambda p: p.purpose), ",").alias("purposes"), F.array_join(F.transform("l", lambda p: F.round(-p["order"] * 100 / F.col("whole")).cast("long").cast("string")), ",").alias("pct"))


def straddling_pairs(buildings: DataFrame) -> DataFrame:
    """a < b: parcels that one building (bid, cadastral ARRAY) stands on together."""
    on = buildings.select("bid", F.explode(F.array_distinct(F.array_compact("cadastral"))).alias("tunnus"))
    return pairs_within(on, "bid", "tunnus").select("a", "b").distinct()


def without_strangers(matched: DataFrame, parcels: DataFrame) -> DataFrame:
    """Matches whose parcel is not among ``parcels`` lose it, and count as street matches unless a building is known."""
    known = parcels.select("pid", F.lit(True).alias("known"))
    x = matched.join(known, "pid", "left")
    lost = F.col("pid").isNotNull() & F.col("known").isNull()
    return x.select("code", F.when(lost & F.col("bid").isNull(), "street").otherwise(F.col("match")).alias("match"), "via", F.when(~lost, F.col("pid")).alias("pid"), "bid")


def standing_in(buildings: DataFrame, year: int, undated: bool) -> DataFrame:
    """Buildings dated up to a year, and those without a date if they are asked for."""
    dated = F.col("year") <= year
    return buildings.where(F.coalesce(dated, F.lit(undated)))


def finite(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows whose columns are neither null, NaN nor infinite."""
    ok = F.lit(True)
    for c in columns:
        x = F.col(c).cast("double")
        ok = ok & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return rows.where(ok)


def first_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def union_of_extracts(extracts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Elements of several extracts, each once; the earlier extract's copy stays."""
    out = None
    for i, e in enumerate(extracts):
        x = e.withColumn("_i", F.lit(i))
        out = x if out is None else out.unionByName(x)
    rest = [c for c in out.columns if c not in (*keys, "_i")]
    return out.groupBy(*keys).agg(F.min_by(F.struct(*rest), "_i").alias("r")).select(*keys, *(f"r.{c}" for c in rest))


def union_of_feeds(feeds: dict[str, DataFrame], ids: list[str]) -> DataFrame:
    """Rows of several feeds; ids carry the feed's name."""
    out = None
    for name, rows in feeds.items():
        x = rows.withColumns({c: F.concat(F.lit(f"{name}:"), F.col(c).cast("string")) for c in ids})
        out = x if out is None else out.unionByName(x)
    return out


def nearest_copy(copies: DataFrame, key: str, distance: Column) -> DataFrame:
    """Of the copies of a row in several tiles, that of the nearest tile."""
    rest = [c for c in copies.columns if c != key]
    return copies.groupBy(key).agg(F.min_by(F.struct(*rest), distance).alias("r")).select(key, "r.*")


def merged_across(own: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """A side's rows and, of the other side's, those that are not already there."""
    return own.unionByName(other.join(own.select(key), key, "left_anti").select(*own.columns))


def tenants_across(tenants: DataFrame, parcels: DataFrame, buildings: DataFrame) -> DataFrame:
    """Tenants (code, match, pid, bid) of the other side: exact matches on a parcel or building that was kept; the reference that was not is
    null."""
    p, b = parcels.select("pid", F.lit(True).alias("has_p")), buildings.select("bid", F.lit(True).alias("has_b"))
    x = tenants.where("match = 'exact'").join(p, "pid", "left").join(b, "bid", "left").where("has_p OR has_b")
    return x.select("code", "match", F.when(F.col("has_p"), F.col("pid")).alias("pid"), F.when(F.col("has_b"), F.col("bid")).alias("bid"))

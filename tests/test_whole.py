"""Queries over whole tables, and the wanted sets of the operators behind them."""

import os

import pytest

from plotline.operators import links, quality, spatial, transit
from plotline.plans.demo import load
from plotline.queries import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_all_rows_are_asked(spark):
    q, ids = queries(), lambda df: {r[0] for r in df.distinct().collect()}
    parcels, companies = load(spark, DATA, "parcel"), load(spark, DATA, "company")
    assert ids(q["j33_all_links"](spark, DATA).join(parcels, "tunnus").select("tile")) == set(range(9))
    assert ids(q["j11_all_points_to_road"](spark, DATA).selectExpr("id % 5")) == set(range(5))
    first = load(spark, DATA, "stop_time").where("seq = 1").join(load(spark, DATA, "trip"), "trip").select("line", "headsign").distinct()
    assert q["a20_all_departures"](spark, DATA).select("line", "headsign").distinct().count() == first.count()
    unknown = ids(companies.select("tunnus")) - ids(parcels.select("tunnus"))
    assert ids(q["u5_all_known_ids"](spark, DATA)) == unknown
    assert q["d3_all_dangling"](spark, DATA).count() == sum(r.tunnus in unknown for r in companies.collect())


def test_wanted_sets(spark):
    h = spark.createDataFrame([("o", "a"), ("o", "b"), ("o", "c")], "owner string, tunnus string")
    p = spark.createDataFrame([("a", None), ("b", None), ("c", None)], "tunnus string, land_registry string")
    ask = lambda wanted: {(r.tunnus, r.other) for r in links.links(links.shared_owner_pairs(h), links.immovable_pairs(p), wanted).collect()}
    assert ask(p.where("tunnus = 'a'")) == {("a", "b"), ("a", "c")} and len(ask(p)) == 6
    trips = spark.createDataFrame([(1, "2", "to x", 0)], "trip long, line string, headsign string, service int")
    calls = spark.createDataFrame([(1, 7, 1, 60), (1, 8, 2, 70)], "trip long, stop long, seq int, minute int")
    times = lambda *stops: transit.departures(trips, calls, *stops).first().times
    assert times() == "01:00" and times(calls.where("stop = 8").select("stop")) == "01:10"
    road = spark.createDataFrame([(0, 5, 0, 0, 10, 0, 4)], "tile long, rid long, ax long, az long, bx long, bz long, width int")
    points = spark.createDataFrame([(0, 1, 2, 3), (0, 2, 4, 1)], "tile long, id long, x long, z long")
    snapped = lambda some: {r.id for r in spatial.nearest_segment(some, road, 25.0).collect()}
    assert snapped(points) == {1, 2} and snapped(points.where("id = 2")) == {2}
    companies = spark.createDataFrame([(1, "a"), (2, "z")], "code long, tunnus string")
    lost = lambda known: {r.key for r in quality.dangling(companies, "code", "tunnus", known, "tunnus", "tunnus").collect()}
    assert lost(p) == {"2"} and lost(p.where("tunnus = 'b'")) == {"1", "2"}

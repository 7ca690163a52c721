"""Pinned cases of single rules, by hand."""

import uuid

import pytest
from pyspark.sql import functions as F

from plotline.functions import geometry as G
from plotline.functions import text as T
from plotline.operators import company, links, raster, transit


def one(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


def test_holder_ids(spark):
    same = ["10867775", "900606898", "556333fe-0000-4000-8000-0000005a20fa"]
    assert one(spark, same, T.holder_id) == same
    assert one(spark, ["", "-", "--", "---", "puudub", "Pole", "puudu", "n/a", "na", "none", "0", " 0 ", None], T.holder_id) == [None] * 13
    a, b, c = one(spark, ["HRB 153232", "hrb 153232", "Jaan Tamm"], T.holder_id)
    assert a == b == str(uuid.uuid5(uuid.UUID(hex=T.NAMESPACE), "hrb 153232")) and c == str(uuid.uuid5(uuid.UUID(hex=T.NAMESPACE), "jaan tamm"))


def test_addresses(spark):
    from plotline.operators.match import address_keys

    rows = spark.createDataFrame([(1, "Klaose tn 16 // Meruski tn 14 // 16"), (2, "Kvissentali tee 9b"), (3, "Madruse tn 22-11"), (4, "Kasemäe"), (5, "Pikk tänav 4."), (6, None), (7, "16 // Aeru põik 3/5")], "k long, a string")
    got = {(r.k, r.pos): (r.stem, r.num, r["sub"]) for r in address_keys(rows, "k", "a").collect()}
    assert got == {
        (1, 0): ("klaose", "16", ""), (1, 1): ("meruski", "14", ""), (1, 2): ("meruski", "16", ""), (2, 0): ("kvissentali", "9", "b"), (3, 0): ("madruse", "22", ""),
        (4, 0): ("kasemäe", "", ""), (5, 0): ("pikk", "4", ""), (7, 0): ("16", "", ""), (7, 1): ("aeru", "3", ""),
    }


def test_sections(spark):
    rows = spark.createDataFrame([("73111", 2), ("73111", 3), ("73111", None), ("68201", 2), ("35111", 3), ("93000", 2), ("00000", 2), ("x", 2), (None, 3), ("61", 3)], "code string, version int")
    got = [tuple(r) for r in rows.select(T.activity_section(F.col("code"), F.col("version")), T.activity_group(F.col("code"), F.col("version"))).collect()]
    assert got == [("M", "services"), ("N", "services"), ("M", "services"), ("L", "property"), ("D", "industry"), ("R", "culture"), ("", ""), ("", ""), ("", ""), ("K", "media")]


def test_labels_dates_numbers(spark):
    assert one(spark, ["09100801420004"], T.parcel_label) == ["91-8-142-4"]
    assert [str(x) for x in one(spark, ["05.03.2021", "2021", ""], T.iso_date)] == ["2021-03-05", "None", "None"]
    assert one(spark, ["2,5 m", "x", None], T.first_number) == [2.5, None, None]
    assert one(spark, ["1 234,9", "", "7"], T.whole_money) == [1234, None, 7]


def test_grid(spark):
    e, n = G.to_grid(F.lit(58.40625), F.lit(26.69666))
    r = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert abs(r.e - 657600) < 1 and abs(r.n - 6477150) < 1


@pytest.mark.parametrize(
    "status,overdue,labour,quarters,want",
    [
        ("R", False, None, [(2024, q, None, None, 58) for q in (1, 2, 3, 4)], ("sound", None)),
        ("R", False, None, [(2024, q, 0, None, 3) for q in (1, 2, 3, 4)], ("distressed", "zero_taxes")),
        ("R", False, 0, [(2024, q, None, None, 3) for q in (1, 2, 3, 4)], ("distressed", "zero_taxes")),
        ("R", False, 900, [(2024, q, 0, None, 3) for q in (1, 2, 3, 4)], ("sound", None)),
        ("L", False, None, [], ("distressed", "status")),
        ("R", True, None, [], ("watch", "report")),
        ("R", False, None, [(2024, q, 9, 30000, 1) for q in (1, 2, 3, 4)] + [(2025, q, 9, 5000, 1) for q in (1, 2, 3, 4)], ("watch", "turnover")),
    ],
)
def test_health(spark, status, overdue, labour, quarters, want):
    c = spark.createDataFrame([(1, status, overdue)], "code long, status string, overdue boolean")
    q = spark.createDataFrame([(1, *x, labour) for x in quarters], "code long, year int, q int, taxes long, turnover long, employees long, labour long")
    r = company.health(c, q).first()
    assert (r.health, r.rule) == want
    if want[1] == "turnover":
        assert (r.from_year, r.from_turnover, r.to_year, r.to_turnover) == (2024, 120000, 2025, 20000)


def test_shares(spark):
    t = spark.createDataFrame([("p", True, "trade", 3), ("p", True, "media", 1), ("q", True, "trade", None), ("q", True, None, None), ("q", False, "trade", 9)], "tunnus string, active boolean, sector string, employees long")
    got = {(r.tunnus, r.sector): r.share for r in company.sector_shares(t).collect()}
    assert got == {("p", "trade"): 0.75, ("p", "media"): 0.25, ("q", "trade"): 0.5, ("q", ""): 0.5}


def test_links(spark):
    h = spark.createDataFrame([("o1", "a"), ("o1", "b"), ("o2", "a"), ("o2", "b"), ("o3", "c")], "owner string, tunnus string")
    p = spark.createDataFrame([("a", "5"), ("c", "5"), ("b", "korteriomand"), ("d", "korteriomand")], "tunnus string, land_registry string")
    got = links.links(links.shared_owner_pairs(h), links.immovable_pairs(p), p)
    found = {(r.tunnus, r.other): (r.kinds, r.shared) for r in got.collect()}
    assert found == {("a", "b"): ("owner", 2), ("b", "a"): ("owner", 2), ("a", "c"): ("immovable", 0), ("c", "a"): ("immovable", 0)}
    assert "owner" not in got.columns


def test_components_partition_the_mask(spark):
    picture = ["11..1", "..1.1", "....1", "1...."]
    mask = [(0, y, x) for y, row in enumerate(picture) for x, c in enumerate(row) if c == "1"]
    got = {(r.y, r.x): r.label for r in raster.components(spark.createDataFrame(mask, "tile long, y long, x long")).collect()}
    assert set(got) == {m[1:] for m in mask}
    assert got[0, 0] == got[0, 1] == got[1, 2] and got[0, 4] == got[1, 4] == got[2, 4] and len(set(got.values())) == 3


def test_opening_hours(spark):
    texts = ["24/7", "Mo-Fr 08:00-12:00,13:00-17:00", "Fr,Sa 11:00-02:00", "off", "PH off", "Jan-Mar 10:00-12:00", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "poi long, opening_hours string")
    got = {}
    for r in transit.opening_hours(rows).collect():
        got.setdefault(r.poi, []).append((r.day, r.open, r.close))
    assert {k: len(v) for k, v in got.items()} == {0: 7, 1: 10, 2: 2}
    assert sorted(got[2]) == [(4, 660, 1560), (5, 660, 1560)]
    assert [r.poi for r in transit.open_at(transit.opening_hours(rows), 6, 60).orderBy("poi").collect()] == [0, 2]


def test_empty_tables(spark):
    q = spark.createDataFrame([], "code long, year int, q int, taxes long, turnover long, employees long, labour long")
    assert company.recent_totals(q).count() == 0
    assert raster.components(spark.createDataFrame([], "tile long, y long, x long")).count() == 0

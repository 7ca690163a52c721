"""Map extracts read in parts, and their geometry."""

import re

import pyarrow as pa
import pytest

from plotline.operators import osm
from plotline.sources import osm as sources
from plotline.sources.osm import read_osm

XML = """<?xml version='1.0' encoding='UTF-8'?>
<osm version="0.6" generator="x">
  <!-- a comment with <node id="99" lat="1" lon="1"/> -->
  <bounds minlat="1" minlon="1" maxlat="2" maxlon="2"/>
  <node id="1" lat="59.5" lon="24.5"/>
  <node id='2' lat='59.6' lon='24.25'><tag k='name' v='A "b" &amp;lt; c'/><tag k="shop" v="a"/><tag k="shop" v="b"/></node>
  <node id="3" lon="-24.75" lat="-59.0"/>
  <node id="4" visible="false"/>
  <way id="10" version="2">
    <nd ref="1"/><nd ref="2"/>
    <nd ref="1"/>
    <tag k="highway" v="&lt;res&gt;"/>
  </way>
  <way id="11"><nd ref="1"/><nd ref="7"/><tag k="highway" v="x"/></way>
  <way id="12"><tag k="highway" v="x"/></way>
  <way id="13"><nd ref="3"/><nd ref="1"/></way>
  <relation id="20"><member type="way" ref="11" role="outer"/><member type="node" ref="3" role=""/><member type="relation" ref="21" role=""/><tag k="amenity" v="clinic"/></relation>
  <relation id="21"><member type="relation" ref="20" role=""/><tag k="amenity" v="clinic"/></relation>
  <relation id="22"><member type="way" ref="10" role=""/><member type="way" ref="77" role=""/></relation>
</osm>
"""


@pytest.mark.parametrize("split", ["90b", "128m"])
def test_read_osm(spark, tmp_path, split):
    (tmp_path / "a.osm").write_text(XML)
    (tmp_path / "b.osm").write_text('<osm><node id="1" lat="59.5" lon="24.5"/><way id="10"><nd ref="1"/><nd ref="2"/><nd ref="1"/><tag k="highway" v="&lt;res&gt;"/></way></osm>')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        e = read_osm(spark, str(tmp_path))
        if split == "90b":
            assert spark.read.option("lineSep", ">").text(str(tmp_path)).rdd.getNumPartitions() > 10
        assert sorted(map(tuple, e.coords.collect())) == [(1, 59.5, 24.5), (2, 59.6, 24.25), (3, -59.0, -24.75)]
        assert [(r.id, r.tags) for r in e.nodes.collect()] == [(2, {"name": 'A "b" &lt; c', "shop": "b"})]
        ways = {r.id: (r.refs, r.tags) for r in e.ways.collect()}
        assert ways == {10: ([1, 2, 1], {"highway": "<res>"}), 11: ([1, 7], {"highway": "x"}), 12: ([], {"highway": "x"}), 13: ([3, 1], {})}
        whole = {r.id: [tuple(p) for p in r.geometry] for r in osm.complete_ways(e.ways, e.coords).collect()}
        assert whole == {10: [(59.5, 24.5), (59.6, 24.25), (59.5, 24.5)], 13: [(-59.0, -24.75), (59.5, 24.5)]}
        bounds = {r.id: tuple(r)[1:] for r in osm.relation_bounds(e.relations, e.ways, e.coords).collect()}
        assert bounds == {20: (-59.0, -24.75, 59.5, 24.5), 22: (59.5, 24.25, 59.6, 24.5)}
        assert [r.id for r in e.relations.where(osm.wanted("relation")).collect()].__len__() == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_wanted_and_keys(spark):
    tags = [{"highway": "crossing"}, {"highway": "residential"}, {"highway": ""}, {"entrance": "main"}, {"public_transport": "stop_position"}, {"public_transport": "stop_position", "tram": "yes"},
            {"office": "it"}, {"office": "it", "name": ""}, {"office": "it", "name": "A"}, {"leisure": "sauna", "name": "B"}, {"tourism": "hotel", "craft": "c", "name": "D"}, {"amenity": "cafe"}, {"amenity": "caf"}, {}]
    rows = spark.createDataFrame(list(enumerate(tags)), "id long, tags map<string,string>")
    got = {r.id: r for r in rows.select("id", osm.wanted("node").alias("n"), osm.wanted("way").alias("w"), osm.wanted("relation").alias("r"), osm.poi_key().alias("k")).collect()}
    assert [i for i in got if got[i].n] == [0, 3, 5, 7, 8, 9, 10, 11]
    assert [i for i in got if got[i].w] == [0, 1, 7, 8, 9, 10, 11]
    assert [i for i in got if got[i].r] == [7, 8, 9, 10, 11]
    assert {i: got[i].k for i in got if got[i].k} == {8: "office", 9: "leisure", 10: "craft", 11: "amenity"}


def test_extract_is_read_once(spark, tmp_path):
    (tmp_path / "a.osm").write_text(XML)
    for part in read_osm(spark, str(tmp_path)):
        assert not [f for f in part.inputFiles() if f.endswith("a.osm")]


@pytest.mark.parametrize("size", [1, 2, 7, 100])
def test_long_elements_come_in_pieces(spark, monkeypatch, size):
    monkeypatch.setattr(sources, "MOST", 5)
    refs = lambda lo, hi: [f'\n<nd ref="{i}"/' for i in range(lo, hi)]
    blocks = [("a", 0, ["<osm", "\n<way id='1'", *refs(0, 20), "</way", '<way id="2"/', '<way id="x"', *refs(90, 92)]), ("a", 100, [*refs(92, 95), "</way"]), ("a", 200, ["</a", '<way id="3"', *refs(20, 24)]), ("b", 0, refs(70, 73)), ("b", 9, refs(73, 79))]
    rows = [(value, file, block) for file, block, values in blocks for value in values]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("value", "file", "block"), r, strict=True)) for r in rows[i : i + size]]) for i in range(0, len(rows), size)]
    pieces = spark.createDataFrame(pa.Table.from_batches(sources._gathered(iter(batches))).to_pandas(), "file string, block long, seq long, part string, kind string, id string, lat string, lon string, tags array<struct<k:string,v:string>>, refs array<string>, members array<struct<type:string,ref:string>>")
    whole = {r.id: list(map(int, r.refs)) for r in pieces.where("part = 'way'").collect()}
    joined = {r.id: list(map(int, r.refs)) for r in sources._joined(pieces.where("part = 'part'")).collect()}
    assert not whole.keys() & joined.keys() and len(pieces.where("part = 'part'").collect()) >= 3
    assert {**whole, **joined} == {"1": list(range(20)), "2": [], "x": [90, 91, 92, 93, 94], "3": [20, 21, 22, 23]}


def test_boxes_of_ways_are_made_once(spark, tmp_path):
    (tmp_path / "a.osm").write_text(XML)
    e = read_osm(spark, str(tmp_path))
    plan = osm.relation_bounds(e.relations, e.ways, e.coords)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"keys=\[id#\w+, ref#\w+\]", plan)

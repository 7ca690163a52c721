"""Readers on small files."""

from plotline.sources import readers as R


def test_readers(spark, tmp_path):
    f = lambda name, text, enc="utf-8": (tmp_path / name).write_text(text, encoding=enc) and str(tmp_path / name)
    rows = R.register_csv(spark, f("a.csv", "\ufeffcode;name;n\n1;A;5\n2;B;x\n3;C;7\n4;D\n"), "code long, name string, n long").collect()
    assert sorted((r.code, r.n) for r in rows if r.n) == [(1, 5), (3, 7)] and [(r.code, r.n) for r in rows if r.n is None] == [(2, None)]
    b = R.bilingual_csv(spark, f("b.csv", "Y-tunnus | FO-nummer;Vero | Skatt\n1-2;3,5\n", "latin-1"))
    assert b.columns == ["Y-tunnus", "Vero"] and b.first()[1] == "3,5"
    g = R.gtfs_table(spark, f("stops.txt", "stop_id, stop_name\n 7 , Old town \n"), ["stop_id", "stop_name", "zone"]).first()
    assert (g.stop_id, g.stop_name, g.zone) == ("7", "Old town", None)
    assert R.gtfs_table(spark, str(tmp_path / "absent.txt"), ["trip_id"]).count() == 0
    text = '[\n    {\n        "id": 1,\n        "x": {"y": 2}\n    },\n    {\n        "id": 2,\n        "x": {"y": 3}\n    },\n    {\n        "id": 3,\n        "x": {"y": 4}\n    }\n]\n'
    assert sorted((r.id, r.x.y) for r in R.json_array(spark, f("c.json", text), "id long, x struct<y: long>").collect()) == [(1, 2), (2, 3), (3, 4)]
    x = R.xml_records(spark, f("d.xml", "<all><unit><code>1</code><v>a</v></unit><unit><code>2</code><v>b</v></unit></all>"), "unit", "code long, v string", spark.createDataFrame([(2,)], "code long"), "code").collect()
    assert [(r.code, r.v) for r in x] == [(2, "b")]
    j = '{"features": [{"properties": {"id": 4}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]], [[0, 0], [1, 0], [0, 0]]]}}]}'
    p = R.feature_collection(spark, f("e.json", j), "id long").first()
    assert p.id == 4 and len(p.ring) == 5 and p.ring[2].x == 1.0
    j = '{"features": [{"properties": {"id": 5}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[9, 9], [8, 9], [9, 9]]], [[[5, 5], [7, 5], [7, 7], [5, 5]]]]}}, ' + j[14:]
    far = R.feature_collection(spark, f("m.json", j), "id long", (4, 4, 6, 6)).collect()
    assert [(r.id, len(r.ring), r.ring[1].x) for r in far] == [(5, 4, 7.0)]
    links = "http://h/partial/s1.las\nhttp://h/partial/s1.jpg\nhttp://h/full/s1.las\nhttp://h/full/s1.jpg\nhttp://h/full/s2.las\n"
    assert [tuple(r) for r in R.link_index(spark, f("l.txt", links), ("las", "jpg")).collect()] == [("s1", "http://h/full/s1.las", "http://h/full/s1.jpg")]
    s = {r.year: r.sheets for r in R.sheet_years(spark, f("s.txt", "L4133D1 (2008)\nL4133D2 (2008)\nX (2010)\nbad\n")).collect()}
    assert s == {2008: ["L4133D1", "L4133D2"], 2010: ["X"]}
    R.write_layer(spark.createDataFrame([(1, "a"), (2, "b")], "tile long, v string"), str(tmp_path / "layer"), "credit", "here")
    assert spark.read.parquet(str(tmp_path / "layer")).where("tile = 2").first().v == "b"

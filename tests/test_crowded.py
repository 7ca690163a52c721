"""Many equal rows in one place: answers are the same for all of them, and no pair of rows is made for each two."""

import threading

import pytest
from pyspark.sql import functions as F

from plotline.functions import geometry as G
from plotline.operators import graph, links, match, patterns, raster, regions, roads, spatial

N = 40_000


def rows_of(spark, df, seconds=90):
    """The rows of ``df``, or a failure if its jobs take longer."""
    sc, late = spark.sparkContext, threading.Event()
    sc.addJobTag("crowded")
    timer = threading.Timer(seconds, lambda: (late.set(), sc.cancelJobsWithTag("crowded")))
    timer.start()
    try:
        return df().collect()
    except Exception:
        if late.is_set():
            pytest.fail(f"not done after {seconds} s")
        raise
    finally:
        timer.cancel()
        sc.removeJobTag("crowded")


def copies(spark, at, n=N):
    """tile, id, x, z: n rows in one place."""
    x, z = at
    return spark.range(n).select(F.lit(1).cast("long").alias("tile"), "id", F.lit(x).cast("long").alias("x"), F.lit(z).cast("long").alias("z"))


def squares(rows, side):
    return rows.select("tile", F.col("id").alias("polygon"), G.square(F.col("x"), F.col("z"), F.lit(side)).alias("ring"))


def summary(rows, *columns):
    return len(rows), {tuple(r[c] for c in columns) for r in rows}


def test_point_in_polygon(spark):
    points = copies(spark, (5, 5)).withColumnRenamed("id", "point")
    got = rows_of(spark, lambda: spatial.point_in_polygon(points, squares(copies(spark, (0, 0)), 10)))
    assert summary(got, "polygon") == (N, {(0,)}) and len({r.point for r in got}) == N


def test_without_points(spark):
    rings = squares(copies(spark, (0, 0)).unionByName(copies(spark, (100, 0), 3)), 10)
    got = rows_of(spark, lambda: spatial.without_points(rings, copies(spark, (5, 5))))
    assert sorted(r.polygon for r in got) == [0, 1, 2]


def test_home_of_points(spark):
    points = copies(spark, (13, 5)).withColumnRenamed("id", "point")
    got = rows_of(spark, lambda: spatial.home_of_points(points, squares(copies(spark, (0, 0)), 10), 8.0))
    assert summary(got, "polygon", "d") == (N, {(0, 3.0)})


def test_nearest(spark):
    got = rows_of(spark, lambda: spatial.nearest(copies(spark, (0, 0)), copies(spark, (3, 4)), 80))
    assert summary(got, "right", "d2") == (N, {(0, 25)})


def test_nearest_k(spark):
    right = copies(spark, (3, 4)).unionByName(copies(spark, (4, 3), 2).withColumn("id", -1 - F.col("id"))).unionByName(copies(spark, (1, 0), 1).withColumn("id", F.lit(9).cast("long")))
    got = rows_of(spark, lambda: spatial.nearest_k(copies(spark, (0, 0)), right, 200, 4))
    assert summary(got, "right", "d2", "rank") == (4 * N, {(9, 1, 1), (-2, 25, 2), (-1, 25, 3), (0, 25, 4)})


def test_largest_overlap(spark):
    box = lambda at, w: copies(spark, at).select("tile", "id", F.col("x").alias("xmin"), F.col("z").alias("zmin"), (F.col("x") + w).alias("xmax"), (F.col("z") + w).alias("zmax"))
    got = rows_of(spark, lambda: spatial.largest_overlap(box((0, 0), 10), box((5, 5), 10), 0.1))
    assert summary(got, "b", "overlap") == (N, {(0, 25)})


def test_nearest_segment_and_arclength(spark):
    lines = copies(spark, (0, 0)).select("tile", F.col("id").alias("rid"), F.col("x").alias("ax"), F.col("z").alias("az"), (F.col("x") + 10).alias("bx"), F.col("z").alias("bz"), F.lit(4).alias("width"))
    got = rows_of(spark, lambda: spatial.nearest_segment(copies(spark, (4, 3)), lines, 25.0))
    assert summary(got, "rid", "d", "side") == (N, {(0, 3.0, 1)})
    lines = lines.drop("width").withColumnRenamed("rid", "line").withColumn("cum", F.lit(10.0))
    got = rows_of(spark, lambda: spatial.nearest_arclength(copies(spark, (4, 3)), lines, 25.0))
    assert summary(got, "line", "s", "d") == (N, {(0, 14.0, 3.0)})


def test_thinned_stops(spark):
    stop = lambda df: df.select("tile", "id", F.lit("bus").alias("kind"), F.lit(None).cast("string").alias("name"), "x", "z")
    nowhere = copies(spark, (0, 0), 2).withColumns({"id": F.col("id") + 2 * N, "x": F.lit(None).cast("long")})
    stops = stop(copies(spark, (0, 0)).unionByName(copies(spark, (10, 0)).withColumn("id", F.col("id") + N)).unionByName(nowhere))
    got = rows_of(spark, lambda: spatial.thinned_stops(stops, 15.0))
    assert sorted(r.id for r in got) == [0, 2 * N, 2 * N + 1]


def test_entrances(spark):
    doors = copies(spark, (3, 4)).withColumn("main", F.col("id") == 7)
    got = rows_of(spark, lambda: spatial.entrance_of_points(copies(spark, (0, 0)), doors, 60.0))
    assert summary(got, "right", "d2") == (N, {(7, 25)})


def test_straightest_next(spark):
    line = lambda a, b, first: copies(spark, a).select("tile", (F.col("id") + first).alias("rid"), F.col("x").alias("ax"), F.col("z").alias("az"), F.lit(b[0]).cast("long").alias("bx"), F.lit(b[1]).cast("long").alias("bz"))
    segments = line((0, 0), (10, 0), 0).unionByName(line((10, 0), (20, 0), N)).unionByName(line((10, 0), (10, 9), 2 * N))
    got = rows_of(spark, lambda: roads.straightest_next(segments))
    assert summary(got, "next") == (N, {(N,)}) and max(r.rid for r in got) == N - 1


def test_directions(spark):
    line = lambda z, first: spark.range(N // 2).select(F.lit(1).cast("long").alias("tile"), (F.col("id") + first).alias("rid"), F.lit("tram").alias("kind"), F.expr(f"array(named_struct('x', 0.0D, 'z', {z}D), named_struct('x', 20.0D, 'z', {z}D))").alias("line"))
    got = rows_of(spark, lambda: graph.allowed_directions(line(0.0, 0).unionByName(line(3.0, N))))
    assert summary([r for r in got if r.rid < N], "allowed") == (N // 2, {(-1,)}) and summary([r for r in got if r.rid >= N], "allowed") == (N // 2, {(1,)})


def test_name_matches(spark):
    names = lambda words, key, tokens: spark.range(N // 2).select(F.col("id").alias(key), F.lit("b").alias("block"), F.array(*map(F.lit, words)).alias(tokens))
    got = rows_of(spark, lambda: match.name_matches(names(("kesk", "pood"), "left_id", "left_tokens"), names(("pood", "uus"), "right_id", "right_tokens").unionByName(names(("kesk", "pood", "uus"), "right_id", "right_tokens")), "block"))
    assert summary(got, "right_id", "score") == (N // 2, {(0, 1.0)})


def test_pairs_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(links, "BLOCK", 20)
    monkeypatch.setattr(links, "PAIRS", 1000, raising=False)
    rows = spark.range(200).select((F.col("id") % 2).alias("g"), F.col("id").cast("string").alias("item"))
    got = links.pairs_within(rows, "g", "item").withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 2 * 100 * 99 // 2 and len({r.task for r in got}) > 8


def test_links_of_plots(spark):
    """As ``links`` over all pairs: plots in several entries, shared owners within an entry, and only some plots asked for."""
    entries = [("a", "1"), ("b", "1"), ("c", "1"), ("a", "2"), ("b", "2"), ("d", "2"), ("e", "word"), ("f", None)]
    p = spark.createDataFrame(entries, "tunnus string, land_registry string")
    h = spark.createDataFrame([("o", "a"), ("o", "b"), ("o", "e"), ("q", "a"), ("q", "b"), ("q", "z"), ("r", "f"), ("r", "z"), ("r", "z"), ("s", "y"), ("s", "z")], "owner string, tunnus string")
    for wanted in (p, p.where("tunnus IN ('a', 'f')")):
        want = links.links(links.shared_owner_pairs(h), links.immovable_pairs(p), wanted)
        got = links.links_of_plots(h, p, wanted)
        assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CollectSet" not in plan and "collect_set" not in plan  # pairs of an entry are not gathered


def test_blobs_are_not_sent_through_the_driver(spark):
    """Stored tables of runs are small, their rows are many: no table of blobs is broadcast."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    cells = spark.range(900).selectExpr("1L AS tile", "CAST(id / 30 AS LONG) AS y", "id % 30 AS x").where("x % 10 < 8 AND (y % 10 < 8)")
    assert patterns.split_blobs(raster.components(cells.where("x <> 13 OR y = 3")), 400, 4).count() > 0
    runs = store.executionsList(before, 1000)
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
    assert len(plans) > 5 and not any("BroadcastExchange" in p for p in plans)


def test_lines_are_not_gathered(spark):
    lines = spark.range(50).selectExpr("1L AS tile", "id AS rid", "array(named_struct('x', 0.0D, 'z', 0.0D), named_struct('x', 10.0D + id % 2, 'z', 0.0D)) AS line")
    nodes, edges = graph.build_graph(lines)
    assert sorted((r.x, r.z, r.arms) for r in nodes.collect()) == [(0.0, 0.0, 50), (10.0, 0.0, 25), (11.0, 0.0, 25)] and edges.count() == 50
    assert "hashpartitioning(rid" not in edges._jdf.queryExecution().executedPlan().toString()


def test_main_neighbour(spark):
    tiles = spark.range(N).selectExpr("id AS tile", "'ee' AS country", "0.0D AS xmin", "0.0D AS zmin", "10.0D AS xmax", "10.0D AS zmax")
    land = spark.createDataFrame([("lv", [(5.0, 0.0), (20.0, 0.0), (20.0, 20.0), (5.0, 20.0)])], "country string, ring array<struct<x:double,z:double>>")
    got = rows_of(spark, lambda: regions.main_neighbour(tiles, land))
    assert summary(got, "other", "share") == (N, {("lv", 0.5)}) and len({r.tile for r in got}) == N
    plan = regions.main_neighbour(tiles, land)._jdf.queryExecution().optimizedPlan().toString()
    assert "min(tile" in plan

"""Queries on street and track graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.operators import graph
from plotline.plans.demo import load, with_tables
from plotline.plans.registry import query


def _lines(rows):
    at = lambda a, b: F.struct(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("z"))
    return rows.withColumn("line", F.array(at("ax", "az"), at("bx", "bz"))).drop("ax", "az", "bx", "bz")


#: Ends on a line of one height are one node while gaps are below a metre (heights are 64 m apart here).
_SNAPPED = """s AS (SELECT * FROM street WHERE sqrt(pow(bx - ax, 2) + pow(bz - az, 2)) >= 2), e AS (SELECT rid, tile, 'a' AS e, ax AS x, az AS z FROM s UNION ALL SELECT rid, tile, 'b', bx, bz FROM s),
g AS (SELECT *, CASE WHEN x - lag(x) OVER w < 1 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY tile, z ORDER BY x, rid, e)), c AS (SELECT *, sum(fresh) OVER (PARTITION BY tile, z ORDER BY x, rid, e ROWS UNBOUNDED PRECEDING) AS c FROM g),
n AS (SELECT *, min(x) OVER (PARTITION BY tile, z, c) AS nx FROM c)"""


@query("gr1_nodes", with_tables("street", rest=f"WITH {_SNAPPED} SELECT tile, round(nx, 4) AS x, z, count(*) AS arms FROM n GROUP BY tile, nx, z"))
def gr1_nodes(spark, d):
    nodes, _ = graph.build_graph(_lines(load(spark, d, "street")))
    return nodes.select("tile", F.round("x", 4).alias("x"), "z", "arms")


@query("gr1_edges", with_tables("street", rest=f"WITH {_SNAPPED} SELECT s.rid, round(sqrt(pow(s.bx - s.ax, 2) + pow(s.bz - s.az, 2)), 4) AS length, round((s.ax + s.bx) / 2, 4) AS mx, round((s.az + s.bz) / 2, 4) AS mz, round(a.nx, 4) AS ax, a.z AS az, round(b.nx, 4) AS bx, b.z AS bz FROM s JOIN n a ON a.rid = s.rid AND a.e = 'a' JOIN n b ON b.rid = s.rid AND b.e = 'b'"))
def gr1_edges(spark, d):
    _, edges = graph.build_graph(_lines(load(spark, d, "street")))
    return edges.select("rid", *(F.round(c, 4).alias(c) for c in ("length", "mx", "mz", "ax")), "az", F.round("bx", 4).alias("bx"), "bz")


@query("j15_directions", with_tables("track", rest="""WITH t AS (SELECT *, sqrt(pow(bx - ax, 2) + pow(bz - az, 2)) AS len FROM track), m AS (SELECT *, (ax + bx) / 2 AS mx, (az + bz) / 2 AS mz, (bx - ax) / len AS ux, (bz - az) / len AS uz FROM t),
p AS (SELECT tile, rid, kind, ux, uz, side, mx - uz * side * o AS x, mz + ux * side * o AS z FROM m, (SELECT unnest([-1, 1]) AS side) s, (SELECT unnest([2.4, 3.0, 3.6, 4.2, 4.8]) AS o) q),
c AS (SELECT p.rid, side, x, z, b.ax, b.az, b.bx, b.bz, greatest(0, least(1, ((x - b.ax) * (b.bx - b.ax) + (z - b.az) * (b.bz - b.az)) / (b.len * b.len))) AS u FROM p JOIN m b ON b.tile = p.tile AND b.kind = p.kind AND b.rid <> p.rid WHERE abs(b.ux * p.ux + b.uz * p.uz) >= 0.9),
h AS (SELECT DISTINCT rid, side FROM c WHERE pow(x - ax - u * (bx - ax), 2) + pow(z - az - u * (bz - az), 2) < 0.25)
SELECT m.rid, CAST(CASE WHEN l.rid IS NOT NULL AND r.rid IS NULL THEN 1 WHEN r.rid IS NOT NULL AND l.rid IS NULL THEN -1 ELSE 0 END AS INT) AS allowed FROM m LEFT JOIN h l ON l.rid = m.rid AND l.side = -1 LEFT JOIN h r ON r.rid = m.rid AND r.side = 1"""))
def j15(spark, d):
    return graph.allowed_directions(_lines(load(spark, d, "track")))

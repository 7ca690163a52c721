"""Street and track graphs: ends snapped to nodes, edges with length and middle, parallel twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.operators.spatial import cell, cover
from plotline.session import forget, stored


def connected(edges: DataFrame) -> DataFrame:
    """v, comp (the least vertex of v's component) for the vertices of edges (a, b), of any type that can be ordered.

    Every round each vertex takes the least label around it and then the label of its label, so chains halve; a component, however large, is
    never gathered. Vertices without edges are not returned. Labels are joined by sorting: their stored tables are much smaller than their rows, so that they would be
    sent through the driver else."""
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both, both_path = stored(both, "edges")
    labels, path = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), "labels")
    while True:
        around = both.join(labels.select(F.col("v").alias("b"), "comp").hint("merge"), "b").groupBy(F.col("a").alias("v")).agg(F.min("comp").alias("near"))
        nxt = labels.join(around.hint("merge"), "v").select("v", F.col("comp").alias("was"), F.least("comp", "near").alias("l"))
        jump = labels.select(F.col("v").alias("l"), F.col("comp").alias("further"))
        nxt = nxt.join(jump.hint("merge"), "l").select("v", F.least("l", "further").alias("comp"), "was")
        nxt, nxt_path = stored(nxt.select("v", "comp", (F.col("comp") < F.col("was")).alias("moved")), "labels")
        forget(spark, path)
        labels, path = nxt.select("v", "comp"), nxt_path
        if nxt.where("moved").isEmpty():
            forget(spark, both_path)
            return labels


def snapped(points: DataFrame, radius: float = 1.0) -> DataFrame:
    """tile, x, z, nx, nz for different points (tile, x, z): the node that each belongs to.

    Points less than ``radius`` apart are one node, and so are points that a chain of such points joins: a definition that doesn't depend
    on any order. A node stands at its least point (by x, then z). Points meet in cells of the radius's size."""
    p = points.select("tile", F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z")).distinct()
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    own = p.select("tile", F.struct("tile", "x", "z").alias("a"), cell(F.col("x"), radius).alias("cx"), cell(F.col("z"), radius).alias("cz"))
    asks = own.select("tile", F.col("a").alias("b"), "cx", "cz").withColumn("dx", around).withColumn("dz", around)
    asks = asks.select("tile", "b", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cz") + F.col("dz")).alias("cz"))
    dx, dz = F.col("a.x") - F.col("b.x"), F.col("a.z") - F.col("b.z")
    near = own.join(asks, ["tile", "cx", "cz"]).where((F.col("a") < F.col("b")) & (dx * dx + dz * dz < radius * radius)).select("a", "b")
    comps = connected(near).select(F.col("v.tile").alias("tile"), F.col("v.x").alias("x"), F.col("v.z").alias("z"), F.col("comp.x").alias("nx"), F.col("comp.z").alias("nz"))
    return p.join(comps, ["tile", "x", "z"], "left").select("tile", "x", "z", F.coalesce("nx", "x").alias("nx"), F.coalesce("nz", "z").alias("nz"))


def _steps(line: Column) -> Column:
    """The line's segments with the length up to each one's start."""
    ends = F.zip_with(F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: F.struct(a.x.alias("ax"), a.z.alias("az"), b.x.alias("bx"), b.z.alias("bz")))
    none = F.array().cast("array<struct<ax:double,az:double,bx:double,bz:double,cum:double,len:double>>")

    def add(acc: Column, s: Column) -> Column:
        n = F.sqrt((s.bx - s.ax) * (s.bx - s.ax) + (s.bz - s.az) * (s.bz - s.az))
        cum = F.when(F.size(acc) > 0, F.try_element_at(acc, F.lit(-1)).cum + F.try_element_at(acc, F.lit(-1)).len).otherwise(0.0)
        return F.concat(acc, F.array(F.struct(s.ax.alias("ax"), s.az.alias("az"), s.bx.alias("bx"), s.bz.alias("bz"), cum.alias("cum"), n.alias("len"))))

    return F.aggregate(ends, none, add)


def with_middle(lines: DataFrame) -> DataFrame:
    """``lines`` (line ARRAY<STRUCT<x, z>> of doubles) with steps, length, mx, mz (the middle) and ux, uz (the direction there). Lines without
    length have no middle."""
    x = lines.withColumn("steps", _steps(F.col("line")))
    last = F.try_element_at("steps", F.lit(-1))
    x = x.withColumn("length", F.when(F.size("steps") > 0, last.cum + last.len).otherwise(0.0))
    half = F.col("length") / 2
    at = F.get(F.filter("steps", lambda s: (s.len > 0) & (s.cum <= half) & (half <= s.cum + s.len)), F.lit(0))
    x = x.withColumn("_s", at).withColumn("_u", (half - F.col("_s.cum")) / F.col("_s.len"))
    along = lambda c: F.col(f"_s.b{c}") - F.col(f"_s.a{c}")
    x = x.withColumns({"mx": F.col("_s.ax") + F.col("_u") * along("x"), "mz": F.col("_s.az") + F.col("_u") * along("z"), "ux": along("x") / F.col("_s.len"), "uz": along("z") / F.col("_s.len")})
    return x.drop("_s", "_u")


def build_graph(lines: DataFrame, radius: float = 1.0, least: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(nodes: tile, x, z, arms; edges: the lines (tile, rid, line) at least ``least`` long with length, mx, mz and the places of both nodes ax, az,
    bx, bz). ``arms`` counts the ends that meet in a node; a line that ends where it begins has two there. Ends in one place are counted before they
    meet their node, and a line brings its ends to the table of places, so lines are not gathered."""
    e = with_middle(lines).where((F.size("line") > 1) & (F.col("length") >= least)).drop("steps")
    first, last = F.try_element_at("line", F.lit(1)), F.try_element_at("line", F.lit(-1))
    ends = e.select("tile", F.explode(F.array(first, last)).alias("p")).select("tile", "p.x", "p.z").groupBy("tile", "x", "z").agg(F.count("*").alias("n"))
    ends, _ = stored(ends, "ends")
    node_of, _ = stored(snapped(ends, radius), "snapped")
    nodes = ends.join(node_of, ["tile", "x", "z"]).groupBy("tile", F.col("nx").alias("x"), F.col("nz").alias("z")).agg(F.sum("n").alias("arms"))
    edges = e
    for name, at in (("a", first), ("b", last)):
        own = node_of.select(F.col("tile").alias("_t"), F.col("x").alias("_x"), F.col("z").alias("_z"), F.col("nx").alias(f"{name}x"), F.col("nz").alias(f"{name}z"))
        edges = edges.join(own, (F.col("tile") == F.col("_t")) & (at.x == F.col("_x")) & (at.z == F.col("_z"))).drop("_t", "_x", "_z")
    return nodes, edges.select("rid", *(c for c in e.columns if c != "rid"), "ax", "az", "bx", "bz")


# How far beside a track's middle its twin is looked for, how near it must be there, and how parallel.
TWIN_STEPS, TWIN_REACH, TWIN_COSINE = (2.4, 3.0, 3.6, 4.2, 4.8), 0.5, 0.9


def allowed_directions(tracks: DataFrame, size: float = 16.0) -> DataFrame:
    """rid, allowed for tracks (tile, rid, kind, line): 1 (forward only) with a twin on the left, -1 with one on the right, 0 with none or both.

    A twin is a segment of another track of the kind that passes within half a metre of a place 2.4 to 4.8 m beside the middle, in nearly the
    same direction or its opposite. The ten places of a track and the cells of all segments meet by equi-join. Tracks of one kind along one line meet others once, all
    together; each is a twin of the rest, should the line pass beside its own middle."""
    alike = tracks.where(F.size("line") > 1).groupBy("tile", "kind", "line").agg(F.min("rid").alias("rid"), (F.count("*") > 1).alias("several"))
    t, t_path = stored(with_middle(alike).where("length > 0"), "tracks")
    side = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.lit(o).alias("o")) for s in (-1, 1) for o in TWIN_STEPS)))
    p = t.select("tile", "rid", "kind", "mx", "mz", "ux", "uz", side.alias("q"))
    p = p.select("tile", "rid", "kind", "ux", "uz", "q.side", (F.col("mx") - F.col("uz") * F.col("q.side") * F.col("q.o")).alias("x"), (F.col("mz") + F.col("ux") * F.col("q.side") * F.col("q.o")).alias("z"))
    p = p.withColumns({"cx": cell(F.col("x"), size), "cz": cell(F.col("z"), size)})
    s = t.select("tile", "kind", F.col("rid").alias("other"), "several", F.explode("steps").alias("s")).select("tile", "kind", "other", "several", "s.*").where("len > 0")
    reach = lambda f, a, b, by: f(F.col(a), F.col(b)) + by
    s = cover(s, reach(F.least, "ax", "bx", -TWIN_REACH), reach(F.least, "az", "bz", -TWIN_REACH), reach(F.greatest, "ax", "bx", TWIN_REACH), reach(F.greatest, "az", "bz", TWIN_REACH), size)
    dx, dz = F.col("bx") - F.col("ax"), F.col("bz") - F.col("az")
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("ax")) * dx + (F.col("z") - F.col("az")) * dz) / (F.col("len") * F.col("len"))))
    ex, ez = F.col("x") - F.col("ax") - u * dx, F.col("z") - F.col("az") - u * dz
    parallel = F.abs(dx * F.col("ux") + dz * F.col("uz")) >= TWIN_COSINE * F.col("len")
    hit = p.join(s, ["tile", "kind", "cx", "cz"]).where(((F.col("rid") != F.col("other")) | F.col("several")) & parallel & (ex * ex + ez * ez < TWIN_REACH * TWIN_REACH))
    seen = hit.groupBy("rid").agg((F.count_if(F.col("side") == -1) > 0).alias("left"), (F.count_if(F.col("side") == 1) > 0).alias("right"))
    allowed = F.when(F.col("left") & ~F.col("right"), 1).when(F.col("right") & ~F.col("left"), -1).otherwise(0)
    known, _ = stored(t.select("tile", "kind", "line", "rid").join(seen, "rid", "left").select("tile", "kind", "line", allowed.alias("allowed")), "allowed")
    forget(tracks.sparkSession, t_path)
    same = F.col("t.tile").eqNullSafe(F.col("k.tile")) & F.col("t.kind").eqNullSafe(F.col("k.kind")) & (F.col("t.line") == F.col("k.line"))
    return tracks.alias("t").join(known.alias("k"), same).select("t.rid", "k.allowed")

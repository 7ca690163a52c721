"""Connected components of an edge table: contract towards the smallest neighbour, with pointer jumping, until no edge is left.

No component, however large, is gathered anywhere: every step is a join or an aggregation with map-side minima, written to the
shared folder. Vertices without edges are not returned. Repeated edges and loops are harmless; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.session import forget, stored


def components(edges: DataFrame) -> DataFrame:
    """v, comp (the smallest vertex of v's component) for every vertex of ``edges`` (a, b)."""
    spark = edges.sparkSession
    some = edges.where("a <> b").select("a", "b")
    both, both_path = stored(some.union(some.select("b", "a")).distinct(), "edges")
    maps: list[DataFrame] = []
    paths: list[str] = []
    while not both.isEmpty():
        up, path = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")), "up")
        while True:  # jump to p(p(v)) until every vertex knows the end of its chain: the length of chains halves each time
            nxt = up.select(F.col("a").alias("x"), F.col("p").alias("q"))
            further, further_path = stored(up.join(nxt, F.col("p") == F.col("x")).select("a", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "up")
            done = further.where("moved").isEmpty()
            forget(spark, path)
            up, path = further.select("a", "p"), further_path
            if done:
                break
        maps.append(up)
        paths.append(path)
        of = up.select(F.col("a").alias("x"), "p")
        left = both.join(of, F.col("a") == F.col("x")).select(F.col("p").alias("a"), "b")
        left, left_path = stored(left.join(of, F.col("b") == F.col("x")).select("a", F.col("p").alias("b")).where("a <> b").distinct(), "edges")
        forget(spark, both_path)
        both, both_path = left, left_path
    forget(spark, both_path)
    if not maps:
        return spark.createDataFrame([], "v long, comp long")
    labels = maps[-1]
    for m in reversed(maps[:-1]):
        later = labels.select(F.col("a").alias("x"), F.col("p").alias("q"))
        labels = m.join(later, F.col("p") == F.col("x"), "left").select("a", F.coalesce("q", "p").alias("p"))
    labels, _ = stored(labels.select(F.col("a").alias("v"), F.col("p").alias("comp")), "components")
    forget(spark, *paths)
    return labels

"""Place search: scored candidates from several layers, diversified top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotline.functions.text import fold_street, street_of


#: Queries that are asked at once: they are the small side of an equi-join on a gram of two letters.
MOST_ASKED = 10_000


def _few(asked: DataFrame) -> DataFrame:
    """``asked``, to be sent to every task, if it is small enough for that."""
    if asked.count() > MOST_ASKED:
        raise ValueError(f"more than {MOST_ASKED} queries at once")
    return F.broadcast(asked)


def grams(text: Column) -> Column:
    """The different pairs of letters next to each other in a text, its different letters, and ''."""
    two = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(text, ""), two))


def score(haystack: Column, needle: Column) -> Column:
    """4 exact, 3 prefix, 2 substring, 0 otherwise, on folded text; needles under two letters find nothing."""
    h, n = F.trim(fold_street(haystack)), F.trim(fold_street(needle))
    return F.when(F.length(n) < 2, 0).when(h == n, 4).when(F.startswith(h, n), 3).when(F.contains(h, n), 2).otherwise(0)


def streets(parcels: DataFrame) -> DataFrame:
    """street, n, x, z: mean position of a street's plots."""
    return parcels.groupBy(street_of(F.col("address")).alias("street")).agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("z").alias("z"))


def find(asked: DataFrame, layers: dict[str, tuple[DataFrame, int]], limit: int) -> DataFrame:
    """q, place, kind, label for queries (q): layers are kind -> (rows with label, bonus). The best of each kind comes first, then
    the score, then the label. A label is filed under its pairs of letters, and a query looks under its first one, so only labels that
    hold it are scored; of each kind the best ``limit`` go on."""
    n = F.trim(fold_street(F.col("q")))
    found, few = None, _few(asked.withColumn("_g", F.substring(n, 1, 2)).where(F.length(n) > 1))
    best = W.partitionBy("q").orderBy(F.desc("score"), "label")
    for kind, (rows, bonus) in layers.items():
        x = rows.select("label", F.explode(grams(F.trim(fold_street(F.col("label"))))).alias("_g")).join(few, "_g")
        x = x.withColumn("score", score(F.col("label"), F.col("q"))).where("score > 0")
        x = x.withColumn("r", F.row_number().over(best)).where(F.col("r") <= limit)  # in each partition first, then of each query
        x = x.select("q", F.lit(kind).alias("kind"), "label", (F.col("score") + bonus).alias("score"), (F.col("r") == 1).alias("lead"))
        found = x if found is None else found.unionByName(x)
    w = W.partitionBy("q").orderBy(F.desc("lead"), F.desc("score"), "label", "kind")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("q", "place", "kind", "label")


def words_in_key(rows: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """q, place, key: every word of the query is in the key; shorter keys first. Keys are looked up by the first letters of the longest word."""
    words = F.filter(F.split(F.lower("q"), r"\s+"), lambda w: w != "")
    longest = F.coalesce(F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"], F.lit(""))
    few = _few(asked.withColumn("words", words).withColumn("_g", F.substring(longest, 1, 2)))
    x = rows.select("key", F.explode(grams(F.lower("key"))).alias("_g")).join(few, "_g").where(F.forall("words", lambda w: F.contains(F.lower("key"), w)))
    w = W.partitionBy("q").orderBy(F.length("key"), "key")
    return x.select("q", "key").distinct().withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("q", "place", "key")


def addresses_starting(rows: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """q, place, name for queries (q, town): distinct names of addresses (first, second, town: two languages) that start with the query, in
    the town if one is asked for; the second language's name if only that starts with it. Addresses are filed under their first two letters."""
    starts = lambda c: F.startswith(fold_street(F.col(c)), fold_street(F.col("q")))
    heads = lambda c: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.substring(fold_street(F.coalesce(F.col(c), F.lit(""))), F.lit(1), k))
    filed = rows.withColumnRenamed("town", "at").withColumn("_g", F.explode(F.array_distinct(F.concat(heads("first"), heads("second")))))
    few = _few(asked.withColumn("_g", F.substring(fold_street(F.col("q")), 1, 2)))
    x = filed.join(few, "_g").where((starts("first") | starts("second")) & (F.col("town").isNull() | F.startswith(F.lower("at"), F.lower("town"))))
    name = F.concat_ws(", ", F.when(~starts("first"), F.col("second")).otherwise(F.col("first")), F.initcap("at"))
    x = x.select("q", name.alias("name")).distinct()
    return x.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy("name"))).where(F.col("place") <= limit).select("q", "place", "name")

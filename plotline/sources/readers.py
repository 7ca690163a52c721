"""Readers of register dumps: delimited tables, timetables, large JSON arrays, XML records, link lists and sheet indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def register_csv(spark: SparkSession, path: str, schema: str, sep: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """Delimited dump with a header. Rows with fewer fields than the header are left out; a field that doesn't fit its type is null."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    text = ", ".join(f"`{n}` string" for n in names)
    rows = spark.read.schema(text).option("sep", sep).option("header", True).option("encoding", encoding).option("mode", "DROPMALFORMED").option("enforceSchema", True).csv(path)
    kinds = [c.strip().split(None, 1)[1] for c in schema.split(",")]
    return rows.select(*(F.col(n).try_cast(k).alias(n) for n, k in zip(names, kinds, strict=True)))


def bilingual_csv(spark: SparkSession, path: str, sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """Headers of the form 'name | namn' keep their first half; decimal commas stay text until a number rule reads them."""
    rows = spark.read.option("sep", sep).option("header", True).option("encoding", encoding).csv(path)
    return rows.toDF(*(c.split("|")[0].strip() for c in rows.columns))


def gtfs_table(spark: SparkSession, path: str, want: list[str]) -> DataFrame:
    """The wanted columns of a timetable file, trimmed; columns that the file lacks are null, and a file that is not there is an empty table."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in want))
    rows = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    rows = rows.toDF(*(c.strip().lstrip("\ufeff") for c in rows.columns))
    return rows.select(*(F.trim(c).alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in want))


def json_array(spark: SparkSession, path: str, schema: str, indent: int = 4) -> DataFrame:
    """Objects of one huge pretty-printed array, split at the objects' closing lines so that tasks read parts of the file; objects
    that don't parse are left out."""
    close = "\n" + " " * indent + "},\n"
    text = spark.read.option("lineSep", close).text(path)
    body = F.trim(F.regexp_replace(F.regexp_replace("value", r"^\s*\[\s*", ""), r"\s*\]\s*$", ""))
    whole = F.when(F.endswith(F.rtrim("value"), F.lit("]")), body).otherwise(F.concat(body, F.lit("}")))
    row = F.from_json(whole, schema, {"mode": "PERMISSIVE"})
    first = F.col("row")[schema.replace(",", " ").split()[0]]
    return text.select(row.alias("row")).where(first.isNotNull()).select("row.*")


def xml_records(spark: SparkSession, path: str, tag: str, schema: str, wanted: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Records of one tag; with ``wanted`` only those whose key is in it."""
    rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    return rows if wanted is None else rows.join(wanted.select(key), key, "left_semi")


def feature_collection(spark: SparkSession, path: str, properties: str, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """properties.*, ring ARRAY<STRUCT<x, z>> (the longest ring of a polygon or multipolygon) of a feature collection; with ``bbox`` (xmin,
    zmin, xmax, zmax) only those whose ring's envelope meets it."""
    schema = f"features array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    rings, text = "array<array<array<double>>>", F.col("f.geometry.coordinates")
    of = F.when(F.col("f.geometry.type") == "MultiPolygon", F.flatten(F.from_json(text, f"array<{rings}>"))).otherwise(F.from_json(text, rings))
    f = f.withColumn("rings", of)
    longest = F.filter("rings", lambda r: F.size(r) == F.array_max(F.transform("rings", lambda q: F.size(q))))[0]
    out = f.select("f.properties.*", F.transform(longest, lambda p: F.struct(p[0].alias("x"), p[1].alias("z"))).alias("ring"))
    if bbox is None:
        return out
    lo, hi = (lambda c: F.array_min(F.transform("ring", lambda p: p[c]))), (lambda c: F.array_max(F.transform("ring", lambda p: p[c])))
    return out.where((lo("x") <= bbox[2]) & (hi("x") >= bbox[0]) & (lo("z") <= bbox[3]) & (hi("z") >= bbox[1]))


def link_index(spark: SparkSession, path: str, extensions: tuple[str, str], partial: str = "partial") -> DataFrame:
    """stem and a column for each extension from a list of links; both files must be there, and complete folders are preferred."""
    ext = "|".join(extensions)
    links = spark.read.text(path).select(F.trim("value").alias("url"))
    parts = links.select("url", F.regexp_extract("url", r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract("url", rf"([^/]+)\.(?:{ext})$", 1).alias("stem"), F.regexp_extract("url", rf"\.({ext})$", 1).alias("ext")).where("stem <> ''")
    wide = parts.groupBy("stem", "folder").pivot("ext", list(extensions)).agg(F.min("url")).dropna()
    w = W.partitionBy("stem").orderBy(F.contains(F.lower("folder"), F.lit(partial)), "folder")
    return wide.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "folder")


def sheet_years(spark: SparkSession, path: str) -> DataFrame:
    """year, sheets of an index with lines like 'L4133D1 (2008)'."""
    line = spark.read.text(path)
    rows = line.select(F.regexp_extract("value", r"^\s*(\w+)\s*\(", 1).alias("sheet"), F.regexp_extract("value", r"\((\d{4})\)", 1).try_cast("int").alias("year")).where("year IS NOT NULL").distinct()
    return rows.groupBy("year").agg(F.array_sort(F.collect_list("sheet")).alias("sheets"))


def write_layer(rows: DataFrame, path: str, attribution: str, source: str) -> None:
    """A layer by tile, with its credit lines in every file's columns."""
    rows.withColumns({"attribution": F.lit(attribution), "source": F.lit(source)}).write.partitionBy("tile").mode("overwrite").parquet(path)

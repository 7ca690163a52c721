"""Map extracts in XML (nodes, ways with references, relations with members), read in parts by any number of tasks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotline.session import new_path

KINDS, CHILDREN = ("node", "way", "relation"), ("tag", "nd", "member")
#: Tags that an element may gather in a task before it is passed on in pieces.
MOST = 100_000


class Extract(NamedTuple):
    """coords (id, lat, lon) of all nodes; nodes (id, lat, lon, tags) of those with tags; ways (id, refs, tags); relations (id, members
    ARRAY<STRUCT<type, ref>>, tags). Elements without tags have an empty map."""

    coords: DataFrame
    nodes: DataFrame
    ways: DataFrame
    relations: DataFrame


_TAG = pa.struct([("k", pa.string()), ("v", pa.string())])
_MEMBER = pa.struct([("type", pa.string()), ("ref", pa.string())])
_PIECE = pa.schema([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("part", pa.string()), ("kind", pa.string()), ("id", pa.string()), ("lat", pa.string()), ("lon", pa.string()), ("tags", pa.list_(_TAG)), ("refs", pa.list_(pa.string())), ("members", pa.list_(_MEMBER))])


def _attribute(values: pa.Array, name: str) -> pa.Array:
    """The values of an attribute of each row's tag, without their entities; null where it isn't there."""
    found = pc.extract_regex(values, rf"""(?s)[\s'"]{name}\s*=\s*(?:"(?P<d>[^"]*)"|'(?P<s>[^']*)')""")
    text = pc.binary_join_element_wise(pc.struct_field(found, "d"), pc.struct_field(found, "s"), "")  # the other one is empty
    if len(text) and pc.any(pc.match_substring(text, "&"), skip_nulls=True).as_py():
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):  # the ampersand last
            text = pc.replace_substring(text, entity, char)
    return text


def _pieces(values: pa.Array, names: np.ndarray, file: str, block: int, seq: int, whole: int) -> pa.RecordBatch:
    """A row for what stands before the first element, and one for each element; the first row and those from ``whole`` on are in part."""
    starts = np.flatnonzero(np.isin(names, KINDS))
    n = len(starts)
    of = np.cumsum(np.isin(names, KINDS))

    def lists(name: str, columns: tuple[str, ...], fields: list[str]) -> pa.Array:
        at = np.flatnonzero(names == name)
        rows = values.take(pa.array(at))
        got = [_attribute(rows, c) for c in columns]
        flat = pa.StructArray.from_arrays(got, fields) if len(fields) > 1 else got[0]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(of[at], minlength=n + 1))]), pa.int32()), flat)

    first = pa.nulls(1, pa.string())
    heads = values.take(pa.array(starts))
    own = [pa.concat_arrays([first, pa.array(names[starts].tolist(), pa.string())]), *(pa.concat_arrays([first, _attribute(heads, c)]) for c in ("id", "lat", "lon"))]
    part = np.array(["part", *names[starts]], object)
    part[whole + 1 :] = "part"
    children = [lists("tag", ("k", "v"), ["k", "v"]), lists("nd", ("ref",), ["ref"]), lists("member", ("type", "ref"), ["type", "ref"])]
    return pa.RecordBatch.from_arrays([pa.array([file] * (n + 1), pa.string()), pa.array([block] * (n + 1), pa.int64()), pa.array(range(seq, seq + n + 1), pa.int64()), pa.array(part, pa.string()), *own, *children], schema=_PIECE)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are tags in the order of their file, block by block. An element whose next element begins in the same block is whole; what stands before
    a block's first element, its last one, and one that gathers more than ``MOST`` tags come in part, numbered by ``seq``."""
    at, seq, kept, kept_names = None, 0, None, None

    def rest() -> Iterator[pa.RecordBatch]:
        if kept is not None and len(kept):
            yield _pieces(kept, kept_names, *at, seq, 0)

    for b in batches:
        b = b.filter(pc.match_substring(b.column("value"), "<"))
        if not b.num_rows:
            continue
        values, files, blocks = b.column("value"), b.column("file"), b.column("block").to_numpy()
        names = pc.fill_null(pc.struct_field(pc.extract_regex(values, r"<\s*(?P<name>[a-z]+)[^<]*\z"), "name"), "")
        good = pc.and_(pc.is_in(names, pa.array(KINDS + CHILDREN)), pc.invert(pc.match_substring(values, "<!--")))
        names = np.where(good.to_numpy(zero_copy_only=False), names.to_numpy(zero_copy_only=False), "").astype("U8")
        new = (blocks[1:] != blocks[:-1]) | pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(new) + 1), len(names)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            here = (files[lo].as_py(), int(blocks[lo]))
            if here != at:
                yield from rest()
                at, seq, kept, kept_names = here, 0, None, None
            keep = lo + np.flatnonzero(names[lo:hi] != "")
            some, some_names = values.take(pa.array(keep)), names[keep]
            if kept is not None:
                some, some_names = pa.concat_arrays([kept, some]), np.concatenate([kept_names, some_names])
            starts = np.flatnonzero(np.isin(some_names, KINDS))
            last = int(starts[-1]) if len(starts) else 0
            if last:  # before it, elements are whole
                yield _pieces(some[:last], some_names[:last], *at, seq, len(starts) - 1)
                seq += len(starts)
            kept, kept_names = some[last:], some_names[last:]
            if len(kept) > MOST:
                yield _pieces(kept, kept_names, *at, seq, 0)
                seq, kept, kept_names = seq + 2, None, None
    yield from rest()


def _pieces_of(spark: SparkSession, path: str) -> DataFrame:
    """The elements of all files, whole or in pieces (part = 'part'), each file read once and stored.

    Files are read as text that ends at each '>', so they can be split anywhere between tags. Inside a block of a file an element's children
    follow it, so a task gathers them as it reads. Children at a block's head belong to the last element that begins in a block before; only
    such pieces, two rows of a block, meet by file. Writers of extracts write '>' inside values as an entity; a file that doesn't would lose
    those values only."""
    raw = spark.read.option("lineSep", ">").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    kind = "file string, block long, seq long, part string, kind string, id string, lat string, lon string, tags array<struct<k:string,v:string>>, refs array<string>, members array<struct<type:string,ref:string>>"
    empty = (F.col("kind").isNull() & (F.size("tags") == 0) & (F.size("refs") == 0) & (F.size("members") == 0))
    rows = raw.mapInArrow(_gathered, kind).where(~empty)
    number = lambda c, to: F.col(c).try_cast(to).alias(c)
    members = F.transform("members", lambda m: F.struct(m.type.alias("type"), m.ref.try_cast("long").alias("ref")))
    rows = rows.select("file", "block", "seq", "kind", number("id", "long"), number("lat", "double"), number("lon", "double"), "tags", F.transform("refs", lambda r: r.try_cast("long")).alias("refs"), members.alias("members"), "part")
    to = new_path(spark, "elements")
    rows.write.partitionBy("part").parquet(to)
    return spark.read.schema(rows.schema).parquet(to)


def _joined(pieces: DataFrame) -> DataFrame:
    """Elements that come in pieces, put together."""
    start = F.when(F.col("kind").isNotNull(), F.struct("block", "seq"))
    p = pieces.withColumn("start", F.last(start, ignorenulls=True).over(W.partitionBy("file").orderBy("block", "seq"))).where("start IS NOT NULL")
    e = p.groupBy("file", "start").agg(F.min_by(F.struct("kind", "id", "lat", "lon"), F.struct("block", "seq")).alias("e"), F.array_sort(F.collect_list(F.struct("block", "seq", "tags", "refs", "members"))).alias("p"))
    return e.select("e.*", *(F.flatten(F.col(f"p.{c}")).alias(c) for c in ("tags", "refs", "members")))


def read_osm(spark: SparkSession, path: str) -> Extract:
    """The elements of one or more extracts. An element that several files hold counts once; of a tag that is given twice the last counts. Elements
    without an id and nodes without a place are left out."""
    pieces = _pieces_of(spark, path)
    joined = _joined(pieces.where("part = 'part'").drop("part"))
    of = lambda kind: pieces.where(F.col("part") == kind).select(*joined.columns).unionByName(joined.where(F.col("kind") == kind)).where("id IS NOT NULL")
    nodes = of("node").where("lat IS NOT NULL AND lon IS NOT NULL")
    coords = nodes.groupBy("id").agg(F.min(F.struct("lat", "lon")).alias("p")).select("id", "p.lat", "p.lon")
    last = F.filter("tags", lambda t, i: t.k.isNotNull() & ~F.exists(F.slice("tags", i + 2, F.greatest(F.size("tags") - i - 1, F.lit(0))), lambda o: o.k == t.k))
    tags = F.map_from_entries(F.transform(last, lambda t: F.struct(t.k.alias("key"), F.coalesce(t.v, F.lit("")).alias("value")))).alias("tags")
    once = lambda e, *cols: e.dropDuplicates(["id"]).select("id", *cols)
    return Extract(coords, once(nodes.where("cardinality(tags) > 0"), "lat", "lon", tags).where("cardinality(tags) > 0"), once(of("way"), "refs", tags), once(of("relation"), "members", tags))

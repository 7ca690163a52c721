"""Files of fixed-length records, read in ranges by any number of tasks: laser points and float rasters; and their writers.

Spark lists the files and their sizes (the contents are not read for that). Each range of a file's records is a row that a task opens at its place, so a
large file is read by many tasks, and a lost one reads its range again. Decoding is one array view of a range. Files are opened through Arrow's file
systems: local folders, and the stores that Arrow knows by the scheme of the path."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records of one range.
RANGE = 200_000
# Fixed values of the point format: signature, header length, and where the header holds the offset of the points, their format, record
# length and number, scales and offsets; where a record holds its coordinates, its returns and its class (five bits).
SIGNATURE, HEADER = b"LASF", 227
AT_OFFSET, AT_FORMAT, AT_LENGTH, AT_COUNT, AT_SCALE, AT_SHIFT = 96, 104, 105, 107, 131, 155
POINT = np.dtype({"names": ["x", "y", "z", "returns", "cls"], "formats": ["<i4", "<i4", "<i4", "u1", "u1"], "offsets": [0, 4, 8, 14, 15]})


def _open(path: str):
    """(file system, path) of a path as Spark names it."""
    if "://" not in path and path.startswith("file:/"):
        path = path.removeprefix("file:")
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def _read(path: str, at: int, size: int) -> bytes:
    fs, name = _open(path)
    with fs.open_input_file(name) as f:
        f.seek(at)
        return f.read(size)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """path, length of the files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def _ranges(files: DataFrame) -> DataFrame:
    """A row for each range: first and n records of a file (path, ..., count), dealt to tasks evenly."""
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("count") - 1, F.lit(0)), F.lit(RANGE).cast("long")))
    rows = files.where("count > 0").withColumn("first", first).withColumn("n", F.least(F.col("count") - F.col("first"), F.lit(RANGE)))
    return rows.repartition(min(max(1, rows.count()), 1 << 15), F.col("path"), F.col("first"))  # a number, as the rows are too small to tell


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """file, point (its number), x, y, z, n_returns, cls of laser files of versions 1.0 to 1.3 with point formats 0 to 5. Coordinates are scaled and shifted as the
    file's header says; classes are the lower five bits. Other files, and files that are shorter than their header says, raise."""

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), strict=True):
                head = _read(name, 0, HEADER)
                number = lambda kind, at, n=1, head=head: np.frombuffer(head, kind, n, at).tolist()
                if head[:4] != SIGNATURE or len(head) < HEADER or head[AT_FORMAT] & 0x3F > 5:
                    raise ValueError(f"{name} is no file of laser points of a known format")
                (offset,), (record,), (count,) = number("<u4", AT_OFFSET), number("<u2", AT_LENGTH), number("<u4", AT_COUNT)
                if offset + record * count > length:
                    raise ValueError(f"{name} ends before its last point")
                rows.append((name, offset, record, count, number("<f8", AT_SCALE, 3), number("<f8", AT_SHIFT, 3)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["path", "offset", "record", "count", "scale", "shift"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():  # a row for each range
                kind = np.dtype({"names": POINT.names, "formats": [POINT[n] for n in POINT.names], "offsets": [POINT.fields[n][1] for n in POINT.names], "itemsize": r["record"]})
                p = np.frombuffer(_read(r["path"], r["offset"] + r["first"] * r["record"], r["n"] * r["record"]), kind)
                at = [pa.array(p[c] * r["scale"][i] + r["shift"][i]) for i, c in enumerate("xyz")]
                file = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(p), np.int32)), pa.array([r["path"]])).dictionary_decode()
                yield pa.RecordBatch.from_arrays([file, pa.array(np.arange(len(p)) + r["first"]), *at, pa.array((p["returns"] >> 3 & 7).astype(np.int32)), pa.array((p["cls"] & 0x1F).astype(np.int32))], names=["file", "point", "x", "y", "z", "n_returns", "cls"])

    files = _files(spark, path).mapInArrow(headers, "path string, offset long, record long, count long, scale array<double>, shift array<double>")
    return _ranges(files).mapInArrow(decode, "file string, point long, x double, y double, z double, n_returns int, cls int")


def write_points(points: DataFrame, path: str, scale: float = 0.01) -> None:
    """Laser files of format 0, one for each partition with rows (x, y, z, n_returns, cls), under ``path``; coordinates are rounded to ``scale``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, parts = TaskContext.get(), []
        for b in batches:
            p = np.zeros(b.num_rows, np.dtype({"names": POINT.names, "formats": [POINT[n] for n in POINT.names], "offsets": [POINT.fields[n][1] for n in POINT.names], "itemsize": 20}))
            for c in "xyz":
                p[c] = np.rint(b.column(c).to_numpy() / scale)
            p["returns"], p["cls"] = b.column("n_returns").to_numpy().astype(np.uint8) << 3, b.column("cls").to_numpy().astype(np.uint8)
            parts.append(p.tobytes())
        body = b"".join(parts)
        head = bytearray(HEADER)
        head[:4], head[24:26] = SIGNATURE, b"\x01\x02"
        for at, kind, v in ((94, "<u2", HEADER), (AT_OFFSET, "<u4", HEADER), (AT_LENGTH, "<u2", 20), (AT_COUNT, "<u4", len(body) // 20)):
            raw = np.array(v, kind).tobytes()
            head[at : at + len(raw)] = raw
        head[AT_SCALE : AT_SCALE + 24] = np.full(3, scale, "<f8").tobytes()
        if body:
            fs, folder = _open(path)
            fs.create_dir(folder, recursive=True)
            name = f"part-{context.partitionId():05d}"
            with fs.open_output_stream(f"{folder}/.{name}-{context.taskAttemptId()}") as f:
                f.write(bytes(head) + body)
            fs.move(f"{folder}/.{name}-{context.taskAttemptId()}", f"{folder}/{name}.las")  # a second attempt replaces the first
        yield pa.RecordBatch.from_arrays([pa.array([len(body) // 20])], names=["n"])

    points.select("x", "y", "z", "n_returns", "cls").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def read_raster(spark: SparkSession, path: str, width: int) -> DataFrame:
    """file, y, x, v of rasters of 32-bit floats, row by row and ``width`` wide; cells that are not finite are left out. Files that don't end with a whole
    row raise."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():  # a row for each range
                if r["length"] % (4 * width):
                    raise ValueError(f"{r['path']} does not end with a whole row of {width} cells")
                v = np.frombuffer(_read(r["path"], r["first"] * 4, r["n"] * 4), "<f4")
                at = np.flatnonzero(np.isfinite(v))
                cell = at + r["first"]
                file = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(at), np.int32)), pa.array([r["path"]])).dictionary_decode()
                yield pa.RecordBatch.from_arrays([file, pa.array(cell // width), pa.array(cell % width), pa.array(v[at].astype(np.float64))], names=["file", "y", "x", "v"])

    files = _files(spark, path).withColumn("count", F.floor(F.col("length") / 4).cast("long"))
    return _ranges(files).mapInArrow(decode, "file string, y long, x long, v double")


def write_raster(cells: DataFrame, path: str, width: int, height: int) -> None:
    """A raster of 32-bit floats for each tile (tile, y, x, v) under ``path``, named by the tile; missing and non-finite cells are NaN, of cells given twice the largest counts, and cells outside are left
    out. A tile is one group: its cells are bounded by the raster."""

    def write(t: pa.Table) -> pa.Table:
        tile = t.column("tile")[0].as_py()
        out = np.full((height, width), np.nan, "<f4")
        out[t.column("y").to_numpy(), t.column("x").to_numpy()] = t.column("v").to_numpy()
        fs, folder = _open(path)
        fs.create_dir(folder, recursive=True)
        from pyspark import TaskContext

        attempt = f"{folder}/.{tile}-{TaskContext.get().taskAttemptId()}"
        with fs.open_output_stream(attempt) as f:
            f.write(out.tobytes())
        fs.move(attempt, f"{folder}/{tile}.r32")
        return pa.table({"tile": pa.array([tile], pa.int64())})

    v = F.col("v").cast("double")
    inside = cells.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).groupBy(F.col("tile").cast("long").alias("tile"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).agg(F.max(v).alias("v"))
    inside.groupBy("tile").applyInArrow(write, "tile long").count()

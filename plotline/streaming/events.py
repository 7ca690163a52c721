"""Streams over event files: windows with watermarks, rolling means, duplicate suppression, stream-static joins.

Every query runs over what is there (``availableNow``) with its own checkpoint in the shared folder and returns what it wrote."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plotline.session import new_path


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/events*.parquet")


def collected(stream: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    """Run to the end of the input and read the sink back."""
    spark, out = stream.sparkSession, new_path(stream.sparkSession, f"stream-{tag}")
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).format("parquet").start(out)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def per_window(events: DataFrame, length: str, late: str) -> DataFrame:
    """start, event_type, n, total, highest of tumbling windows that the watermark has closed."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("highest"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total", "highest")


def spikes(events: DataFrame, least: float) -> DataFrame:
    """Stateless filter of large values."""
    return events.where(F.col("value") >= least).select("event_id", "user_id", "event_type", "value")


def with_static(events: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """Stream-static equi-join."""
    return events.join(static, key)


def without_repeats(events: DataFrame) -> DataFrame:
    """user_id, n, kept: how many events came, and how many remain when those of the type before them are dropped. The state of a
    user is the last type and the two counts."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, kept = state.get if state.exists else (None, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind in rows.event_type:
            n, kept, last = n + 1, kept + (kind != last), kind
        state.update((last, n, kept))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "kept": [kept]})

    return events.select("user_id", "ts", "event_id", "event_type").groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, kept long", "last string, n long, kept long", "update", GroupStateTimeout.NoTimeout)


def updates(stream: DataFrame, tag: str, key: str, order: str) -> DataFrame:
    """Run an update-mode stream to its end; the newest row of each key."""
    spark, out = stream.sparkSession, new_path(stream.sparkSession, f"stream-{tag}")
    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(lambda rows, i: rows.write.mode("append").parquet(out)).start()
    q.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(out)
    return rows.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")

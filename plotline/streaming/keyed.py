"""Keyed state: rolling means of the last values, and sessions that begin with a header row and end with the next one or with a timer.

Keys are dealt into buckets by hash, and a bucket's states travel with its rows: a key costs neither a call nor a table of its own, and a task
holds the rows and states of one bucket. State lives in Spark's state store, so a query that is stopped goes on where it was. Rows of a key are taken in order of their time (then id) inside a
micro-batch; batches are taken as they come. Rows that are older than the watermark are late and left out by Spark; so a result equals that of one
batch over all rows if rows come in order of time, however they are cut into batches. Rows without a key or a time are left out."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plotline.session import new_path

#: Buckets of keys; states that are stored belong to this number.
BUCKETS = 2048
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_store(spark: SparkSession):
    """A state store that keeps the states of many keys on disk."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def run_to_end(stream: DataFrame, out: str) -> None:
    """Take what is there, in as many batches as the source makes, and stop; a second call goes on from there."""
    with keyed_store(stream.sparkSession):
        q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).format("parquet").start(out)
        q.awaitTermination()


def collected(stream: DataFrame, tag: str) -> DataFrame:
    spark = stream.sparkSession
    out = new_path(spark, f"stream-{tag}")
    run_to_end(stream, out)
    return spark.read.schema(stream.schema).parquet(out)


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS))


def _by_key(rows: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[object, dict[str, np.ndarray]]]:
    """The columns of each key's rows, in order of time, then id."""
    new = pd.concat(list(rows))
    if not len(new):
        return
    codes, keys = pd.factorize(new[key])
    order = np.lexsort((new["id"].to_numpy(), new["us"].to_numpy(), codes))
    columns = {c: new[c].to_numpy()[order] for c in ("id", "us", "value", "header") if c in new}
    ends = np.cumsum(np.bincount(codes, minlength=len(keys)))
    for k, lo, hi in zip(keys.tolist(), [0, *ends[:-1]], ends, strict=True):
        yield k, {c: v[lo:hi] for c, v in columns.items()}


def _means(values: np.ndarray, most: int, after: int) -> np.ndarray:
    """Means of the last ``most`` values up to each one, from place ``after`` on."""
    first = [values[: i + 1].mean() for i in range(after, min(most - 1, len(values)))]
    rest = np.lib.stride_tricks.sliding_window_view(values, most)[max(after - most + 1, 0) :] if len(values) >= most else np.empty((0, most))
    return np.concatenate([first, *(np.ascontiguousarray(rest[i : i + 10_000]).sum(axis=1) / most for i in range(0, len(rest), 10_000))])


def rolling_means(events: DataFrame, key: str, most: int = 20) -> DataFrame:
    """id, mean of the last ``most`` positive values of the key, this one included, for the rows (key, id, ts, value) with a positive value. The state of a key is a list of at most
    ``most`` values."""
    e = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull() & (F.col("value") > 0)).select(key, "id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    kind = events.schema[key].dataType.simpleString()

    def step(bucket: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, ids, means = {}, [], []
        if state.exists:
            keys, sizes, flat = state.get
            seen = dict(zip(keys, np.split(np.array(flat, float), np.cumsum(sizes)[:-1]), strict=True))
        for k, new in _by_key(rows, key):
            before = seen.get(k, np.empty(0))
            values = np.concatenate([before, new["value"].astype(float)])
            ids.append(new["id"])
            means.append(_means(values, most, len(before)))
            seen[k] = values[-most:]
        state.update((list(seen), [len(v) for v in seen.values()], np.concatenate(list(seen.values())).tolist()))
        yield pd.DataFrame({"id": np.concatenate(ids), "mean": np.concatenate(means)})

    return e.withColumn("bucket", _bucket(key)).groupBy("bucket").applyInPandasWithState(step, "id long, mean double", f"keys array<{kind}>, sizes array<int>, last array<double>", "append", GroupStateTimeout.NoTimeout)


def headed_sessions(events: DataFrame, key: str, gap_us: int, late: str) -> DataFrame:
    """key, started, last (microseconds), n, total of sessions over rows (key, id, ts, value, header): a header row begins one, rows after it belong to it, and it ends
    before the next header, or when nothing follows for ``gap_us``. Rows outside a session (before any header, or after such a gap) belong to
    none. A session is returned when it has ended; one that is open when the input ends, and whose timer the watermark (``late`` behind) hasn't reached,
    stays in the state."""
    kind = events.schema[key].dataType.simpleString()
    e = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    e = e.select(key, "id", "ts", F.unix_micros("ts").alias("us"), F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("header", F.lit(False)).alias("header"))

    def step(bucket: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = {k: tuple(v) for k, *v in zip(*state.get, strict=True)} if state.exists else {}
        ended = []
        for k, new in _by_key(rows, key) if not state.hasTimedOut else ():
            now = open_.pop(k, None)
            for us, value, header in zip(*(new[c].tolist() for c in ("us", "value", "header")), strict=True):
                if now and (header or us - now[1] > gap_us):
                    ended.append((k, *now))
                    now = None
                if header:
                    now = (us, us, 1, value)
                elif now:
                    now = (now[0], us, now[2] + 1, now[3] + value)
            if now:
                open_[k] = now
        reached = state.getCurrentWatermarkMs()
        due = {k: -(-(v[1] + gap_us) // 1000) for k, v in open_.items()}
        ended += [(k, *open_.pop(k)) for k, at in due.items() if at <= reached]
        if open_:
            state.update(([*open_], *map(list, zip(*open_.values(), strict=True))))
            state.setTimeoutTimestamp(max(min(due[k] for k in open_) - 1, reached + 1, 1))  # Spark's timers are over when the watermark is beyond them
        elif state.exists:
            state.remove()
        if ended:
            yield pd.DataFrame(ended, columns=["key", "started", "last", "n", "total"])

    held = f"keys array<{kind}>, started array<long>, last array<long>, n array<long>, total array<double>"
    return e.withColumn("bucket", _bucket(key)).groupBy("bucket").applyInPandasWithState(step, f"key {kind}, started long, last long, n long, total double", held, "append", GroupStateTimeout.EventTimeTimeout)

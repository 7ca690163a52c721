"""Streaming queries over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.plans.demo import load
from plotline.plans.registry import query
from plotline.session import new_path
from plotline.streaming import events as E
from plotline.streaming import keyed as K


@query("st1_per_hour", "WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS highest FROM events GROUP BY ALL) SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def st1(spark, d):
    return E.collected(E.per_window(E.event_stream(spark, d), "1 hour", "1 hour"), "hours").withColumn("total", F.round("total", 4))


@query("st2_spikes", "SELECT event_id, user_id, event_type, value FROM events WHERE value >= 90")
def st2(spark, d):
    return E.collected(E.spikes(E.event_stream(spark, d), 90.0), "spikes")


@query("st3_without_repeats", "WITH x AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, count(*) AS n, count(*) FILTER (before IS DISTINCT FROM event_type) AS kept FROM x GROUP BY 1")
def st3(spark, d):
    return E.updates(E.without_repeats(E.event_stream(spark, d)), "repeats", "user_id", "n")


@query("st5_stream_static", "SELECT event_id, c_mktsegment AS segment FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'purchase'")
def st5(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return E.collected(E.with_static(E.event_stream(spark, d).where("event_type = 'purchase'"), c, "user_id").select("event_id", "segment"), "static")


def _in_order(spark, d, parts: int = 3):
    """A stream of the events that comes in several batches, one stretch of time after the other."""
    e = load(spark, d, "events")
    path = new_path(spark, "events-in-order")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = e.select(F.percentile_approx(at, [i / parts for i in range(1, parts)], 1000).alias("q")).first().q or [0] * (parts - 1)  # any cuts do
    for i in range(parts):
        part = e.where((at >= (cuts[i - 1] if i else F.lit(-(2**63)))) & ((at < cuts[i]) if i < parts - 1 else F.lit(True)))
        part.repartition(2, "user_id").write.mode("append").parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query("st4_rolling_means", "SELECT event_id AS id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS mean FROM events WHERE value > 0")
def st4(spark, d):
    e = _in_order(spark, d).withColumnRenamed("event_id", "id")
    return K.collected(K.rolling_means(e, "user_id"), "rolling").withColumn("mean", F.round("mean", 6))


@query("st6_sessions", """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, coalesce(value, 0) AS value, event_type = 'signup' AS h FROM events), s AS (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER w AS k, us - lag(us) OVER w AS step FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
g AS (SELECT *, sum(CASE WHEN NOT h AND step > 36000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, k ORDER BY us, event_id) AS lost, max(k) OVER (PARTITION BY user_id) AS top, count(*) FILTER (NOT h AND step > 36000000000) OVER (PARTITION BY user_id, k) AS gaps FROM s WHERE k > 0)
SELECT user_id AS key, min(us) AS started, max(us) AS last, count(*) AS n, round(sum(value), 4) AS total FROM g WHERE lost = 0 GROUP BY user_id, k, top, gaps HAVING k < top OR gaps > 0 OR max(us) + 36000000000 <= (SELECT max(us) - 3600000000 FROM e)""")
def st6(spark, d):
    e = _in_order(spark, d).select("user_id", F.col("event_id").alias("id"), "ts", "value", (F.col("event_type") == "signup").alias("header"))
    return K.collected(K.headed_sessions(e, "user_id", 36_000_000_000, "1 hour"), "sessions").withColumn("total", F.round("total", 4))

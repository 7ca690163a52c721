"""Sorts of a table's rows are dealt into as many tasks as the rows need, whatever the session's number of shuffle partitions."""

from pyspark.sql import functions as F

from plotline import session
from plotline.operators import transit
from plotline.plans.demo import load


def calls(spark):
    return spark.range(2000).selectExpr("id % 400 AS trip", "id % 300 AS stop", "CAST(id / 400 AS INT) AS seq", "id * 7 % 1600 AS minute")


def tasks(df):
    return df.withColumn("task", F.spark_partition_id()).select("task").distinct().count()


def test_board_and_thinned(spark, monkeypatch):
    trips = spark.range(400).selectExpr("id AS trip", "CAST(id % 9 AS STRING) AS line")
    boards = [transit.board(calls(spark), trips, 1000, 3)]
    by_order = calls(spark).withColumn("o", F.expr("trip * 100 + seq"))
    thin = [transit.thinned(by_order, "stop", "o", 3)]
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    boards += [transit.board(calls(spark), trips, 1000, 3), transit.board(calls(spark), trips, 1000, 3, calls=2000)]
    thin.append(transit.thinned(by_order, "stop", "o", 3, size=2000))
    for few, *many in (boards, thin):
        for df in many:
            assert tasks(few) <= 4 < 10 < tasks(df)
            assert sorted(few.collect()) == sorted(df.collect())


def test_numbered_calls(spark, monkeypatch):
    few = load(spark, "/root/testdata/sf0.01", "stop_time")
    monkeypatch.setattr(session, "TASK_ROWS", 5000)
    many = load(spark, "/root/testdata/sf0.01", "stop_time")
    assert tasks(few) <= 4 < 8 < tasks(many)
    assert few.exceptAll(many).isEmpty() and few.count() == many.count()

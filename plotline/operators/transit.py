"""Timetables: departures by service day, boards, vehicles on the road; opening hours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotline.functions.text import line_key
from plotline.session import dealt


def departures(trips: DataFrame, stop_times: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """line, headsign, day, times: the sorted distinct times (HH:MM) of the trips' first calls at the wanted stops."""
    calls = stop_times if stops is None else stop_times.join(stops, "stop", "left_semi")
    first = calls.groupBy("trip").agg(F.min_by("minute", "seq").alias("minute"))
    day = F.when(F.col("service") < 5, "weekday").when(F.col("service") == 5, "saturday").otherwise("sunday")
    x = first.join(trips, "trip").select("line", "headsign", day.alias("day"), hhmm(F.col("minute")).alias("t"))
    return x.groupBy("line", "headsign", "day").agg(F.array_join(F.array_sort(F.collect_set("t")), " ").alias("times"))


def hhmm(minute):
    m = F.pmod(minute, F.lit(1440))
    return F.concat(F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))


def calls_in_order(stop_times: DataFrame) -> DataFrame:
    return stop_times.groupBy("trip").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "stop"))), lambda x: x.stop.cast("string")), ">").alias("calls"))


def board(stop_times: DataFrame, trips: DataFrame, now: int, k: int, calls: int | None = None) -> DataFrame:
    """stop, place, line, wait: the next k departures of every stop, past midnight too (ties: line, trip).

    Calls are dealt by stop into as many tasks as they need, as each task sorts its calls; ``calls`` is their number, if it is known."""
    x = stop_times.join(trips, "trip").select("stop", "line", "trip", "seq", F.pmod(F.col("minute") - now, F.lit(1440)).alias("wait"))
    x = dealt(x, "stop", rows=stop_times.count() if calls is None else calls)
    w = W.partitionBy("stop").orderBy("wait", line_key(F.col("line")), "trip", "seq")
    return x.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("stop", "place", "line", "wait")


def on_the_road(stop_times: DataFrame, clocks: DataFrame, window: int) -> DataFrame:
    """now, trip, age: trips that left at most ``window`` minutes before each clock time, modulo a day.

    Each trip is filed under the hours in which it is on the road, so clocks meet only trips of their hour."""
    first = stop_times.groupBy("trip").agg(F.min_by("minute", "seq").alias("minute")).withColumn("minute", F.pmod("minute", F.lit(1440)))
    hours = F.explode(F.array_distinct(F.transform(F.sequence(F.floor(F.col("minute") / 60), F.floor((F.col("minute") + window) / 60)), lambda h: F.pmod(h, F.lit(24)))))
    x = first.withColumn("hour", hours).join(F.broadcast(clocks.withColumn("hour", F.floor(F.col("now") / 60))), "hour")
    return x.withColumn("age", F.pmod(F.col("now") - F.col("minute"), F.lit(1440))).where(F.col("age") <= window).select("now", "trip", "age")


def thinned(rows: DataFrame, by: str, order: str, every: int, size: int | None = None) -> DataFrame:
    """Every n-th row of each group, dealt into as many tasks as the rows need; ``size`` is their number, if it is known."""
    return dealt(rows, by, rows=size).withColumn("_i", F.row_number().over(W.partitionBy(by).orderBy(order))).where((F.col("_i") - 1) % every == 0).drop("_i")


DAYS = ("Mo", "Tu", "We", "Th", "Fr", "Sa", "Su")


def opening_hours(places: DataFrame, key: str = "poi", text: str = "opening_hours") -> DataFrame:
    """key, day (0 is Monday), open, close in minutes; close may pass 1440.

    Rules are separated by semicolons and later ones replace earlier ones for the days they name; a rule with an unreadable span
    is void; rules that name only holidays are skipped; 'off' closes its days; '24/7' is every day."""
    number = F.create_map(*(x for i, d in enumerate(DAYS) for x in (F.lit(d), F.lit(i))))
    rules = places.select(key, F.posexplode(F.split(F.col(text), r"\s*;\s*")).alias("ord", "rule"))
    rules = rules.withColumn("rule", F.when(F.trim("rule") == "24/7", "Mo-Su 00:00-24:00").otherwise(F.trim("rule")))
    day = "(?:Mo|Tu|We|Th|Fr|Sa|Su)"
    named = F.regexp_extract("rule", rf"^({day}(?:-{day})?(?:,{day}(?:-{day})?)*)\s", 1)
    rest = F.trim(F.regexp_replace("rule", rf"^{day}(?:-{day})?(?:,{day}(?:-{day})?)*\s", ""))
    rules = rules.withColumns({"days": F.when(named == "", "Mo-Su").otherwise(named), "rest": rest})
    span = r"\d{1,2}:\d{2}-\d{1,2}:\d{2}"
    rules = rules.where(F.rlike("rest", F.lit(rf"^(?:off|closed|{span}(?:,{span})*)$")))
    part = rules.withColumn("part", F.explode(F.split("days", ",")))
    a, b = number[F.substring("part", 1, 2)], number[F.substring("part", -2, 2)]
    part = part.withColumn("day", F.explode(F.transform(F.sequence(a, F.when(b < a, b + 7).otherwise(b)), lambda i: i % 7)))
    last = part.groupBy(key, "day").agg(F.max_by("rest", "ord").alias("rest")).where(~F.col("rest").isin("off", "closed"))
    one = last.withColumn("s", F.explode(F.split("rest", ",")))
    minute = lambda i: F.regexp_extract("s", r"(\d+):(\d+)-(\d+):(\d+)", i).cast("int") * 60 + F.regexp_extract("s", r"(\d+):(\d+)-(\d+):(\d+)", i + 1).cast("int")
    one = one.withColumns({"open": minute(1), "close": minute(3)})
    return one.select(key, "day", "open", F.when(F.col("close") <= F.col("open"), F.col("close") + 1440).otherwise(F.col("close")).alias("close"))


def open_at(hours: DataFrame, day: int, minute: int, key: str = "poi") -> DataFrame:
    """Keys that are open at a minute of a weekday, yesterday's span past midnight included."""
    today = (F.col("day") == day) & (F.col("open") <= minute) & (F.col("close") > minute)
    night = (F.col("day") == (day + 6) % 7) & (F.col("close") > minute + 1440)
    return hours.where(today | night).select(key).distinct()


def lines_by(trips: DataFrame, key: str) -> DataFrame:
    """key, trips, n, lines: counts, and the distinct lines by length, then text."""
    listed = F.transform(F.array_sort(F.collect_set(F.struct(F.length("line").alias("k"), "line"))), lambda x: x.line)
    return trips.groupBy(key).agg(F.count("*").alias("trips"), F.count_distinct("line").alias("n"), F.array_join(listed, ",").alias("lines"))


def routes_at(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """stop, routes: the distinct lines and headsigns that call at a stop, in line order."""
    x = stop_times.join(trips, "trip").groupBy("stop").agg(F.array_sort(F.collect_set(F.struct(line_key(F.col("line")).alias("k"), "headsign", "line"))).alias("r"))
    return x.select("stop", F.array_join(F.transform("r", lambda r: F.concat_ws(" ", r.line, r.headsign)), ";").alias("routes"))


def day_text(hours: DataFrame, key: str = "poi") -> DataFrame:
    """key, day, text: the spans of a day as HH:MM-HH:MM, in order."""
    clock = lambda m: F.concat(F.lpad(F.floor(m / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))
    spans = F.transform(F.array_sort(F.collect_list(F.struct("open", "close"))), lambda s: F.concat(clock(s.open), F.lit("-"), clock(s.close)))
    return hours.groupBy(key, "day").agg(F.array_join(spans, ", ").alias("text"))

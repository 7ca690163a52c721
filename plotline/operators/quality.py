"""Constraints as violation tables: one row (rule, key, severity) for each breach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, key: str, rules: dict[str, tuple[Column, str]]) -> DataFrame:
    """``rules``: rule -> (condition that must hold; null counts as held, severity). All rules are checked in one scan."""
    hits = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(True)), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, (ok, severity) in rules.items())))
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(hits).alias("v")).select("v.rule", "key", "v.severity")


def tenant_rules(code: str, name: str, match: str, target: str, form: str, sector: str, persons: tuple[str, ...], sectors: tuple[str, ...]) -> dict[str, tuple[Column, str]]:
    """What a tenant row must hold: a numeric code or a business id with a check digit, and a name; a known kind of match, with a target
    if it is exact; no sole proprietor; a known sector, if any."""
    c = F.col
    return {
        "code": ((F.rlike(code, F.lit(r"^\d+$")) | F.rlike(code, F.lit(r"^\d{7}-\d$"))) & c(name).isNotNull(), "error"),
        "match": (c(match).isin("exact", "street", "none"), "error"),
        "target": ((c(match) != "exact") | c(target).isNotNull(), "error"),
        "person": (~c(form).isin(*persons), "error"),
        "sector": (c(sector).isin(*sectors), "warning"),
    }


def dangling(rows: DataFrame, key: str, ref: str, targets: DataFrame, target: str, rule: str) -> DataFrame:
    """References that name no target."""
    x = rows.where(F.col(ref).isNotNull()).join(targets.select(F.col(target).alias("_t")).distinct(), F.col(ref) == F.col("_t"), "left_anti")
    return x.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.lit("error").alias("severity"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def private_text(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, emails: rows whose text holds e-mail addresses, and how many."""
    return rows.select(key, F.regexp_count(text, F.lit(EMAIL)).cast("long").alias("emails")).where("emails > 0")


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("rule", "severity").agg(F.count("*").alias("n"))


def number_or_null(column: str) -> Column:
    """Holds where a text is null or a number."""
    return F.col(column).isNull() | F.col(column).try_cast("double").isNotNull()


def departure_rules(day: str, at: str, points: str) -> dict[str, tuple[Column, str]]:
    """What a route must hold: a known service day, times as HH:MM, a shape of two points at least."""
    return {
        "day": (F.col(day).isin("weekday", "saturday", "sunday"), "error"),
        "time": (F.rlike(at, F.lit(r"^[0-2]\d:[0-5]\d$")), "error"),
        "shape": (F.col(points) >= 2, "error"),
    }

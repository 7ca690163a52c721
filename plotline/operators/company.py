"""Company facts: recent quarters, yearly totals, health verdicts, dominant companies and sector shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_quarters(quarters: DataFrame, n: int) -> DataFrame:
    """The latest n rows of each company, with their rank (1 is the newest)."""
    w = W.partitionBy("code").orderBy(F.desc("year"), F.desc("q"))
    return quarters.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def recent_totals(quarters: DataFrame) -> DataFrame:
    """code, turnover_4q (last four quarters that have one), taxes_4q (state and payroll taxes of the last four quarters), employees (of
    the last quarter)."""
    sold = last_quarters(quarters.where("turnover IS NOT NULL"), 4).groupBy("code").agg(F.sum("turnover").alias("turnover_4q"))
    paid = F.coalesce("taxes", F.lit(0)) + F.coalesce("labour", F.lit(0))
    recent = last_quarters(quarters, 4).groupBy("code").agg(F.sum(paid).alias("taxes_4q"), F.max_by("employees", F.struct("year", "q")).alias("employees"))
    return recent.join(sold, "code", "left").select("code", "turnover_4q", "taxes_4q", "employees")


def full_years(quarters: DataFrame) -> DataFrame:
    """code, year, turnover of the years with four published quarters."""
    return quarters.groupBy("code", "year").agg(F.count("turnover").alias("n"), F.sum("turnover").alias("turnover")).where("n = 4").drop("n")


def year_on_year(years: DataFrame) -> DataFrame:
    """Each full year beside the full year before it."""
    w = W.partitionBy("code").orderBy("year")
    return years.select("code", "year", "turnover", F.lag("year").over(w).alias("before_year"), F.lag("turnover").over(w).alias("before"))


def health(companies: DataFrame, quarters: DataFrame) -> DataFrame:
    """code, health, rule, from_year, from_turnover, to_year, to_turnover, by ordered rules: status; four published quarters
    without any state or payroll tax though someone works there (a blank is not a zero); an overdue report; turnover of the last two
    full years down by more than 40 %."""
    published = F.col("taxes").isNotNull() | F.col("labour").isNotNull()
    paid = (F.coalesce("taxes", F.lit(0)) + F.coalesce("labour", F.lit(0))) != 0
    last4 = last_quarters(quarters, 4).groupBy("code").agg(
        F.count_if(published).alias("published"), F.count_if(published & paid).alias("paid"), F.max(F.coalesce("employees", F.lit(0))).alias("staff")
    )
    w = W.partitionBy("code").orderBy(F.desc("year"))
    falls = year_on_year(full_years(quarters)).withColumn("r", F.row_number().over(w)).where("r = 1 AND before > 0 AND turnover < 0.6 * before")
    falls = falls.select("code", F.col("before_year").alias("from_year"), F.col("before").alias("from_turnover"), F.col("year").alias("to_year"), F.col("turnover").alias("to_turnover"))
    x = companies.join(last4, "code", "left").join(falls, "code", "left")
    rule = (
        F.when(F.col("status").isin("N", "L"), "status")
        .when((F.col("published") == 4) & (F.col("paid") == 0) & (F.col("staff") > 0), "zero_taxes")
        .when(F.col("overdue"), "report")
        .when(F.col("to_year").isNotNull(), "turnover")
    )
    x = x.withColumn("rule", rule)
    only = lambda c: F.when(F.col("rule") == "turnover", F.col(c)).alias(c)
    verdict = F.when(F.col("rule").isin("status", "zero_taxes"), "distressed").when(F.col("rule").isNotNull(), "watch").otherwise("sound")
    return x.select("code", verdict.alias("health"), "rule", *map(only, ("from_year", "from_turnover", "to_year", "to_turnover")))


def weight(employees: Column, turnover: Column) -> Column:
    return F.coalesce(employees, F.lit(0)) * 1_000_000 + F.coalesce(turnover, F.lit(0))


def dominant(tenants: DataFrame) -> DataFrame:
    """tunnus, code of the active company with most staff, then turnover (ties: smallest code)."""
    act = tenants.where("active AND tunnus IS NOT NULL")
    return act.groupBy("tunnus").agg(F.max_by("code", F.struct(weight(F.col("employees"), F.col("turnover")), -F.col("code"))).alias("code"))


def health_of_parcel(tenants: DataFrame, verdicts: DataFrame) -> DataFrame:
    """tunnus, health: the dominant active company's verdict, or the worst verdict where no company is active."""
    order = F.when(F.col("health") == "distressed", 2).when(F.col("health") == "watch", 1).otherwise(0)
    worst = tenants.where("NOT active").join(verdicts, "code").groupBy("tunnus").agg(F.max_by("health", order).alias("worst"))
    best = dominant(tenants).join(verdicts.select("code", "health"), "code").select("tunnus", "health")
    return best.join(worst, "tunnus", "full").select("tunnus", F.coalesce("health", "worst").alias("health"))


def sector_shares(tenants: DataFrame) -> DataFrame:
    """tunnus, sector ('' if unknown), share: by staff, or by companies where no company of the parcel reports staff."""
    act = tenants.where("active").select("tunnus", F.coalesce("sector", F.lit("")).alias("sector"), F.greatest(F.coalesce("employees", F.lit(0)), F.lit(0)).alias("staff"))
    sums = act.groupBy("tunnus", "sector").agg(F.sum("staff").alias("staff"), F.count("*").alias("n"))
    w = W.partitionBy("tunnus")
    staff, n = F.sum("staff").over(w), F.sum("n").over(w)
    return sums.select("tunnus", "sector", F.when(staff > 0, F.col("staff") / staff).otherwise(F.col("n") / n).alias("share"))


def match_statistics(tenants: DataFrame) -> DataFrame:
    """One row for each kind of match: companies, active ones, distinct parcels, staff."""
    return tenants.groupBy("match").agg(F.count("*").alias("n"), F.count_if("active").alias("active"), F.count_distinct("tunnus").alias("parcels"), F.sum("employees").alias("staff"))


def enrich(tenants: DataFrame, quarters: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Tenants with recent totals and verdict; each side is optional. The dump is reduced to the tenants' codes first."""
    few = quarters.join(tenants.select("code"), "code", "left_semi")
    return tenants.join(recent_totals(few).withColumnRenamed("employees", "latest_employees"), "code", "left").join(verdicts.select("code", "health"), "code", "left")


def due_year(today: str) -> int:
    """The last year whose report should be there by a day (ISO): reports are due in the middle of the next year, and half a year of grace follows."""
    year = int(today[:4])
    return year - 1 if today >= f"{year}-12-31" else year - 2


def staff_and_reports(companies: DataFrame, quarters: DataFrame, reports: DataFrame, today: str) -> DataFrame:
    """code, employees, last_report, overdue for companies (code, status, deleted): the staff of the last quarter, or of the last report (code, year,
    employees) if that quarter has none; a report is overdue if the last one is from before the due year, for registered companies that aren't deleted
    and have reported before."""
    q = quarters.groupBy("code").agg(F.max_by("employees", F.struct("year", "q")).alias("of_quarter"))
    r = reports.where("year IS NOT NULL").groupBy("code").agg(F.max_by("employees", "year").alias("of_report"), F.max("year").alias("last_report"))
    x = companies.select("code", "status", "deleted").join(q, "code", "left").join(r, "code", "left")
    overdue = (F.col("last_report") < due_year(today)) & F.col("deleted").isNull() & (F.col("status") == "R")
    return x.select("code", F.coalesce("of_quarter", "of_report").alias("employees"), "last_report", F.coalesce(overdue, F.lit(False)).alias("overdue"))


def reasons(stored: DataFrame) -> DataFrame:
    """code, rule, from_year, from_turnover, to_year, to_turnover for stored rows (code, health, rule, status, overdue, the four figures, quarters
    ARRAY<STRUCT<year, turnover>>) of which old ones lack the rule: it follows from the verdict, the status and the report, and the two years of a
    turnover verdict from the quarters that are still there, if two whole years are."""
    derived = (
        F.when(F.col("health") == "distressed", F.when(F.col("status").isin("N", "L"), "status").otherwise("zero_taxes"))
        .when(F.col("health") == "watch", F.when(F.col("overdue"), "report").otherwise("turnover"))
    )
    sold = F.filter(F.coalesce("quarters", F.array().cast("array<struct<year:int,turnover:bigint>>")), lambda q: q.turnover.isNotNull())
    x = stored.withColumn("rule", F.coalesce("rule", derived)).withColumn("_sold", sold)
    of = lambda y: F.filter("_sold", lambda q: q.year == y)
    years = F.filter(F.array_sort(F.array_distinct(F.transform("_sold", lambda q: q.year))), lambda y: F.size(of(y)) == 4)
    x = x.withColumn("_years", years)
    total = lambda y: F.aggregate(of(y), F.lit(0).cast("long"), lambda a, q: a + q.turnover)
    both, told = F.size("_years") > 1, F.col("from_year").isNotNull()
    at = lambda k: F.when(both, F.try_element_at("_years", F.lit(k)))
    of_turnover = F.col("rule") == "turnover"
    pick = lambda given, found: F.when(of_turnover, F.when(told, F.col(given)).otherwise(found)).alias(given)
    return x.select("code", "rule", pick("from_year", at(-2)), pick("from_turnover", F.when(both, total(at(-2)))), pick("to_year", at(-1)), pick("to_turnover", F.when(both, total(at(-1)))))

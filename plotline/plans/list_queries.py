"""Queries on lists, rules, runs and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.functions import text as T
from plotline.operators import lists, match
from plotline.plans.demo import load, with_tables
from plotline.plans.registry import ORACLES, query


@query("o1_plot_list", with_tables("parcel", rest="SELECT tile, pid, place, more FROM (SELECT tile, pid, CAST(row_number() OVER (PARTITION BY tile ORDER BY area DESC, pid) AS INT) AS place, greatest(count(*) OVER (PARTITION BY tile) - 12, 0) AS more FROM parcel WHERE ownership <> 'state') WHERE place <= 12"))
def o1(spark, d):
    return lists.page(load(spark, d, "parcel").where("ownership <> 'state'"), "tile", [F.desc("area"), F.col("pid")], 12).select("tile", "pid", "place", "more")


@query("o2_company_list", with_tables("company", rest="SELECT sector, code, place FROM (SELECT coalesce(sector, '') AS sector, code, CAST(row_number() OVER (PARTITION BY coalesce(sector, '') ORDER BY coalesce(employees, -1) DESC, code) AS INT) AS place FROM company WHERE active) WHERE place <= 20"))
def o2(spark, d):
    c = load(spark, d, "company").where("active").withColumn("sector", F.coalesce("sector", F.lit("")))
    return lists.page(c, "sector", [F.desc(F.coalesce("employees", F.lit(-1))), F.col("code")], 20).select("sector", "code", "place")


@query("o7_hover_card", with_tables("company", rest="SELECT tunnus, code, more FROM (SELECT tunnus, code, row_number() OVER (PARTITION BY tunnus ORDER BY code) AS place, greatest(count(*) OVER (PARTITION BY tunnus) - 3, 0) AS more FROM company) WHERE place <= 3"))
def o7(spark, d):
    return lists.page(load(spark, d, "company"), "tunnus", [F.col("code")], 3).select("tunnus", "code", "more")


@query("o9_newest", with_tables("company_quarter", rest="SELECT code, arg_max(turnover, year * 4 + q) FILTER (turnover IS NOT NULL) AS turnover FROM company_quarter WHERE turnover IS NOT NULL GROUP BY code"))
def o9(spark, d):
    return lists.newest(load(spark, d, "company_quarter").where("turnover IS NOT NULL"), "code", "turnover", F.struct("year", "q"))


@query("j28_first_rule", with_tables("parcel", rest="SELECT pid, CASE WHEN purpose = 'ELAMUMAA' AND area < 400 THEN 'garden' WHEN purpose IN ('ELAMUMAA', 'ARIMAA') THEN 'yard' WHEN purpose = 'MAATULUNDUSMAA' AND area >= 300 THEN 'field' WHEN ownership = 'municipal' THEN 'park' ELSE 'none' END AS kit FROM parcel"))
def j28(spark, d):
    p, c = load(spark, d, "parcel"), F.col
    rules = [("garden", (c("purpose") == "ELAMUMAA") & (c("area") < 400)), ("yard", c("purpose").isin("ELAMUMAA", "ARIMAA")), ("field", (c("purpose") == "MAATULUNDUSMAA") & (c("area") >= 300)), ("park", c("ownership") == "municipal")]
    return p.select("pid", lists.first_rule(p, rules, "none").alias("kit"))


@query("w9_gap_runs", "WITH x AS (SELECT user_id, event_id, CASE WHEN event_id - lag(event_id) OVER w > 20 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run FROM x")
def w9(spark, d):
    return lists.sessions(load(spark, d, "events"), "user_id", F.col("event_id"), 20).select("user_id", "event_id", "run")


@query("w15_rolling_mean", "SELECT event_id, avg(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mean FROM events")
def w15(spark, d):
    return lists.rolling_mean(load(spark, d, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long")), "event_type", ["event_id"], "cents", 20).select("event_id", "mean")


@query("f5_adaptive_keep", with_tables("company", rest="SELECT code FROM (SELECT *, count(*) OVER (PARTITION BY tunnus) AS n FROM company) WHERE match <> 'none' OR n <= 1"))
def f5(spark, d):
    from pyspark.sql import Window as W

    c = load(spark, d, "company").withColumn("n", F.count("*").over(W.partitionBy("tunnus")))
    return c.where("match <> 'none' OR n <= 1").select("code")


@query("u5_known_ids", with_tables("company", "parcel", rest="SELECT tunnus FROM company EXCEPT SELECT tunnus FROM parcel"))
def u5(spark, d):
    return load(spark, d, "company").select("tunnus").subtract(load(spark, d, "parcel").select("tunnus"))


@query("u5_all_known_ids", ORACLES["u5_known_ids"])
def u5_all(spark, d):
    return load(spark, d, "company").select("tunnus").subtract(load(spark, d, "parcel").select("tunnus"))


@query("t32_age_band", with_tables("building", rest="SELECT bid, CASE WHEN year IS NULL THEN 'unknown' WHEN year < 1920 THEN 'old' WHEN year < 1945 THEN 'interwar' WHEN year < 1991 THEN 'panel' ELSE 'new' END AS band FROM building"))
def t32(spark, d):
    b, y = load(spark, d, "building"), F.col("year")
    return b.select("bid", lists.first_rule(b, [("unknown", y.isNull()), ("old", y < 1920), ("interwar", y < 1945), ("panel", y < 1991)], "new").alias("band"))


#: No name has a word twice.
_TOKENS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"


@query("j16_name_matches", f"""WITH p AS (SELECT p_partkey, p_brand, p_name, {_TOKENS.format('p_name')} AS t FROM part),
l AS (SELECT p_partkey AS left_id, p_brand, t FROM p WHERE p_partkey % 2 = 0), r AS (SELECT p_partkey AS right_id, p_brand, t[2:] AS t FROM p WHERE p_partkey % 2 = 1),
s AS (SELECT left_id, right_id, CASE WHEN length(b) >= 3 AND contains(a, b) OR length(a) >= 3 AND contains(b, a) THEN 1.0 WHEN len(lt) + len(rt) = 0 THEN 0.0 ELSE len(list_intersect(lt, rt)) / CAST(len(list_distinct(list_concat(lt, rt))) AS DOUBLE) END AS score
 FROM (SELECT left_id, right_id, l.t AS lt, r.t AS rt, array_to_string(l.t, ' ') AS a, array_to_string(r.t, ' ') AS b FROM l JOIN r USING (p_brand)) x)
SELECT left_id, right_id, score FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS k FROM s WHERE score >= 0.5) WHERE k = 1""")
def j16(spark, d):
    """Shops (even parts, whole names) and companies (odd parts, names without their first word) of a brand."""
    t = load(spark, d, "part").select("p_partkey", "p_brand", T.name_tokens(F.col("p_name")).alias("t"))
    left = t.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("left_id"), "p_brand", F.col("t").alias("left_tokens"))
    right = t.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("right_id"), "p_brand", F.slice("t", 2, 99).alias("right_tokens"))
    return match.name_matches(left, right, "p_brand")

"""Queries on companies, parcels, addresses and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.functions import geometry as G
from plotline.functions import text as T
from plotline.operators import company, links, market, match, registers
from plotline.operators.lists import global_rank
from plotline.plans.demo import load, with_tables
from plotline.plans.registry import ORACLES, query

_MARKET = """, x AS (SELECT tile, coalesce(purpose, 'SIHTOTSTARBETA_MAA') AS purpose, area, land_value, land_value / area::DOUBLE AS m FROM parcel WHERE land_value > 0 AND area > 0),
y AS (SELECT * FROM x UNION ALL SELECT tile, 'all', area, land_value, m FROM x),
m AS (SELECT tile, purpose, CAST(floor(quantile_cont(m, 0.5) * 100 + 0.5 + 1e-7) AS BIGINT) AS median, CAST(floor(quantile_cont(m, 0.25) * 100 + 0.5 + 1e-7) AS BIGINT) AS p25, CAST(floor(quantile_cont(m, 0.75) * 100 + 0.5 + 1e-7) AS BIGINT) AS p75,
 count(*) AS n, CAST(sum(area) AS BIGINT) AS total_area, CAST(sum(land_value) AS BIGINT) AS total_value FROM y GROUP BY tile, purpose)"""


def _with(*names: str, rest: str) -> str:
    """CTEs of the demo tables, more CTEs (text that begins with a comma), and the select."""
    return with_tables(*names, rest="").rstrip() + rest


@query("a2_market", _with("parcel", rest=_MARKET + " SELECT * FROM m"))
def a2(spark, d):
    return market.market(load(spark, d, "parcel"))


@query("o3_market_order", _with("parcel", rest=_MARKET + " SELECT tile, purpose, median, row_number() OVER (PARTITION BY tile ORDER BY purpose = 'all', median DESC, purpose) AS place FROM m"))
def o3(spark, d):
    return market.dearest_first(market.market(load(spark, d, "parcel")))


@query("a1_parcel_summary", with_tables("parcel", rest="""
SELECT p.tile, array_to_string(list_sort(list(DISTINCT settlement)), ',') AS settlements, array_to_string(list_sort(list(DISTINCT municipality)), ',') AS municipalities,
 count(land_value) AS valued, CAST(sum(land_value) AS BIGINT) AS total, count(*) AS n, any_value(t.county) AS county
FROM parcel p LEFT JOIN (SELECT tile, county FROM (SELECT tile, county, row_number() OVER (PARTITION BY tile ORDER BY count(*) DESC, county DESC) AS r FROM parcel WHERE county IS NOT NULL GROUP BY 1, 2) WHERE r = 1) t ON t.tile = p.tile GROUP BY p.tile"""))
def a1(spark, d):
    return market.summarize(load(spark, d, "parcel"))


@query("a12_kind_histogram", with_tables("building", rest="SELECT tile, kind, count(*) AS n FROM building GROUP BY ALL"))
def a12(spark, d):
    return market.histogram(load(spark, d, "building"), "tile", "kind")


@query("a23_merged_parts", with_tables("parcel", rest="SELECT land_registry, count(*) AS parts, CAST(sum(area) AS BIGINT) AS area, arg_max(pid, area * 100000000 - pid) AS outline FROM parcel WHERE land_registry IS NOT NULL GROUP BY 1"))
def a23(spark, d):
    return market.merged_parts(load(spark, d, "parcel"))


@query("w1_last_quarters", with_tables("company_quarter", rest="SELECT code, year, q, turnover, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY code ORDER BY year DESC, q DESC) AS INT) AS rank FROM company_quarter) WHERE rank <= 8"))
def w1(spark, d):
    return company.last_quarters(load(spark, d, "company_quarter"), 8).select("code", "year", "q", "turnover", "rank")


_TOTALS = """, r AS (SELECT k.code, s.turnover_4q, k.taxes_4q, k.employees FROM (SELECT code, CAST(sum(coalesce(taxes, 0) + coalesce(labour, 0)) FILTER (r <= 4) AS BIGINT) AS taxes_4q, max(employees) FILTER (r = 1) AS employees
  FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY year DESC, q DESC) AS r FROM company_quarter) GROUP BY code) k
 LEFT JOIN (SELECT code, CAST(sum(turnover) FILTER (r <= 4) AS BIGINT) AS turnover_4q FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY year DESC, q DESC) AS r FROM company_quarter WHERE turnover IS NOT NULL) GROUP BY code) s ON s.code = k.code)"""


@query("a5_recent_totals", _with("company_quarter", rest=_TOTALS + " SELECT * FROM r"))
def a5(spark, d):
    return company.recent_totals(load(spark, d, "company_quarter"))


_YEARS = ", y AS (SELECT code, year, CAST(sum(turnover) AS BIGINT) AS turnover FROM company_quarter GROUP BY 1, 2 HAVING count(turnover) = 4), yy AS (SELECT *, lag(year) OVER w AS before_year, lag(turnover) OVER w AS before FROM y WINDOW w AS (PARTITION BY code ORDER BY year))"


@query("a6_full_years", _with("company_quarter", rest=_YEARS + " SELECT * FROM y"))
def a6(spark, d):
    return company.full_years(load(spark, d, "company_quarter"))


@query("w2_year_on_year", _with("company_quarter", rest=_YEARS + " SELECT * FROM yy"))
def w2(spark, d):
    return company.year_on_year(company.full_years(load(spark, d, "company_quarter")))


_HEALTH = _YEARS + """, f AS (SELECT code, before_year AS from_year, before AS from_turnover, year AS to_year, turnover AS to_turnover FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY year DESC) AS r FROM yy) WHERE r = 1 AND before > 0 AND turnover < 0.6 * before),
l AS (SELECT code, count(*) FILTER (taxes IS NOT NULL OR labour IS NOT NULL) AS published, count(*) FILTER (coalesce(taxes, 0) + coalesce(labour, 0) <> 0) AS paid, max(coalesce(employees, 0)) AS staff FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY year DESC, q DESC) AS r FROM company_quarter) WHERE r <= 4 GROUP BY code),
h0 AS (SELECT c.code, CASE WHEN status IN ('N', 'L') THEN 'status' WHEN published = 4 AND paid = 0 AND staff > 0 THEN 'zero_taxes' WHEN overdue THEN 'report' WHEN to_year IS NOT NULL THEN 'turnover' END AS rule, f.* EXCLUDE (code) FROM company c LEFT JOIN l USING (code) LEFT JOIN f USING (code)),
h AS (SELECT code, CASE WHEN rule IN ('status', 'zero_taxes') THEN 'distressed' WHEN rule IS NOT NULL THEN 'watch' ELSE 'sound' END AS health, rule,
 CASE WHEN rule = 'turnover' THEN from_year END AS from_year, CASE WHEN rule = 'turnover' THEN from_turnover END AS from_turnover, CASE WHEN rule = 'turnover' THEN to_year END AS to_year, CASE WHEN rule = 'turnover' THEN to_turnover END AS to_turnover FROM h0)"""


@query("w3_health", _with("company", "company_quarter", rest=_HEALTH + " SELECT * FROM h"))
def w3(spark, d):
    return company.health(load(spark, d, "company"), load(spark, d, "company_quarter"))


_DOM = ", w AS (SELECT *, coalesce(employees, 0) * 1000000 + coalesce(turnover, 0) AS k FROM company WHERE active), dom AS (SELECT tunnus, code FROM (SELECT tunnus, code, row_number() OVER (PARTITION BY tunnus ORDER BY k DESC, code) AS r FROM w) WHERE r = 1)"


@query("a9_dominant", _with("company", rest=_DOM + " SELECT * FROM dom"))
def a9(spark, d):
    return company.dominant(load(spark, d, "company"))


@query("a9_parcel_health", _with("company", "company_quarter", rest=_HEALTH + _DOM + """, worst AS (SELECT tunnus, CASE max(CASE health WHEN 'distressed' THEN 2 WHEN 'watch' THEN 1 ELSE 0 END) WHEN 2 THEN 'distressed' WHEN 1 THEN 'watch' ELSE 'sound' END AS worst FROM company c JOIN h USING (code) WHERE NOT active GROUP BY 1)
SELECT tunnus, coalesce(health, worst) AS health FROM (SELECT tunnus, health FROM dom JOIN h USING (code)) FULL JOIN worst USING (tunnus)"""))
def a9b(spark, d):
    c = load(spark, d, "company")
    return company.health_of_parcel(c, company.health(c, load(spark, d, "company_quarter")))


@query("a10_sector_shares", with_tables("company", rest="""WITH s AS (SELECT tunnus, coalesce(sector, '') AS sector, sum(coalesce(employees, 0)) AS staff, count(*) AS n FROM company WHERE active GROUP BY ALL)
SELECT tunnus, sector, CASE WHEN sum(staff) OVER w > 0 THEN staff / (sum(staff) OVER w)::DOUBLE ELSE n / (sum(n) OVER w)::DOUBLE END AS share FROM s WINDOW w AS (PARTITION BY tunnus)"""))
def a10(spark, d):
    return company.sector_shares(load(spark, d, "company"))


@query("a4_match_statistics", with_tables("company", rest="SELECT match, count(*) AS n, count(*) FILTER (active) AS active, count(DISTINCT tunnus) AS parcels, CAST(sum(employees) AS BIGINT) AS staff FROM company GROUP BY match"))
def a4(spark, d):
    return company.match_statistics(load(spark, d, "company"))


@query("j17_enrich", _with("company", "company_quarter", rest=_HEALTH + _TOTALS + " SELECT c.code, c.name, r.turnover_4q, r.taxes_4q, r.employees AS latest_employees, h.health FROM company c LEFT JOIN r USING (code) LEFT JOIN h USING (code)"))
def j17(spark, d):
    c, q = load(spark, d, "company"), load(spark, d, "company_quarter")
    return company.enrich(c, q, company.health(c, q)).select("code", "name", "turnover_4q", "taxes_4q", "latest_employees", "health")


_NUMBERED = r"^(.+?)\s+(\d+)([a-zõäöüšž]?)(?:/\d+[\p{L}\p{N}_]*)?(?:-\d+[\p{L}\p{N}_]*)?$"


def _parts(c: str) -> str:
    """SQL of the stem, number and letter of a cleaned address."""
    stem = rf"regexp_replace(CASE WHEN regexp_matches({c}, '{_NUMBERED}') THEN regexp_extract({c}, '{_NUMBERED}', 1) ELSE {c} END, '^(.*\S) (tänav|tn|tee|puiestee|pst|maantee|mnt|põik|allee|väljak|plats|tänava)$', '\1')"
    return f"{stem} AS stem, regexp_extract({c}, '{_NUMBERED}', 2) AS num, regexp_extract({c}, '{_NUMBERED}', 3) AS sub"


_CLEAN = r"trim(regexp_replace(regexp_replace(nfc_normalize(lower(part)), '[.,]', ' ', 'g'), '\s+', ' ', 'g'))"
#: Alternates of parcels and buildings, with bare numbers continued.
_KEYS = rf""", parts AS (SELECT kind, id, i, {_CLEAN} AS s FROM (SELECT kind, id, unnest(string_split(a, '//')) AS part, unnest(range(len(string_split(a, '//')))) AS i FROM (SELECT 'p' AS kind, pid AS id, full_address AS a FROM parcel UNION ALL SELECT 'b', bid, full_address FROM building UNION ALL SELECT 'o', bid, other_address FROM building WHERE other_address IS NOT NULL) u) v WHERE trim(part) <> ''),
cut AS (SELECT kind, id, i, {_parts('s')} FROM parts),
marked AS (SELECT *, num = '' AND regexp_matches(stem, '^[0-9]+[a-zõäöüšž]?$') AND row_number() OVER (PARTITION BY kind, id ORDER BY i) > 1 AS bare FROM cut),
keys AS (SELECT kind, id, i, last_value(CASE WHEN NOT bare THEN stem END IGNORE NULLS) OVER (PARTITION BY kind, id ORDER BY i) AS stem, CASE WHEN bare THEN regexp_extract(stem, '^([0-9]+)', 1) ELSE num END AS num, CASE WHEN bare THEN regexp_extract(stem, '([a-zõäöüšž]?)$', 1) ELSE sub END AS sub FROM marked),
asked AS (SELECT code, adr_id, {_parts('s')} FROM (SELECT code, adr_id, {_CLEAN.replace('part', 'full_address')} AS s FROM company) c)"""
_BEST = "row_number() OVER (PARTITION BY {0} ORDER BY b.kind = 'outbuilding', w * d DESC, b.bid) AS r"
_J1 = _KEYS + f""", home AS (SELECT b.* EXCLUDE (pid), coalesce(pid, (SELECT min(p.pid) FROM parcel p WHERE p.tile = b.tile AND b.x >= p.x AND b.x < p.x + p.side AND b.z >= p.z AND b.z < p.z + p.side)) AS pid FROM building b), pf AS (SELECT stem, num, sub, min(id) AS p FROM keys WHERE kind = 'p' AND num <> '' GROUP BY ALL), pa AS (SELECT stem, num, min(id) AS p FROM keys WHERE kind = 'p' AND num <> '' GROUP BY ALL HAVING count(*) = 1),
bk AS (SELECT stem, num, sub, bid, pid FROM (SELECT k.stem, k.num, k.sub, b.bid, b.pid, {_BEST.format('k.stem, k.num, k.sub')} FROM keys k JOIN home b ON k.kind <> 'p' AND k.id = b.bid WHERE num <> '') t WHERE r = 1),
ads AS (SELECT any_id AS adr_id, bid, pid FROM (SELECT any_id, bid, pid, {_BEST.format('any_id')} FROM (SELECT *, unnest([adr_id, aadr_id]) AS any_id FROM home) b WHERE any_id IS NOT NULL) t WHERE r = 1),
st AS (SELECT DISTINCT stem FROM keys WHERE num <> ''), fm AS (SELECT stem, min(id) AS p FROM keys WHERE kind = 'p' AND num = '' AND stem <> '' GROUP BY stem),
m AS (SELECT c.code, c.num, ads.bid AS b1, ads.pid AS p1, pf.p AS p2, CASE WHEN c.sub = '' THEN pa.p END AS p3, bk.bid AS b4, bk.pid AS p4, fm.p AS p5, st.stem IS NOT NULL AS known,
 CASE WHEN ads.bid IS NOT NULL THEN 'ads' WHEN c.num <> '' AND (pf.p IS NOT NULL OR pa.p IS NOT NULL AND c.sub = '') THEN 'address' WHEN c.num <> '' AND bk.bid IS NOT NULL THEN 'building' WHEN c.num = '' AND fm.p IS NOT NULL THEN 'farm' END AS via
 FROM asked c LEFT JOIN ads ON ads.adr_id = c.adr_id LEFT JOIN pf ON pf.stem = c.stem AND pf.num = c.num AND pf.sub = c.sub LEFT JOIN pa ON pa.stem = c.stem AND pa.num = c.num LEFT JOIN bk ON bk.stem = c.stem AND bk.num = c.num AND bk.sub = c.sub LEFT JOIN st ON st.stem = c.stem LEFT JOIN fm ON fm.stem = c.stem),
matched AS (SELECT code, CASE WHEN via IS NOT NULL THEN 'exact' WHEN num <> '' AND known THEN 'street' ELSE 'none' END AS match, via, CASE via WHEN 'ads' THEN p1 WHEN 'address' THEN coalesce(p2, p3) WHEN 'building' THEN p4 WHEN 'farm' THEN p5 END AS pid, CASE via WHEN 'ads' THEN b1 WHEN 'building' THEN b4 END AS bid FROM m)"""


def _matched(spark, d):
    full = lambda name: load(spark, d, name).withColumn("address", F.col("full_address"))
    buildings = full("building").withColumns({"addresses": F.array("other_address"), "ids": F.array("adr_id", "aadr_id")})
    return match.match_cascade(full("company"), full("parcel").withColumn("ring", G.square(F.col("x"), F.col("z"), F.col("side"))), buildings)


@query("j1_match_cascade", _with("company", "parcel", "building", rest=_J1 + " SELECT * FROM matched"))
def j1(spark, d):
    return _matched(spark, d)


@query("j30_shared_owners", with_tables("holding", rest="SELECT l.tunnus AS a, r.tunnus AS b, count(*) AS shared FROM holding l JOIN holding r ON l.owner = r.owner AND l.tunnus < r.tunnus GROUP BY ALL"))
def j30(spark, d):
    return links.shared_owner_pairs(load(spark, d, "holding"))


@query("j31_immovable_pairs", with_tables("parcel", rest="SELECT l.tunnus AS a, r.tunnus AS b FROM parcel l JOIN parcel r ON l.land_registry = r.land_registry AND l.tunnus < r.tunnus WHERE regexp_matches(l.land_registry, '^-?[0-9]+$')"))
def j31(spark, d):
    return links.immovable_pairs(load(spark, d, "parcel"))


@query("j33_links", with_tables("parcel", "holding", rest="""WITH e AS (SELECT l.tunnus AS a, r.tunnus AS b, 'owner' AS kind, count(*) AS shared FROM holding l JOIN holding r ON l.owner = r.owner AND l.tunnus <> r.tunnus GROUP BY ALL
 UNION ALL SELECT l.tunnus, r.tunnus, 'immovable', 0 FROM parcel l JOIN parcel r ON l.land_registry = r.land_registry AND l.tunnus <> r.tunnus WHERE regexp_matches(l.land_registry, '^-?[0-9]+$'))
SELECT a AS tunnus, b AS other, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, max(shared) AS shared FROM e WHERE a IN (SELECT tunnus FROM parcel) GROUP BY ALL"""))
def j33(spark, d):
    p = load(spark, d, "parcel")
    return links.links_of_plots(load(spark, d, "holding"), p, p)


@query("j33_all_links", ORACLES["j33_links"])
def j33_all(spark, d):
    p = load(spark, d, "parcel")
    return links.links_of_plots(load(spark, d, "holding"), p, p)


@query("j34_tenants_of_parcel", with_tables("parcel", "company", rest="SELECT p.tunnus, count(c.code) AS tenants, array_to_string(list_sort(list(c.code)), ',') AS codes FROM parcel p JOIN company c ON c.tunnus = p.tunnus AND c.match = 'exact' GROUP BY 1"))
def j34(spark, d):
    c = load(spark, d, "company").where("match = 'exact'")
    return load(spark, d, "parcel").select("tunnus").join(c, "tunnus").groupBy("tunnus").agg(F.count("*").alias("tenants"), F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))


@query("t1_fold", with_tables("parcel", rest="SELECT pid, trim(regexp_replace(translate(lower(address || ' \"Ž\", ' || p_name), 'õäöüšž\",', 'oaousz'), '\\s+', ' ', 'g')) AS folded FROM parcel JOIN part ON p_partkey = pid"))
def t1(spark, d):
    names = load(spark, d, "part").select(F.col("p_partkey").alias("pid"), "p_name")
    return load(spark, d, "parcel").join(names, "pid").select("pid", T.fold(F.concat("address", F.lit(' "Ž", '), "p_name")).alias("folded"))


FOLDED = "trim(replace(replace(replace(replace(replace(' ' || trim(translate(lower({0}), 'õäöüšžå', 'oaousza')) || ' ', ' tanav ', ' tn '), ' maantee ', ' mnt '), ' puiestee ', ' pst '), ' poik ', ' pk '), ' allee ', ' all '))"


@query("t2_fold_street", with_tables("parcel", rest=f"SELECT pid, {FOLDED.format('address')} AS folded FROM parcel"))
def t2(spark, d):
    return load(spark, d, "parcel").select("pid", T.fold_street(F.col("address")).alias("folded"))


@query("t3_slug", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def t3(spark, d):
    return load(spark, d, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))


@query("t4_address_parts", _with("company", "parcel", "building", rest=_KEYS + " SELECT code, stem, num, sub FROM asked"))
def t4(spark, d):
    return load(spark, d, "company").select("code", T.address_parts(F.col("full_address")).alias("k")).select("code", "k.stem", "k.num", "k.sub")


@query("t5_alternates", _with("company", "parcel", "building", rest=_KEYS + " SELECT id AS pid, CAST(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS INT) AS pos, stem, num, sub FROM keys WHERE kind = 'p'"))
def t5(spark, d):
    return match.address_keys(load(spark, d, "parcel"), "pid", "full_address")


@query("t10_street", with_tables("parcel", rest="SELECT pid, regexp_extract(address, '^(\\D*)\\s\\d', 1) AS street FROM parcel"))
def t10(spark, d):
    return load(spark, d, "parcel").select("pid", T.street_of(F.col("address")).alias("street"))


@query("t11_natural_key", with_tables("parcel", rest="SELECT pid, row_number() OVER (ORDER BY regexp_extract(address, '^(\\D*)', 1), CAST(regexp_extract(address, '(\\d+)', 1) AS INT), regexp_extract(address, '\\d(\\D*)$', 1), pid) AS place FROM (SELECT pid, lower(address) AS address FROM parcel)"))
def t11(spark, d):
    return global_rank(load(spark, d, "parcel").select("pid", T.natural_key(F.col("address")).alias("k")), ["k", "pid"], "place", 1).select("pid", "place")


@query("t12_line_key", with_tables("trip", rest="SELECT DISTINCT line, lpad(regexp_extract(line, '^(\\d*)', 1), 9, '0') || line AS key FROM trip"))
def t12(spark, d):
    return load(spark, d, "trip").select("line", T.line_key(F.col("line")).alias("key")).distinct()


@query("t17_first_number", "SELECT p_partkey, CAST(nullif(regexp_extract(p_brand, '(\\d+)', 1), '') AS DOUBLE) AS n FROM part")
def t17(spark, d):
    return load(spark, d, "part").select("p_partkey", T.first_number(F.col("p_brand")).alias("n"))


#: A name-based UUID in SQL: SHA-1 of namespace and text, with the bits of version and variant set.
_UUID = f"(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(strpos('0123456789abcdef', substr(h, 17, 1)) - 1 AS INT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12))"


@query("t21_holder_id", with_tables("officer", rest=f"SELECT oid, CASE WHEN lower(raw) IN ('--', 'pole') THEN NULL WHEN regexp_matches(raw, '^[0-9]+$') THEN raw ELSE {_UUID} END AS holder FROM (SELECT *, sha1(unhex('{T.NAMESPACE}') || encode(lower(raw))) AS h FROM officer) x"))
def t21(spark, d):
    return load(spark, d, "officer").select("oid", T.holder_id(F.col("raw")).alias("holder"))


def _section(name) -> str:
    """SQL of the section letter or group of the division d in the edition e."""
    rows = lambda k: " ".join(f"WHEN d BETWEEN {a} AND {b} THEN '{name(k, x)}'" for a, b, x in T.SECTIONS[k])
    return f"CASE WHEN e >= 3 THEN CASE {rows(3)} ELSE '' END ELSE CASE {rows(2)} ELSE '' END END"


@query("t22_activity", with_tables("company", rest=f"SELECT code, {_section(lambda k, x: x)} AS section, {_section(lambda k, x: T.GROUPS[k][x])} AS grp FROM (SELECT code, CAST(substr(activity, 1, 2) AS INT) AS d, coalesce(activity_version, 2) AS e FROM company) x"))
def t22(spark, d):
    a, v = F.col("activity"), F.col("activity_version")
    return load(spark, d, "company").select("code", T.activity_section(a, v).alias("section"), T.activity_group(a, v).alias("grp"))


_PHRASE = "CASE c_custkey % 7 WHEN 0 THEN ' hulgi- ja jaekaubandus; mootorsõidukite remont' WHEN 1 THEN 'Põllumajandus, metsamajandus' WHEN 2 THEN 'ÜLDEHITUS' WHEN 3 THEN 'Töötlev tööstus' WHEN 4 THEN '' WHEN 5 THEN 'kutse-, teadus- ja tehnikaalane tegevus' END"


@query("t22_group_of_words", f"SELECT c_custkey, coalesce((SELECT g FROM (VALUES {', '.join(f'({i}, {chr(39)}{a}{chr(39)}, {chr(39)}{b}{chr(39)})' for i, (a, b) in enumerate(T.GROUP_WORDS))}) v(i, a, g) WHERE starts_with(upper(trim({_PHRASE})), a) ORDER BY i LIMIT 1), '') AS grp FROM customer")
def t22_words(spark, d):
    return load(spark, d, "customer").select("c_custkey", T.activity_group_of_words(F.expr(_PHRASE)).alias("grp"))


@query("u4_name_tokens", "SELECT p_partkey, len(list_distinct(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> ''))) AS n FROM part")
def u4(spark, d):
    return load(spark, d, "part").select("p_partkey", F.size(T.name_tokens(F.col("p_name"))).cast("long").alias("n"))


@query("a5_staff_and_reports", _with("company", "company_quarter", "statement", "income", rest=""", s AS (SELECT s.code, s.year, s.employees, row_number() OVER (PARTITION BY s.code, s.year ORDER BY i.turnover IS NULL, s.sid DESC) AS r FROM statement s LEFT JOIN income i ON i.sid = s.sid WHERE s.year IS NOT NULL),
rp AS (SELECT code, arg_max(employees, year) AS of_report, max(year) AS last_report FROM s WHERE r = 1 AND code % 10 > 0 GROUP BY code), lq AS (SELECT code, employees AS of_quarter FROM company_quarter WHERE code % 3 > 0 QUALIFY row_number() OVER (PARTITION BY code ORDER BY year DESC, q DESC) = 1)
SELECT c.code, coalesce(of_quarter, of_report) AS employees, last_report, coalesce(last_report < 1997 AND c.code % 17 > 0 AND c.status = 'R', false) AS overdue FROM company c LEFT JOIN lq USING (code) LEFT JOIN rp USING (code)"""))
def a5_staff(spark, d):
    c = load(spark, d, "company").withColumn("deleted", F.when(F.col("code") % 17 == 0, "2020-01-01"))
    r = registers.yearly_reports(load(spark, d, "statement"), load(spark, d, "income")).where("code % 10 > 0")
    return company.staff_and_reports(c, load(spark, d, "company_quarter").where("code % 3 > 0"), r, "1999-06-30")


@query("w4_reasons", _with("company", "company_quarter", rest=_HEALTH + """, e AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY year DESC, q DESC) AS r FROM company_quarter),
fy AS (SELECT code, year, CAST(sum(turnover) AS BIGINT) AS t, row_number() OVER (PARTITION BY code ORDER BY year DESC) AS k FROM e WHERE r <= 8 AND turnover IS NOT NULL GROUP BY code, year HAVING count(*) = 4),
o AS (SELECT h.* EXCLUDE (rule), CASE WHEN h.code % 2 = 1 THEN h.rule END AS given, c.status, c.overdue FROM h JOIN company c USING (code)),
d AS (SELECT *, coalesce(given, CASE health WHEN 'distressed' THEN CASE WHEN status IN ('N', 'L') THEN 'status' ELSE 'zero_taxes' END WHEN 'watch' THEN CASE WHEN overdue THEN 'report' ELSE 'turnover' END END) AS rule FROM o),
pair AS (SELECT a.code, b.year AS y0, b.t AS t0, a.year AS y1, a.t AS t1 FROM fy a JOIN fy b ON b.code = a.code AND a.k = 1 AND b.k = 2)
SELECT d.code, rule, CASE WHEN rule = 'turnover' THEN CASE WHEN given IS NULL THEN y0 ELSE from_year END END AS from_year, CASE WHEN rule = 'turnover' THEN CASE WHEN given IS NULL THEN t0 ELSE from_turnover END END AS from_turnover,
 CASE WHEN rule = 'turnover' THEN CASE WHEN given IS NULL THEN y1 ELSE to_year END END AS to_year, CASE WHEN rule = 'turnover' THEN CASE WHEN given IS NULL THEN t1 ELSE to_turnover END END AS to_turnover FROM d LEFT JOIN pair USING (code)"""))
def w4(spark, d):
    """Stored rows of companies with even codes lack rule and figures, as old ones do."""
    c, q = load(spark, d, "company"), load(spark, d, "company_quarter")
    told = F.col("code") % 2 == 1
    h = company.health(c, q).withColumns({n: F.when(told, F.col(n)) for n in ("rule", "from_year", "from_turnover", "to_year", "to_turnover")})
    kept = company.last_quarters(q, 8).groupBy("code").agg(F.collect_list(F.struct("year", "turnover")).alias("quarters"))
    return company.reasons(h.join(c.select("code", "status", "overdue"), "code").join(kept, "code", "left"))

"""Domain tables derived from the driver's tables by projections that read the same in Spark SQL and in the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plotline.session import dealt

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
STREET = "CASE {k} % 8 WHEN 0 THEN 'Aeru tn' WHEN 1 THEN 'Jõe tänav' WHEN 2 THEN 'Kesk maantee' WHEN 3 THEN 'Madruse tn' WHEN 4 THEN 'Klaose tee' WHEN 5 THEN 'Õie puiestee' WHEN 6 THEN 'Lille põik' ELSE 'Pargi allee' END || ' ' || CAST(1 + {k} % 50 AS STRING) || CASE WHEN {k} % 10 = 3 THEN 'b' ELSE '' END"
#: Addresses as registers write them: farms without a number, several alternates, flats, corner houses, commas, unknown streets, none.
FULL = "CASE WHEN {k} % 23 = 5 THEN CASE {k} % 3 WHEN 0 THEN 'Kasemäe' WHEN 1 THEN 'Vana-Jaani' ELSE 'Oru talu' END WHEN {k} % 19 = 4 THEN {street} || ' // ' || CAST(1 + {k} % 30 AS STRING) WHEN {k} % 29 = 7 THEN 'Lille põik ' || CAST(1 + {k} % 20 AS STRING) || 'a // ' || {street} || ' // ' || CAST(1 + {k} % 40 AS STRING) || 'B' WHEN {k} % 17 = 3 THEN {street} || '-12' WHEN {k} % 13 = 6 THEN {street} || '/3' WHEN {k} % 31 = 2 THEN {street} || '/2õ' WHEN {k} % 31 = 5 THEN {street} || '-1ä' WHEN {k} % 31 = 9 THEN 'Jo\u0303e tänav ' || CAST(1 + {k} % 50 AS STRING) || 'a\u0308' WHEN {k} % 41 = 1 THEN 'Olematu tänav 3.' WHEN {k} % 37 = 1 THEN '' ELSE {street} END"



def _full(k: str) -> str:
    return FULL.format(k=k, street="(" + STREET.format(k=k) + ")") + " AS full_address"


#: Turned footprints: width, depth, angle in radians, and middles far enough apart for rasters of one metre.
_W, _D, _A = "(10 + 2 * ({k} % 5))", "(6 + 2 * ({k} % 3))", "(({k} * 7) % 180 * 3.141592653589793 / 180)"
_CX, _CZ = "(CAST(floor({k} / 9) AS BIGINT) % 30 * 34 + 16)", "(CAST(floor({k} / 270) AS BIGINT) * 34 + 16)"


def _corners(table: str, k: str) -> str:
    """The corners of turned rectangles, every fifth with a corner cut out: shape, tile, seq, x, z."""
    whole = [("-1", "-1"), ("1", "-1"), ("1", "1"), ("-1", "1")]
    cut = [("-1", "-1"), ("1", "-1"), ("1", "1"), ("0", "1"), ("0", "0"), ("-1", "0")]
    a, w, d, cx, cz = (t.format(k=k) for t in (_A, _W, _D, _CX, _CZ))
    each = []
    for is_cut, ring in ((False, whole), (True, cut)):
        for seq, (u, v) in enumerate(ring):
            x, z = f"{u} * {w} / 2.0", f"{v} * {d} / 2.0"
            each.append(f"SELECT {k} AS shape, {k} % 9 AS tile, {seq} AS seq, {cx} + ({x}) * cos({a}) - ({z}) * sin({a}) AS x, {cz} + ({x}) * sin({a}) + ({z}) * cos({a}) AS z FROM {{{table}}} WHERE {k} % 5 {'=' if is_cut else '<>'} 0")
    return " UNION ALL ".join(each)


#: name -> (tables it reads, SQL with {table} holes)
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "parcel": (("part",), """
SELECT p_partkey AS pid, CAST(p_partkey AS STRING) AS tunnus, p_partkey % 9 AS tile, (p_partkey * 37) % 1024 AS x, (p_partkey * 61) % 1024 AS z,
       8 + p_partkey % 9 AS side,
       CASE p_partkey % 5 WHEN 0 THEN 'ELAMUMAA' WHEN 1 THEN 'ARIMAA' WHEN 2 THEN 'MAATULUNDUSMAA' WHEN 3 THEN 'TRANSPORDIMAA' ELSE NULL END AS purpose,
       CAST(p_size * 20 AS BIGINT) AS area,
       CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(floor(p_retailprice * p_size) AS BIGINT) END AS land_value,
       CASE p_partkey % 3 WHEN 0 THEN 'private' WHEN 1 THEN 'municipal' ELSE 'state' END AS ownership,
       """ + STREET.format(k="p_partkey") + """ AS address, """ + _full("p_partkey") + """,
       CASE WHEN p_partkey % 13 = 0 THEN 'korteriomand' WHEN p_partkey % 4 = 0 THEN CAST(100 + p_partkey % 97 AS STRING) ELSE NULL END AS land_registry,
       'vald' || CAST(p_partkey % 4 AS STRING) AS municipality, 'kyla' || CAST(p_partkey % 17 AS STRING) AS settlement, CASE WHEN p_partkey % 6 = 1 THEN NULL ELSE 'mk' || CAST(p_partkey % 3 AS STRING) END AS county
FROM {part}"""),
    "building": (("supplier",), """
SELECT s_suppkey AS bid, s_suppkey % 9 AS tile, (s_suppkey * 53) % 1024 AS x, (s_suppkey * 29) % 1024 AS z, 6 + s_suppkey % 7 AS w, 5 + s_suppkey % 5 AS d,
       CASE s_suppkey % 3 WHEN 0 THEN 'dwelling' WHEN 1 THEN 'outbuilding' ELSE 'other' END AS kind, CASE WHEN s_suppkey % 8 = 0 THEN NULL ELSE 1900 + s_suppkey % 120 END AS year,
       1 + s_suppkey % 5 AS floors, """ + STREET.format(k="s_suppkey") + """ AS address, """ + _full("s_suppkey") + """,
       CASE WHEN s_suppkey % 3 = 0 THEN 'A' || CAST(s_suppkey % 40 AS STRING) END AS adr_id, CASE WHEN s_suppkey % 5 = 1 THEN 'A' || CAST(40 + s_suppkey % 30 AS STRING) END AS aadr_id, CASE WHEN s_suppkey % 4 = 1 THEN """ + STREET.format(k="(s_suppkey * 3)") + """ END AS other_address, CASE WHEN s_suppkey % 4 <> 0 THEN (s_suppkey * 17) % 190 + 1 END AS pid
FROM {supplier}"""),
    "company": (("customer",), """
SELECT c_custkey AS code, c_name AS name, CASE c_custkey % 11 WHEN 0 THEN 'L' WHEN 1 THEN 'N' ELSE 'R' END AS status, c_custkey % 11 > 1 AS active,
       CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END AS sector, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 50 END AS employees,
       CAST(floor(c_acctbal) AS BIGINT) AS turnover, CAST(CASE WHEN c_custkey % 53 = 1 THEN -c_custkey ELSE (c_custkey * 7) % 900 + 1 END AS STRING) AS tunnus, """ + STREET.format(k="(c_custkey * 11)") + """ AS address,
       CASE c_custkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'street' ELSE 'exact' END AS match, c_custkey % 13 = 0 AS overdue,
       """ + _full("(c_custkey * 11)") + """, CASE WHEN c_custkey % 6 = 0 THEN 'A' || CAST(c_custkey % 90 AS STRING) END AS adr_id,
       lpad(CAST((c_custkey * 613) % 100000 AS STRING), 5, '0') AS activity, CASE c_custkey % 3 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS activity_version,
       'kyla' || CAST(c_custkey % 23 AS STRING) AS settlement, CASE c_custkey % 7 WHEN 0 THEN 'FIE' WHEN 1 THEN 'Korteriühistu' WHEN 2 THEN 'AS' ELSE 'OÜ' END AS legal_form
FROM {customer}"""),
    "company_quarter": (("orders",), """
SELECT code, year, q, cents, employees, CASE WHEN (code + year) % 9 = 0 OR (code + q) % 5 = 0 THEN NULL WHEN code % 14 = 0 THEN 0 ELSE CAST(floor(cents / 2000) AS BIGINT) END AS labour, CASE WHEN (code + q) % 5 = 0 THEN NULL WHEN code % 7 = 0 THEN 0 ELSE CAST(floor(cents / 1000) AS BIGINT) END AS taxes,
       CASE WHEN (code + q + year) % 6 = 0 THEN NULL WHEN code % 3 = 0 AND year % 2 = 0 THEN CAST(floor(cents / 400) AS BIGINT) ELSE CAST(floor(cents / 100) AS BIGINT) END AS turnover
FROM (SELECT o_custkey AS code, CAST(year(o_orderdate) AS INT) AS year, CAST(quarter(o_orderdate) AS INT) AS q, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents, count(*) AS employees
      FROM {orders} GROUP BY 1, 2, 3) x"""),
    "holding": (("lineitem",), "SELECT DISTINCT l_orderkey AS owner, CAST(l_partkey AS STRING) AS tunnus FROM {lineitem}"),
    "stop_time": (("lineitem",), "SELECT trip, stop, seq, (trip * 7 + seq * 3) % 1600 AS minute FROM (SELECT l_orderkey AS trip, l_suppkey AS stop, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS INT) AS seq FROM {lineitem}) x"),
    "trip": (("orders",), "SELECT o_orderkey AS trip, CASE o_orderkey % 5 WHEN 0 THEN '2' WHEN 1 THEN '10' WHEN 2 THEN '25C' WHEN 3 THEN '25' ELSE 'A1' END AS line, 'to ' || o_orderpriority AS headsign, o_custkey % 7 AS service FROM {orders}"),
    "cell": (("lineitem",), "SELECT l_suppkey % 4 AS tile, l_orderkey % 48 AS y, l_partkey % 48 AS x, max(l_quantity) AS v FROM {lineitem} GROUP BY 1, 2, 3"),
    "point": (("lineitem",), """
SELECT l_suppkey % 4 AS tile, CAST(floor(l_extendedprice) AS BIGINT) % 64 AS px, (l_orderkey * 13 + l_linenumber) % 64 AS py, l_quantity / 4.0 AS h,
       CASE l_linenumber % 7 WHEN 0 THEN 7 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 5 WHEN 4 THEN 6 WHEN 5 THEN 9 ELSE 17 END AS cls, 1 + l_linenumber % 3 AS n_returns
FROM {lineitem}"""),
    "road": (("orders",), """
SELECT o_orderkey AS rid, CAST(o_custkey % 1000 AS BIGINT) AS tile, (o_orderkey % 4) * 64 AS ax, CAST(floor(o_orderkey / 4) AS BIGINT) % 4 * 64 AS az, (o_orderkey + 1 + o_orderkey % 2) % 4 * 64 AS bx, (CAST(floor(o_orderkey / 4) AS BIGINT) + o_orderkey % 3) % 4 * 64 AS bz,
       CASE o_orderkey % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'local' WHEN 2 THEN 'path' ELSE 'service' END AS kind, CASE o_orderkey % 4 WHEN 0 THEN 7 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 4 END AS width, o_orderpriority AS name
FROM {orders}"""),
    "poi": (("events",), """
SELECT event_id AS poi, CASE event_type WHEN 'click' THEN 'shop' WHEN 'view' THEN 'cafe' WHEN 'purchase' THEN 'bank' ELSE event_type END AS key, event_id % 9 AS tile, (event_id * 31) % 1024 AS x, (event_id * 47) % 1024 AS z,
       CASE event_id % 7 WHEN 0 THEN '24/7' WHEN 1 THEN 'Mo-Fr 08:00-12:00,13:00-17:00' WHEN 2 THEN 'Fr,Sa 11:00-02:00' WHEN 3 THEN 'Mo-Su 10:00-20:00; Su off' WHEN 4 THEN 'PH off' WHEN 5 THEN 'sunrise-sunset' ELSE 'Sa-Mo 09:00-15:30' END AS opening_hours
FROM {events}"""),
    "officer": (("orders",), """
SELECT o_orderkey AS oid, o_custkey AS code, CASE o_orderkey % 6 WHEN 0 THEN 'HRB ' || CAST(o_orderkey % 50 AS STRING) WHEN 1 THEN '--' WHEN 2 THEN 'Pole' ELSE CAST(1000000 + o_orderkey % 300 AS STRING) END AS raw,
       CASE o_orderkey % 5 WHEN 0 THEN 'JUHL' WHEN 1 THEN 'JUHE' WHEN 2 THEN 'OSAN' WHEN 3 THEN 'OSAN' ELSE 'TOSA' END AS role, o_orderstatus = 'F' AS ended
FROM {orders}"""),
    "proceeding": (("orders",), """
SELECT o_orderkey AS proceeding, o_custkey AS code, CASE o_orderkey % 9 WHEN 0 THEN 'INSOLVENCY' WHEN 1 THEN 'PROTECTION' WHEN 2 THEN 'RESTRUCTURING' WHEN 3 THEN NULL ELSE 'LIQUIDATION' END AS form, o_orderstatus <> 'O' OR o_orderkey % 4 > 0 AS ended
FROM {orders}"""),
    "statement": (("orders",), "SELECT o_orderkey AS sid, o_custkey AS code, CASE WHEN o_orderkey % 11 > 0 THEN CAST(year(o_orderdate) AS INT) END AS year, o_orderkey % 40 AS employees, o_orderkey % 3 = 0 AS thousands FROM {orders}"),
    "income": (("lineitem",), "SELECT l_orderkey AS sid, CAST(floor(max(l_extendedprice)) AS BIGINT) AS turnover FROM {lineitem} WHERE l_orderkey % 4 > 0 GROUP BY l_orderkey"),
    "pixel": (("lineitem",), """
SELECT l_orderkey * 10 + l_linenumber AS pixel, CAST((l_orderkey * 7) % 101 AS DOUBLE) / 100 AS r, CAST((l_partkey * 13) % 101 AS DOUBLE) / 100 AS g, CAST((l_suppkey * 29 + l_orderkey) % 101 AS DOUBLE) / 100 AS b, CASE WHEN l_orderkey % 5 > 0 THEN CAST(l_linenumber AS DOUBLE) / 2 END AS canopy
FROM {lineitem}"""),
    "street": (("orders",), """
SELECT k AS rid, tile, 64.0 * (k % 4) + 0.3 * (k % 5) AS ax, 64.0 * (r % 4) AS az, 64.0 * ((k + 1 + k % 2) % 4) + 0.3 * (r % 6) AS bx, 64.0 * ((r + k % 3) % 4) AS bz
FROM (SELECT o_orderkey AS k, CAST(o_custkey % 1000 AS BIGINT) AS tile, CAST(floor(o_orderkey / 4) AS BIGINT) AS r FROM {orders}) o"""),
    "track": (("orders",), """
SELECT k AS rid, tile, CASE WHEN k % 5 = 0 THEN 'rail' ELSE 'tram' END AS kind, 30.0 * (k % 4) AS ax, 2.9 * (r % 24) AS az, 30.0 * (k % 4) + 64 - 128 * (k % 2) AS bx, 2.9 * (r % 24) + 0.7 * (k % 7) AS bz
FROM (SELECT o_orderkey AS k, CAST(o_custkey % 300 AS BIGINT) AS tile, CAST(floor(o_orderkey / 4) AS BIGINT) AS r FROM {orders}) o"""),
    "corner": (("part",), _corners("part", "p_partkey")),
    "wall": (("supplier",), _corners("supplier", "s_suppkey")),
    "roof_cell": (("lineitem",), """
SELECT k % 9 AS tile, y, x, CASE WHEN k % 11 = 0 THEN 1.0 ELSE noise + CASE k % 4 WHEN 0 THEN 6.0 WHEN 1 THEN 3 + 4 * (1 - abs(v) / (d / 2.0)) WHEN 2 THEN 3 + 4 * (1 - abs(u) / (w / 2.0)) ELSE 3 + 4 * greatest(0.0, least(1.0, least(1 - abs(v) / (d / 2.0), (w / 2.0 - abs(u)) / (d / 2.0)))) END END AS v
FROM (SELECT k, y, x, noise, w, d, (x + 0.5 - cx) * cos(a) + (y + 0.5 - cz) * sin(a) AS u, (y + 0.5 - cz) * cos(a) - (x + 0.5 - cx) * sin(a) AS v
      FROM (SELECT k, i + cx - 16 AS x, j + cz - 16 AS y, noise, cx, cz, w, d, a
            FROM (SELECT k, i, j, max(q) / 100.0 AS noise, """ + ", ".join(f"{t.format(k='k')} AS {n}" for t, n in ((_CX, "cx"), (_CZ, "cz"), (_W, "w"), (_D, "d"), (_A, "a"))) + """
                  FROM (SELECT l_suppkey AS k, (l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 31 AS i, (l_partkey * 5 + l_orderkey + l_linenumber) % 31 AS j, CAST(l_quantity AS BIGINT) AS q FROM {lineitem}) r GROUP BY k, i, j) g) h) c"""),
}


#: Tables whose SQL numbers rows within a key, or takes different ones: the table it reads, and that key.
NUMBERED = {"stop_time": ("lineitem", "l_orderkey"), "holding": ("lineitem", "l_orderkey")}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a domain table derived from it."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs, sql = TABLES[name]
    tables = {n: load(spark, sf_dir, n) for n in needs}
    if name in NUMBERED:
        source, key = NUMBERED[name]
        tables[source] = dealt(tables[source], key)
    return spark.sql(sql, **tables)


def with_tables(*names: str, rest: str) -> str:
    """Oracle SQL: the named domain tables as common table expressions, then ``rest``."""
    parts = [f"{n} AS ({TABLES[n][1].format(**{t: t for t in BASE})})" for n in names]
    rest = rest.strip()
    return "WITH " + ", ".join(parts) + (", " + rest[5:] if rest.upper().startswith("WITH ") else " " + rest)

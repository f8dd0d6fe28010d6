"""The driver's tables, whole, as tables of a case: as DataFrames, and as common table expressions for the SQL twins.

Parts stand for persons, suppliers for reports, order lines for bank transactions, events for calls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.operators import graph as G

Read = Callable[[str], DataFrame]

_LETTERS = "'0123456789', 'bcdfghjkmn'"
CTE = {
    "person_": f"""SELECT *, CAST('0x' || substr(md5(name), 1, 7) AS BIGINT) % 10000000 AS h FROM (
        SELECT *, split_part(p_name, ' ', 1) || ' ' || lower(p_type) || translate(substr(p_brand, 7), {_LETTERS}) AS name FROM part)""",
    "person": """SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, 'F' || (p_partkey % 10) AS fir_id, name, 20 + p_size AS age,
        CASE p_partkey % 4 WHEN 0 THEN 'VICTIM' WHEN 1 THEN 'WITNESS' ELSE 'ACCUSED' END AS role, CASE p_size % 3 WHEN 0 THEN 'Aminabad' WHEN 1 THEN 'Chowk' END AS place,
        CASE WHEN p_size % 5 < 3 THEN '98' || lpad(CAST(h * 10 + p_size % 5 AS VARCHAR), 8, '0') END AS phone,
        CASE WHEN p_size % 7 = 0 THEN 'UP' || lpad(CAST(h % 100 AS VARCHAR), 2, '0') || 'A' || chr(CAST(65 + h // 1000000 AS INTEGER)) || lpad(CAST(h // 100 % 10000 AS VARCHAR), 4, '0') END AS vehicle,
        CASE WHEN p_size % 11 = 0 THEN '50' || lpad(CAST(h AS VARCHAR), 8, '0') END AS account_no FROM person_""",
    "fir": """SELECT 'F' || s_suppkey AS id, 'PS ' || (s_nationkey % 7) AS station, '2024-01-' || lpad(CAST(1 + s_suppkey % 28 AS VARCHAR), 2, '0') AS date, CAST(s_nationkey AS VARCHAR) AS section,
        CASE WHEN s_suppkey % 5 = 0 THEN 'राम ' ELSE '' END || s_name || ' called 98' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') || ' in UP14AB' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') AS narrative FROM supplier""",
    "bank_txn": """SELECT lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '-' || l_linenumber AS id, lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS account_no, 'Customer ' || o_custkey AS holder_name,
        CASE WHEN o_orderpriority <> '5-LOW' THEN '97' || lpad(CAST(o_custkey // 4 AS VARCHAR), 8, '0') END AS linked_phone,
        CASE l_returnflag WHEN 'R' THEN 'TRANSFER' WHEN 'A' THEN 'CREDIT' ELSE 'DEBIT' END AS txn_type, l_extendedprice AS amount, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS ts,
        CASE WHEN l_linestatus = 'O' THEN lpad(CAST(l_suppkey AS VARCHAR), 9, '0') ELSE 'SALARY' END AS counterpart FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "cdr": """SELECT 'C' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS id, '99' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS caller, event_type AS callee, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts,
        CAST(floor(value) AS INTEGER) AS duration_s, 'T' || (event_id % 8) AS tower_loc FROM events""",
    "vehicle_reg": """SELECT 'V' || vehicle AS id, vehicle AS reg_no, min(name) AS owner_name, 'Tata' AS make FROM person WHERE vehicle IS NOT NULL GROUP BY vehicle""",
    # what customers and suppliers have to do with each other
    "line": """SELECT o_custkey AS c, l_suppkey AS s, l_partkey AS p, l_orderkey AS o, l_linenumber AS i, l_quantity AS q, l_returnflag AS f, l_extendedprice AS x FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "deal": """SELECT a.s AS a, b.s AS b, count(*) AS n, count(*) FILTER (WHERE a.f = 'R' AND b.f = 'R' AND least(a.q, b.q) >= 45) AS moved,
        round(sum(a.x + b.x) FILTER (WHERE a.f = 'R' AND b.f = 'R' AND least(a.q, b.q) >= 45), 2) AS amount
        FROM line a JOIN line b ON a.o = b.o AND a.i < b.i AND a.s <> b.s AND a.q >= 40 AND b.q >= 40 GROUP BY 1, 2""",
    "owned": """SELECT DISTINCT 'S' || s AS thing, 'C' || c AS person FROM line WHERE q >= 49 AND f = 'R'""",
}
NEEDS = {"person": ["person_"], "vehicle_reg": ["person"], "deal": ["line"], "owned": ["line"]}


def ctes(*names: str) -> str:
    """WITH and the expressions named, each after those that it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({CTE[n]})" for n in order)


def display_sql(c: str) -> str:
    """SQL of a display name in Latin letters."""
    for pattern, by in ((V.HONORIFICS, " "), (V.RELATIONS, " "), (V.INITIALS, r"\1 "), (r"[^A-Za-z\s]", " "), (r"\s{2,}", " ")):
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
    return f"array_to_string(list_transform(string_split(trim({c}), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"


def phonetic_sql(display: str) -> str:
    c = f"lower({display})"
    for old, new in V.PHONETIC:
        c = f"replace({c}, '{old}', '{new}')"
    for letter in "abcdefghijklmnopqrstuvwxyz":
        c = f"regexp_replace({c}, '{letter}{letter}+', '{letter}', 'g')"
    return rf"regexp_replace(trim(regexp_replace({c}, '\s+', ' ', 'g')), '(\S\S)y(\s|$)', '\1i\2', 'g')"


def _pad(c: Column | str, n: int) -> Column:
    return F.lpad((F.col(c) if isinstance(c, str) else c).cast("string"), n, "0")


def persons(read: Read) -> DataFrame:
    part, size = read("part"), F.col("p_size")
    name = F.concat(F.substring_index("p_name", " ", 1), F.lit(" "), F.lower("p_type"), F.translate(F.substring("p_brand", 7, 99), "0123456789", "bcdfghjkmn"))
    rows = part.withColumn("name", name).withColumn("h", F.conv(F.substring(F.md5(F.col("name").cast("binary")), 1, 7), 16, 10).cast("long") % 10_000_000)
    places = F.when(size % 3 == 0, F.concat(F.lit("House "), size.cast("string"), F.lit(", Aminabad"))).when(size % 3 == 1, "Chowk")
    plate = F.concat(F.lit("UP"), _pad(F.col("h") % 100, 2), F.lit("A"), F.char(F.expr("65 + h div 1000000")), _pad(F.expr("h div 100 % 10000"), 4))
    blank = F.lit(None).cast("string")
    return rows.select(
        F.concat(F.lit("P"), _pad("p_partkey", 9)).alias("id"), F.concat(F.lit("F"), (F.col("p_partkey") % 10).cast("string")).alias("fir_id"), "name",
        blank.alias("alias"), blank.alias("father_name"), (size + 20).cast("string").alias("age"),
        F.when(F.col("p_partkey") % 4 == 0, "VICTIM").when(F.col("p_partkey") % 4 == 1, "WITNESS").otherwise("ACCUSED").alias("role"), places.alias("address"),
        F.when(size % 5 < 3, F.concat(F.lit("98"), _pad(F.col("h") * 10 + size % 5, 8))).alias("phone"), F.when(size % 7 == 0, plate).alias("vehicle"),
        F.when(size % 11 == 0, F.concat(F.lit("50"), _pad("h", 8))).alias("account_no"), blank.alias("imei"), blank.alias("notes"),
    )


def reports(read: Read) -> DataFrame:
    key = F.col("s_suppkey")
    hindi = F.when(key % 5 == 0, "राम ").otherwise("")
    narrative = F.concat(hindi, "s_name", F.lit(" called 98"), _pad(key, 8), F.lit(" in UP14AB"), _pad(key % 10000, 4))
    return read("supplier").select(
        F.concat(F.lit("F"), key.cast("string")).alias("id"), F.concat(F.lit("PS "), (F.col("s_nationkey") % 7).cast("string")).alias("station"),
        F.concat(F.lit("2024-01-"), _pad(key % 28 + 1, 2)).alias("date"), F.col("s_nationkey").cast("string").alias("section"), narrative.alias("narrative"),
    )


def bank(read: Read) -> DataFrame:
    lines = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(
        F.concat(_pad("l_orderkey", 9), F.lit("-"), F.col("l_linenumber").cast("string")).alias("id"), _pad("o_custkey", 9).alias("account_no"), F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("holder_name"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("97"), _pad(F.expr("o_custkey div 4"), 8))).alias("linked_phone"),
        F.when(F.col("l_returnflag") == "R", "TRANSFER").when(F.col("l_returnflag") == "A", "CREDIT").otherwise("DEBIT").alias("txn_type"),
        F.col("l_extendedprice").alias("amount"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
        F.when(F.col("l_linestatus") == "O", _pad("l_suppkey", 9)).otherwise("SALARY").alias("counterpart"),
    )


def calls(read: Read) -> DataFrame:
    return read("events").select(
        F.concat(F.lit("C"), _pad("event_id", 9)).alias("id"), F.concat(F.lit("99"), _pad("user_id", 8)).alias("caller"), F.col("event_type").alias("callee"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.floor("value").cast("int").alias("duration_s"), F.concat(F.lit("T"), (F.col("event_id") % 8).cast("string")).alias("tower_loc"),
    )


def vehicles(read: Read) -> DataFrame:
    blank = F.lit(None).cast("string")
    owned = persons(read).filter("vehicle IS NOT NULL").groupBy(F.col("vehicle").alias("reg_no")).agg(F.min("name").alias("owner_name"))
    return owned.select(F.concat(F.lit("V"), "reg_no").alias("id"), "reg_no", "owner_name", F.lit("Tata").alias("make"), blank.alias("model"), blank.alias("colour"), blank.alias("chassis_no"))


def case(read: Read) -> dict[str, DataFrame]:
    return {"fir": reports(read), "person": persons(read), "cdr": calls(read), "bank_txn": bank(read), "vehicle_reg": vehicles(read)}


def trade(read: Read) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) in the form of :func:`graph.build`: large returned lots are owned, lots of one order call each other."""
    tag = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    lines = read("lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("f"), F.col("l_extendedprice").alias("x"))
    sold = lines.filter("q >= 49").join(read("orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c")), "o")
    owns = sold.filter("f = 'R'").select(tag("C", "c").alias("src"), tag("S", "s").alias("dst"), F.lit("OWNS").alias("etype")).distinct()
    named = sold.filter("q >= 50").select(tag("C", "c").alias("src"), tag("FIR:", "p").alias("dst"), F.lit("NAMED_IN").alias("etype")).distinct()
    lots = lines.filter("q >= 40")
    later = lots.select("o", *[F.col(k).alias(f"{k}2") for k in "siqfx"])
    deals = lots.join(later, "o").filter("i < i2 AND s <> s2")
    deals = deals.join(read("orders").select(F.col("o_orderkey").alias("o")), "o", "left_semi")
    back = (F.col("f") == "R") & (F.col("f2") == "R") & (F.least("q", "q2") >= 45)
    met = deals.groupBy(tag("S", "s").alias("src"), tag("S", "s2").alias("dst")).agg(F.count("*").alias("count"), F.count_if(back).alias("moved"), F.round(F.sum(F.when(back, F.col("x") + F.col("x2"))), 2).alias("amount"))
    called = met.select("src", "dst", F.lit("CALLED").alias("etype"), "count")
    moved = met.filter("moved > 0").select("src", "dst", F.lit("TRANSFERRED_TO").alias("etype"), F.col("moved").alias("count"), "amount")
    edges = G._all([G._fit(e, G.EDGE) for e in (owns, named, called, moved)])
    buyers = read("customer").select(tag("C", "c_custkey").alias("id"), F.lit("Person").alias("type"), F.col("c_name").alias("label"), F.when(F.col("c_mktsegment") == "BUILDING", "ACCUSED").otherwise("WITNESS").alias("role"), F.array(tag("C", "c_custkey")).alias("records"))
    sellers = read("supplier").select(tag("S", "s_suppkey").alias("id"), F.lit("Account").alias("type"), F.col("s_name").alias("label"))
    return G._all([G._fit(n, G.NODE) for n in (buyers, sellers)]), edges

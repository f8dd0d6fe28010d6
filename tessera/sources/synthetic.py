"""A made-up case of any size, the same for the same seed, with known truth planted in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GIVEN = ["Asha", "Bela", "Chetan", "Dilip", "Esha", "Farid", "Gita", "Harish", "Indu", "Jatin"]
FAMILY = ["Bose", "Datta", "Ghosh", "Iyer", "Joshi", "Kale", "Lobo", "Mehra", "Naik", "Oza", "Patil", "Rane"]
PLACES = ["Aminabad", "Chowk", "Aliganj", "Chinhat"]
#: Planted persons: of each, records on reports of several stations that share a phone.
TWICE = 5


def _pick(values: list[str], seed: int, salt: int, key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(key, F.lit(seed), F.lit(salt)), F.lit(len(values))) + 1).cast("int"))


def _number(seed: int, salt: int, key: Column, digits: int) -> Column:
    return F.lpad(F.pmod(F.xxhash64(key, F.lit(seed), F.lit(salt)), F.lit(10**digits)).cast("string"), digits, "0")


def case(spark: SparkSession, seed: int = 7, reports: int = 60) -> tuple[dict[str, DataFrame], dict]:
    """The five tables of a case, and its truth: ``together`` (name to record ids), ``apart``, ``device``, ``loop``, ``caller``."""
    rid = F.col("id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.xxhash64(rid, F.lit(seed)), F.lit(60)).cast("int")), "yyyy-MM-dd")
    fir = spark.range(reports).select(text("F", rid).alias("id"), text("PS ", rid % 6).alias("station"), day.alias("date"), F.lit("318").alias("section"), text("Report ", rid).alias("narrative"))

    blank = F.lit(None).cast("string")
    made = spark.range(3 * reports).select(
        (rid % reports).alias("f"), text(_pick(GIVEN, seed, 1, rid), " ", _pick(FAMILY, seed, 2, rid)).alias("name"), F.when(rid % 3 == 0, "VICTIM").when(rid % 3 == 1, "WITNESS").otherwise("ACCUSED").alias("role"),
        text(_pick(PLACES, seed, 3, rid)).alias("address"), (20 + F.pmod(F.xxhash64(rid, F.lit(seed), F.lit(4)), F.lit(40))).cast("string").alias("age"), text("91", _number(seed, 5, rid, 8)).alias("phone"),
    )
    planted = spark.range(2 * TWICE).select(
        rid.alias("f"), text("Planted", _pick(GIVEN, seed, 6, rid % TWICE), " ", F.element_at(F.array(*map(F.lit, FAMILY)), (rid % TWICE + 1).cast("int"))).alias("name"), F.lit("ACCUSED").alias("role"),
        F.lit("Chowk").alias("address"), F.lit("33").alias("age"), text("93", F.lpad((rid % TWICE).cast("string"), 8, "0")).alias("phone"),
    )
    # records are numbered within their report
    by = Window.partitionBy("f").orderBy("role", "name", "phone")
    rows = made.unionByName(planted).withColumn("n", F.row_number().over(by))
    person = rows.select(
        text("P", F.col("f"), "-", F.col("n")).alias("id"), text("F", F.col("f")).alias("fir_id"), "name", blank.alias("alias"), blank.alias("father_name"), "age", "role", "address", "phone",
        blank.alias("vehicle"), blank.alias("account_no"), blank.alias("imei"), blank.alias("notes"),
    )

    stamp = lambda seconds: F.date_format(F.timestamp_seconds(F.lit(1704067200) + seconds), "yyyy-MM-dd'T'HH:mm:ss")
    quiet = spark.range(10 * reports).select(text("C", rid).alias("id"), text("94", _number(seed, 7, rid, 8)).alias("caller"), text("95", _number(seed, 8, rid, 8)).alias("callee"), stamp(rid * 3607).alias("ts"), (rid % 300).cast("int").alias("duration_s"), text("T", rid % 9).alias("tower_loc"))
    burst = spark.range(8).select(text("B", rid).alias("id"), F.lit("9600000001").alias("caller"), text("95", F.lpad(rid.cast("string"), 8, "0")).alias("callee"), stamp(rid * 240).alias("ts"), F.lit(30).alias("duration_s"), F.lit("T1").alias("tower_loc"))

    spent = spark.range(5 * reports).select(text("X", rid).alias("id"), text("7", _number(seed, 9, rid, 10)).alias("account_no"), text("Holder ", rid).alias("holder_name"), text("97", _number(seed, 10, rid, 8)).alias("linked_phone"), F.when(rid % 2 == 0, "DEBIT").otherwise("CREDIT").alias("txn_type"), (rid * 10 + 0.5).alias("amount"), stamp(rid * 977).alias("ts"), F.lit("SHOP").alias("counterpart"))
    loop = spark.range(3).select(text("L", rid).alias("id"), text("80000000", rid).alias("account_no"), text("Mule ", rid).alias("holder_name"), F.lit("9800000009").alias("linked_phone"), F.lit("TRANSFER").alias("txn_type"), (90000.0 - rid * 1000).alias("amount"), stamp(rid * 86400).alias("ts"), text("80000000", (rid + 1) % 3).alias("counterpart"))
    car = spark.range(reports).select(text("V", rid).alias("id"), text("UP", F.lpad((rid % 80).cast("string"), 2, "0"), "ZZ", F.lpad(rid.cast("string"), 4, "0")).alias("reg_no"), text(_pick(GIVEN, seed, 11, rid), " ", _pick(FAMILY, seed, 12, rid)).alias("owner_name"), F.lit("Tata").alias("make"), F.lit("Nexon").alias("model"), F.lit("Red").alias("colour"), rid.cast("string").alias("chassis_no"))

    tables = {"fir": fir, "person": person, "cdr": quiet.unionByName(burst), "bank_txn": spent.unionByName(loop), "vehicle_reg": car}
    twice = person.filter(F.startswith("phone", F.lit("93"))).filter("role = 'ACCUSED'").groupBy("phone").agg(F.array_sort(F.collect_list("id")).alias("ids")).orderBy("phone").collect()
    groups = [list(r["ids"]) for r in twice]
    truth = {"together": {f"planted {i}": ids for i, ids in enumerate(groups)}, "apart": [(a[0], b[0]) for a, b in zip(groups, groups[1:])], "device": "9800000009", "loop": ["800000000", "800000001", "800000002"], "caller": "9600000001"}
    return tables, truth

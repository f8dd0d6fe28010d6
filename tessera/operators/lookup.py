"""Reading: details by id, timeline, search, feedback, alert sources and export.  Victims never show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import similarity as S
from tessera.functions import text as X
from tessera.operators.components import cut

LARGE_AMOUNT, RELEVANT = 50_000, 60.0


def person(tables: dict[str, DataFrame], resolved: dict[str, DataFrame], pid: str) -> dict[str, DataFrame]:
    """golden, records, match_evidence, pending_review and timeline of a record or its entity."""
    own = resolved["members"].filter(F.col("id") == pid).select("master_id")
    ids = resolved["members"].join(own, "master_id", "left_semi").select("id")
    ids = ids.unionByName(tables["person"].filter(F.col("id") == pid).select("id")).distinct()
    reports = tables["fir"].select(F.col("id").alias("fir_id"), "station", "date", "section")
    records = tables["person"].filter("role <> 'VICTIM'").join(ids, "id", "left_semi").join(reports, "fir_id").orderBy("date", "id")
    inside = lambda c: ids.withColumnRenamed("id", c)
    evidence = resolved["pairs"].join(inside("id_a"), "id_a", "left_semi").join(inside("id_b"), "id_b", "left_semi").orderBy(F.desc("score"))
    asked = resolved["review"].select("id_a", "id_b", "score")
    touching = asked.join(inside("id_a"), "id_a", "left_semi").unionByName(asked.join(inside("id_b"), "id_b", "left_semi")).distinct()
    golden = resolved["masters"].filter(F.array_contains("members", pid))
    return {"golden": golden, "records": records, "match_evidence": evidence, "pending_review": touching, "timeline": timeline(tables, records)}


def timeline(tables: dict[str, DataFrame], records: DataFrame) -> DataFrame:
    """ts, kind and text of reports, months of calls, and large transactions, in order."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    parts = [records.select(F.col("date").alias("ts"), F.lit("FIR").alias("kind"), F.lit(0).alias("ord"), text(F.col("fir_id"), " at ", F.col("station"), " (", F.col("section"), ") as '", F.col("name"), "'").alias("text"))]
    if "cdr" in tables:
        phones = records.filter("phone IS NOT NULL").select(F.col("phone").alias("caller")).distinct()
        months = tables["cdr"].join(phones, "caller", "left_semi").groupBy(F.substring("ts", 1, 7).alias("m")).agg(F.count("*").alias("n"), F.countDistinct("callee").alias("k"))
        parts.append(months.select(text(F.col("m"), "-28").alias("ts"), F.lit("CDR").alias("kind"), F.lit(1).alias("ord"), text(F.col("n"), " outgoing calls to ", F.col("k"), " numbers in ", F.col("m")).alias("text")))
    accounts = records.filter("account_no IS NOT NULL").select("account_no").distinct()
    large = tables["bank_txn"].filter(F.col("amount") >= LARGE_AMOUNT).join(accounts, "account_no", "left_semi")
    parts.append(large.select(F.substring("ts", 1, 10).alias("ts"), F.lit("BANK").alias("kind"), F.lit(2).alias("ord"), text(F.col("txn_type"), " Rs ", F.format_number("amount", 0), " -> ", F.coalesce("counterpart", F.lit(""))).alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("ts", "ord", "text").select("ts", "kind", "text")


def phone(tables: dict[str, DataFrame], number: str) -> dict[str, DataFrame]:
    calls = tables["cdr"].filter(F.col("caller") == number)
    return {
        "calls": calls.agg(F.count("*").alias("n"), F.countDistinct("callee").alias("k"), F.min("ts").alias("first"), F.max("ts").alias("last")),
        "towers": calls.groupBy("tower_loc").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tower_loc").limit(5),
        "owners": _seen(tables, "phone", number),
        "kyc_accounts": tables["bank_txn"].filter(F.col("linked_phone") == number).select("account_no", "holder_name").distinct(),
    }


def _seen(tables: dict[str, DataFrame], field: str, value: str) -> DataFrame:
    return tables["person"].filter((F.col(field) == value) & (F.col("role") != "VICTIM")).select("id", "name", "role", "fir_id")


def account(tables: dict[str, DataFrame], number: str) -> dict[str, DataFrame]:
    own = tables["bank_txn"].filter(F.col("account_no") == number)
    incoming = tables["bank_txn"].filter((F.col("counterpart") == number) & (F.col("txn_type") == "TRANSFER"))
    return {
        "holder": own.agg(F.min_by(F.struct("holder_name", "linked_phone"), "id").alias("h")).filter("h IS NOT NULL").select("h.*"),
        "summary": own.groupBy("txn_type").agg(F.count("*").alias("n"), F.sum("amount").alias("total")),
        "incoming": incoming.groupBy(F.col("account_no").alias("from_acct")).agg(F.sum("amount").alias("total"), F.count("*").alias("n")),
    }


def vehicle(tables: dict[str, DataFrame], plate: str) -> dict[str, DataFrame]:
    return {"rto": tables["vehicle_reg"].filter(F.col("reg_no") == plate), "seen_with": _seen(tables, "vehicle", plate)}


def report(tables: dict[str, DataFrame], fid: str) -> dict[str, DataFrame]:
    people = tables["person"].filter(F.col("fir_id") == fid)
    return {"fir": tables["fir"].filter(F.col("id") == fid), "persons": people.filter("role <> 'VICTIM'").select("id", "name", "role"), "victims_protected": people.agg(F.count_if(F.col("role") == "VICTIM").alias("n"))}


def lookup(tables: dict[str, DataFrame], resolved: dict[str, DataFrame], node: str) -> dict:
    """Details of a node by the prefix of its id; {'protected': True} for opaque ids."""
    prefix, _, rest = node.partition(":")
    if rest.startswith("V-"):
        return {"protected": True}
    handlers = {"PH": phone, "ACCT": account, "VEH": vehicle, "FIR": report}
    return handlers[prefix](tables, rest) if prefix in handlers and rest else person(tables, resolved, node)


def _reachable(term: str, c: Column) -> Column:
    """Texts that share characters enough with the term to be RELEVANT, others null.

    A likeness of r takes a common subsequence of at least r / (200 - r) of the shorter text.
    """
    shared = [F.least(F.lit(term.count(ch)), F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))) for ch in sorted(set(term))]
    common = shared[0]
    for n in shared[1:]:
        common = common + n
    return F.when(common * (200 - RELEVANT) >= F.least(F.length(c), F.lit(len(term))) * RELEVANT, c)


def search(tables: dict[str, DataFrame], term: str, top: int = 50) -> tuple[DataFrame, int]:
    """The ``top`` most relevant persons, vehicles, accounts and phones, and how many there are."""
    term = term.strip().lower()
    if not term:
        raise ValueError("nothing to search for")

    def best(*columns: Column) -> Column:
        found = [F.coalesce(S.partial_udf(F.lit(term), _reachable(term, F.lower(c))), F.lit(0.0)) for c in columns]
        return F.greatest(*found) if len(found) > 1 else found[0]

    # short rows take long to score, so their number of tasks is not left to their size
    lots = int(tables["person"].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    victims = tables["person"].filter("role = 'VICTIM' AND account_no IS NOT NULL").select("account_no").distinct()
    people = tables["person"].filter("role <> 'VICTIM'").select("id", "name", "alias", "phone", "address").repartition(lots, "id").withColumn("latin", X.display_name("name"))
    persons = people.select(F.lit("Person").alias("type"), "id", F.col("name").alias("label"), best(F.col("name"), F.col("latin"), F.col("alias"), F.col("phone"), F.col("address")).alias("relevance"), F.lit(0).alias("ord"))
    cars = tables["vehicle_reg"].select(F.lit("Vehicle").alias("type"), "id", F.col("reg_no").alias("label"), best(F.col("reg_no"), F.col("owner_name")).alias("relevance"), F.lit(1).alias("ord"))
    held = tables["bank_txn"].join(victims, "account_no", "left_anti").select("account_no", "holder_name").distinct().repartition(lots, "holder_name")
    accounts = held.select(F.lit("Account").alias("type"), F.concat(F.lit("ACCT:"), "account_no").alias("id"), F.col("account_no").alias("label"), best(F.col("account_no"), F.col("holder_name")).alias("relevance"), F.lit(2).alias("ord"))
    out = persons.unionByName(cars).unionByName(accounts)
    if "cdr" in tables:
        secret = tables["person"].filter("role = 'VICTIM' AND phone IS NOT NULL").select(F.col("phone").alias("caller")).distinct()
        callers = tables["cdr"].select("caller").distinct().join(secret, "caller", "left_anti").filter(F.contains("caller", F.lit(term)))
        out = out.unionByName(callers.select(F.lit("Phone").alias("type"), F.concat(F.lit("PH:"), "caller").alias("id"), F.col("caller").alias("label"), F.lit(80.0).alias("relevance"), F.lit(3).alias("ord")))
    found = out.filter(F.col("relevance") >= RELEVANT)
    by = Window.partitionBy("id").orderBy(F.desc("relevance"), "ord", "label")
    # worked out once for the listing and the number
    unique = cut(found.withColumn("place", F.row_number().over(by)).filter("place = 1").drop("place"))
    return unique.orderBy(F.desc("relevance"), "ord", "id").drop("ord").limit(top), unique.count()


VERDICTS = ["tp", "fp", "tn", "fn"]


def feedback_row(alerts: DataFrame, alert_id: str, verdict: str, analyst: str, ts: str, note: str = "") -> DataFrame:
    """A row for the feedback log; verdict and alert are checked."""
    if verdict not in VERDICTS:
        raise ValueError(f"verdict is one of {', '.join(VERDICTS)}")
    known = alerts.filter(F.col("alert_id") == alert_id)
    if known.isEmpty():
        raise KeyError(alert_id)
    return known.select("alert_id", "rule", F.lit(verdict).alias("verdict"), F.lit(analyst).alias("analyst"), F.lit(note).alias("note"), F.lit(ts).alias("ts"))


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """rule, its verdict counts, and precision: tp / (tp + fp), null without either."""
    counted = feedback.groupBy("rule").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
    return counted.withColumn("precision", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 3))


def with_verdicts(alerts: DataFrame, feedback: DataFrame) -> DataFrame:
    """Alerts with the latest verdict on each."""
    last = feedback.groupBy("alert_id").agg(F.max_by("verdict", "ts").alias("verdict"))
    return alerts.join(last, "alert_id", "left").orderBy(F.desc("confidence"), "alert_id")


#: Source ids that every task may hold, and of more, those that a task sorts the rows for.
FEW, NAMED = 100_000, 25_000


def alert_sources(alerts: DataFrame, tables: dict[str, DataFrame], each: int = 5) -> DataFrame:
    """alert_id, source_id, table and record (JSON): up to ``each`` rows of every table a source id names.

    Rows are chosen once for a source id, however many alerts name it.  A few ids first sift the tables; for many, all
    rows are sorted by id, in tasks whose number grows with that of the ids.
    """
    ids = cut(alerts.select("alert_id", F.explode("source_ids").alias("source_id")).filter("source_id IS NOT NULL").distinct())
    wanted = ids.select("source_id").distinct()
    many = wanted.count()
    lots, out = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-many // NAMED)), None
    for table, key in (("fir", "id"), ("cdr", "id"), ("bank_txn", "id"), ("bank_txn", "account_no")):
        if table not in tables:
            continue
        rows = tables[table].select(F.col(key).alias("source_id"), F.col("id").alias("row_id"), F.struct(*tables[table].columns).alias("row")).filter("source_id IS NOT NULL")
        rows = rows.join(F.broadcast(wanted), "source_id", "left_semi") if many <= FEW else rows.repartition(lots, "source_id")
        by = Window.partitionBy("source_id").orderBy("row_id")
        chosen = rows.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= each)
        found = ids.join(chosen, "source_id").select("alert_id", "source_id", F.lit(table).alias("table"), "row_id", F.to_json("row").alias("record"))
        out = found if out is None else out.unionByName(found)
    return out


def case_stats(tables: dict[str, DataFrame], extracted: DataFrame | None = None) -> DataFrame:
    """what and n: rows a table (0 for one that is missing), languages and span labels."""
    spark = next(iter(tables.values())).sparkSession
    out = spark.createDataFrame([(t, 0) for t in ("fir", "person", "cdr", "bank_txn", "vehicle_reg") if t not in tables], "what string, n long")
    for name, df in tables.items():
        out = out.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n"))
    if extracted is not None:
        out = out.unionByName(extracted.groupBy(F.concat(F.lit("lang:"), "lang").alias("what")).agg(F.count("*").alias("n")))
        out = out.unionByName(extracted.select(F.explode("spans.label").alias("l")).groupBy(F.concat(F.lit("span:"), "l").alias("what")).agg(F.count("*").alias("n")))
    return out


def report_list(tables: dict[str, DataFrame], extracted: DataFrame) -> DataFrame:
    """Reports with language and number of spans, Hindi ones first, then by date."""
    found = extracted.select(F.col("fir_id").alias("id"), "lang", "transliteration", F.size("spans").alias("size"))
    joined = tables["fir"].join(found, "id", "left").withColumn("n_spans", F.coalesce("size", F.lit(0))).drop("size")
    return joined.orderBy((F.col("lang") == "hi").desc_nulls_last(), "date", "id")

"""Registered queries with known answers: operators that SQL cannot work out, on literal rows beside what they must give.

Answers were worked out by hand or follow from the definitions; the SQL twins only list them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import similarity as S
from tessera.functions import spans as N
from tessera.functions import text as X
from tessera.operators import graph as G
from tessera.operators import hashing as H
from tessera.operators import ledger as K
from tessera.operators import lookup as L
from tessera.operators import resolution as R
from tessera.operators import rules
from tessera.operators.components import shared_dir
from tessera.plans.catalog import ORACLE_SQL, QUERIES


def known(columns: str, *rows: tuple):
    """Registers a function of a session together with the rows it must give."""

    def literal(value) -> str:
        if value is None or isinstance(value, bool):
            return "NULL" if value is None else str(value).lower()
        if isinstance(value, str):
            return "'" + value.replace("'", "''") + "'"
        return f"CAST({value} AS {'DOUBLE' if isinstance(value, float) else 'BIGINT'})"

    def widened(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])

    def add(function):
        QUERIES[function.__name__] = lambda spark, sf_dir: widened(function(spark))
        ORACLE_SQL[function.__name__] = f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS known({', '.join(f'"{c}"' for c in columns.split(', '))})"
        return function

    return add


def _text(c, by: str = "|"):
    return F.array_join(c, by)


# --- names and identifiers -------------------------------------------------------------------------


@known(
    "name, hindi, latin, display, phonetic, surname, weight",
    ("राकेश कुमार यादव", True, "raakesh kumaar yaadav", "Raakesh Kumaar Yaadav", "rakesh kumar yadav", "yadav", 0.55),
    ("चन्द्र ज़मीन", True, "chandra zameen", "Chandra Zameen", "chandra jamin", "jamin", 1.0),
    ("कमल। १२३", True, "kamala. 123", "Kamala", "kamala", "kamala", 1.0),
    ("Smt. Sunita Devi", False, "Smt. Sunita Devi", "Sunita Devi", "sunita devi", "devi", 0.55),
    ("R.K. Sen s/o Mahesh", False, "R.K. Sen s/o Mahesh", "R K Sen Mahesh", "r k sen mahesh", "mahesh", 1.0),
    ("Md. Imran Qureshi", False, "Md. Imran Qureshi", "Imran Qureshi", "imran kureshi", "kureshi", 1.0),
    ("Vicky Roy", False, "Vicky Roy", "Vicky Roy", "vicki roi", "roi", 1.0),
    ("Phool Wazir", False, "Phool Wazir", "Phool Wazir", "ful vajir", "vajir", 1.0),
    ("", False, "", "", "", "", 1.0),
)
def known_names(spark: SparkSession) -> DataFrame:
    names = ["राकेश कुमार यादव", "चन्द्र ज़मीन", "कमल। १२३", "Smt. Sunita Devi", "R.K. Sen s/o Mahesh", "Md. Imran Qureshi", "Vicky Roy", "Phool Wazir", ""]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    key = X.phonetic("name")
    return df.select("name", X.has_devanagari("name").alias("hindi"), X.transliterate("name").alias("latin"), X.display_name("name").alias("display"), key.alias("phonetic"), X.surname(key).alias("surname"), X.surname_weight(X.surname(key)).alias("weight"))


@known("address, places", ("12, Gomti Nagar", "Gomti Nagar"), ("Chowk, near Aminabad", "Aminabad|Chowk"), ("unknown road, Kothi", "unknovn|kothi"), ("", ""))
def known_places(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([(a,) for a in ("12, Gomti Nagar", "Chowk, near Aminabad", "unknown road, Kothi", "")], "address string")
    return df.withColumn("key", X.phonetic("address")).select("address", _text(X.localities(F.col("key"))).alias("places"))


@known(
    "n, phones, imeis, vehicles, accounts, masked, clean",
    (1, "9812345678|9700000002", "", "UP14CQ5566", "123456789012", "98•••••678", "call +91-9812345678 or 9700000002, car up-14 cq 5566, a/c 123456789012"),
    (2, "", "356789012345678", "", "", "•••", "imei 356789012345678"),
    (3, "9812345678", "", "DL1CAB123", "123456789", "UP•••••566", "Ram Shyam 9812345678 DL1CAB123 123456789 5123456"),
    (4, "", "", "", "", "•••", "12-34"),
)
def known_identifiers(spark: SparkSession) -> DataFrame:
    texts = ["call +91-9812345678 or 9700000002, car up-14 cq 5566, a/c 123456789012", "imei 356789012345678", "Ram s/o Shyam 9812345678 DL1CAB123 123456789 5123456", "12-34"]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "n int, t string")
    found = df.select("n", X.identifiers("t").alias("i"), X.mask(F.when(F.col("n") == 1, "9812345678").when(F.col("n") == 3, "UP14CQ5566").otherwise("12345")).alias("masked"), X.strip_noise("t").alias("clean"))
    return found.select("n", *[_text(f"i.{k}").alias(k) for k in ("phones", "imeis", "vehicles", "accounts")], "masked", "clean")


@known(
    "n, persons, orgs, locations, phones, accounts",
    (1, "Bob Lee", "Acme", "Agra", "9812345678", ""), (2, "", "", "", "", "900123456789"),
)
def known_entities(spark: SparkSession) -> DataFrame:
    """All seven lists; what a recogniser says about an identifier is dropped."""

    def recognise(text: str) -> list[tuple[int, int, str]]:
        named = {"Acme": "ORG", "s/o Bob Lee": "PERSON", "Agra": "GPE", "9812345678": "ORG", "noon": "TIME"}
        return [(at, at + len(w), k) for w, k in named.items() if (at := text.find(w)) >= 0]

    df = spark.createDataFrame([(1, "Acme hired s/o Bob Lee of Agra at noon, 9812345678"), (2, "900123456789")], "n int, text string")
    found = N.extract_entities(df, "text", recognise)
    return found.select("n", *[_text(f"entities.{k}").alias(k) for k in ("persons", "orgs", "locations", "phones", "accounts")])


@known(
    "fir_id, lang, start, end, label, text, source",
    ("F1", "en", 0, 7, "PERSON", "Ram Lal", "record"), ("F1", "en", 15, 25, "PHONE", "9812345678", "regex"), ("F1", "en", 31, 41, "VEHICLE", "UP14CQ5566", "regex"),
    ("F1", "en", 47, 59, "ACCOUNT", "900123456789", "regex"), ("F1", "en", 61, 64, "PERSON", "Ram", "record"), ("F2", "hi", 5, 20, "IMEI", "356938035643809", "regex"),
)
def known_spans(spark: SparkSession) -> DataFrame:
    """Identifiers by priority, then known names, the longest first; nothing overlaps."""
    texts = [("F1", "Ram Lal called 9812345678 from UP14CQ5566; a/c 900123456789; Ram"), ("F2", "राम। 356938035643809"), ("F3", None)]
    reports, persons = spark.createDataFrame(texts, "id string, narrative string"), spark.createDataFrame([("F1", "Ram"), ("F1", "Ram Lal")], "fir_id string, name string")
    return N.extract_spans(reports, persons).select("fir_id", "lang", F.explode("spans").alias("s")).select("fir_id", "lang", "s.start", "s.end", "s.label", "s.text", "s.source")


@known(
    "a, b, token_set, partial",
    ("ravi kumar sen", "sen ravi kumar", 100.0, 83.3333), ("ravi sen", "ravi", 100.0, 100.0), ("ab", "cd", 0.0, 0.0), ("abcd", "abxd", 75.0, 75.0),
    ("ram lal", "ram das", 71.4286, 76.9231), ("rakesh kumar yadav", "rocki yadav", 62.5, 77.7778), ("", "x", 0.0, 0.0), ("mr rakesh kumar", "rakesh", 100.0, 100.0),
)
def known_similarity(spark: SparkSession) -> DataFrame:
    pairs = [("ravi kumar sen", "sen ravi kumar"), ("ravi sen", "ravi"), ("ab", "cd"), ("abcd", "abxd"), ("ram lal", "ram das"), ("rakesh kumar yadav", "rocki yadav"), ("", "x"), ("mr rakesh kumar", "rakesh")]
    df = spark.createDataFrame(pairs, "a string, b string")
    return df.select("a", "b", F.round(S.token_set_udf("a", "b"), 4).alias("token_set"), F.round(S.partial_udf("a", "b"), 4).alias("partial"))


# --- resolution ------------------------------------------------------------------------------------

_PERSON = "id string, fir_id string, name string, alias string, father_name string, age string, role string, address string, phone string, vehicle string, account_no string, imei string, notes string"


def _persons(spark: SparkSession) -> DataFrame:
    rows = [
        ("P1", "F1", "Ravi Sen", None, "Mohan Sen", "30", "ACCUSED", "Chowk, Aminabad", "9812345678", "UP14CQ5566"), ("P2", "F2", "Ravee Sen", None, "Mohan Sen", "31", "WITNESS", "Chowk", "9812345678", "UP14CQ5566"),
        ("P3", "F2", "Ravi Sen", None, "Other Das", "55", "ACCUSED", "Aliganj", None, None), ("P4", "F3", "Victim One", None, None, None, "VICTIM", "Chowk", "9812345678", None),
        ("P5", "F3", "Asha Rao", None, None, "x", "ACCUSED", None, "9700000002", None), ("P6", "F1", "Asha Das", "Munni Rao", None, "40", "ACCUSED", None, "9700000002", None),
    ]
    return spark.createDataFrame([(*r, None, None, None) for r in rows], _PERSON)


@known(
    "id_a, id_b, score, decision, kinds, points, blocks",
    ("P1", "P2", 1.0, "accept", "strong|strong|name|weak|weak|weak", 1.175, "name:rav|sen;phone:9812345678;vehicle:UP14CQ5566"), ("P1", "P3", 0.0, "reject", "name|negative|negative", -0.125, "name:rav|sen"),
    ("P2", "P3", 0.0, "reject", "name|negative|negative", -0.125, "name:rav|sen"), ("P5", "P6", 0.6938, "review", "strong|name", 0.6938, "phone:9700000002"),
)
def known_scores(spark: SparkSession) -> DataFrame:
    """Scores with the factors behind them: shared identifiers, name (best of name and alias), father, locality, age."""
    prepared = R.prepare(_persons(spark))
    found = R.score_pairs(R.candidate_pairs(prepared), prepared)
    points = F.round(F.aggregate("factors", F.lit(0.0), lambda s, f: s + f["points"]), 4)
    return found.select("id_a", "id_b", "score", "decision", _text("factors.kind").alias("kinds"), points.alias("points"), _text("blocks", ";").alias("blocks"))


@known("id_a, id_b", ("A", "C"), ("B", "C"))
def known_group(spark: SparkSession) -> DataFrame:
    """A decision holds for all open pairs between two entities."""
    pairs = spark.createDataFrame([("A", "B", 0.9, "accept"), ("A", "C", 0.5, "review"), ("B", "C", 0.7, "review"), ("A", "D", 0.5, "review")], "id_a string, id_b string, score double, decision string")
    members = spark.createDataFrame([("A", "A"), ("B", "A")], "id string, master_id string")
    return R.decide(R.tidy_review(pairs, members), members, "B", "C", "accept", "me", "now").select("id_a", "id_b")


@known("expected, name, ok", ("merged", "one", True), ("merged", "two", False), ("apart", "A/C", True), ("apart", "A/B", False))
def known_truth(spark: SparkSession) -> DataFrame:
    members = spark.createDataFrame([("A", "A"), ("B", "A")], "id string, master_id string")
    return R.check_truth(members, {"one": ["A", "B"], "two": ["A", "C"]}, [("A", "C"), ("A", "B")]).select("expected", "name", "ok")


# --- graph -----------------------------------------------------------------------------------------


def _small(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    edges = [("P1", "PH:1"), ("P1", "LOC:x"), ("P2", "LOC:x"), ("P2", "PH:2"), ("PH:1", "PH:2"), ("P3", "LOC:x"), *(("P1", f"ACCT:{i}") for i in range(6))]
    kinds = {"P": "Person", "PH": "Phone", "ACCT": "Account", "LOC": "Location"}
    ids = sorted({x for e in edges for x in e})
    nodes = spark.createDataFrame([(i, kinds[i.split(":")[0].rstrip("0123456789")], f"<{i}>", [i]) for i in ids], "id string, type string, label string, records array<string>")
    return nodes, spark.createDataFrame([(a, b, "LIVES_IN" if "LOC" in b else "CALLED" if a > "PH" else "OWNS", "FIR") for a, b in edges], "src string, dst string, etype string, source string")


@known("id, type, label, hop, n", ("P1", "Person", "<P1>", 0, None), ("PH:1", "Phone", "<PH:1>", 1, None), ("PH:2", "Phone", "<PH:2>", 2, None), ("LOC:x", "Location", "<LOC:x>", 1, None), ("COLLAPSED:P1:OWNS", "Summary", "+6 more", 1, 6))
def known_collapse(spark: SparkSession) -> DataFrame:
    """A neighbourhood of two hops whose many accounts become one node."""
    kept, _ = G.collapse(*G.ego(*_small(spark), "P1", 2), "P1")
    return kept.select("id", "type", "label", "hop", F.when(F.col("type") == "Summary", F.size("children")).alias("n"))


@known("id, hop, owned_by", ("P1", 0, ""), ("PH:1", 1, "<P1>"), ("PH:2", 2, "<P2>"), ("P2", 3, ""))
def known_path(spark: SparkSession) -> DataFrame:
    """A shortest path past the place that everyone shares, with whose its things are."""
    nodes, edges = _small(spark)
    found, _ = G.path_subgraph(nodes, edges, G.shortest_path(nodes, edges, "P1", "P2"))
    return found.select("id", "hop", F.coalesce(_text("owned_by"), F.lit("")).alias("owned_by"))


def _barbell(spark: SparkSession) -> DataFrame:
    """Two groups of four, all linked within, joined over a bridge of one."""
    pairs = [(f"{g}{i}", f"{g}{j}") for g in "ac" for i in range(4) for j in range(i)] + [("a0", "b"), ("b", "c0")]
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a string, b string, weight double")


_BETWEEN = [*((f"{g}{i}", 0.0) for g in "ac" for i in (1, 2, 3)), ("a0", 0.5357), ("c0", 0.5357), ("b", 0.5714)]


@known("n, betweenness", *_BETWEEN)
def known_betweenness(spark: SparkSession) -> DataFrame:
    """Of 28 pairs of others, 16 pass the bridge, and 15 each of its ends."""
    return G.betweenness(_barbell(spark)).select("n", F.round("betweenness", 4).alias("betweenness"))


@known("n, betweenness", *_BETWEEN)
def known_betweenness_joined(spark: SparkSession) -> DataFrame:
    """The same by joins, as for graphs that no worker can hold."""
    return G.betweenness(_barbell(spark), most_links=0).select("n", F.round("betweenness", 4).alias("betweenness"))


@known("a_side, c_side, apart", (1, 1, True))
def known_communities(spark: SparkSession) -> DataFrame:
    found = G.communities(_barbell(spark))
    of = lambda g: F.collect_set(F.when(F.substring("n", 1, 1) == g, F.col("community")))
    sides = found.agg(of("a").alias("a"), of("c").alias("c"))
    return sides.select(F.size("a").alias("a_side"), F.size("c").alias("c_side"), (F.size(F.array_intersect("a", "c")) == 0).alias("apart"))


@known("rule, title, confidence, reason", ("BROKER", "b bridges separate criminal groups", 0.97, "bridges 2 groups"))
def known_broker(spark: SparkSession) -> DataFrame:
    """The person with the most paths through them, and why."""
    links = _barbell(spark)
    nodes = spark.createDataFrame([(n, n, [n]) for n in ("a0", "a1", "a2", "a3", "b", "c0", "c1", "c2", "c3")], "id string, label string, records array<string>")
    found = rules.broker(rules.Context({}, {}, nodes, None, links), top=1)
    return found.select("rule", "title", "confidence", F.element_at("evidence", -1).alias("reason"))


@known("id, json", ("P1", '{"id":"P1","label":"x","hop":1,"records":["P1"]}'), ("P2", '{"id":"P2","hop":0}'))
def known_json(spark: SparkSession) -> DataFrame:
    """Rows without nulls and empties."""
    df = spark.createDataFrame([("P1", "x", 1, ["P1"]), ("P2", "", 0, [])], "id string, label string, hop int, records array<string>")
    return df.select("id", G.as_json(df).alias("json"))


# --- search ----------------------------------------------------------------------------------------


@known("type, id, relevance, total", ("Person", "P1", 100.0, 3), ("Vehicle", "V1", 100.0, 3), ("Account", "ACCT:500000000001", 100.0, 3))
def known_search(spark: SparkSession) -> DataFrame:
    """One row a thing, the best of its columns; victims' people and accounts are never found."""
    persons = spark.createDataFrame([("P1", "F1", "Zubin Oza", "ACCUSED", None), ("P2", "F1", "Zubin Victim", "VICTIM", "500000000002"), ("P3", "F1", "Mmmm", "ACCUSED", None)], "id string, fir_id string, name string, role string, account_no string")
    persons = persons.withColumns({c: F.lit(None).cast("string") for c in ("alias", "phone", "address")})
    bank = spark.createDataFrame([("500000000001", "Zubin"), ("500000000002", "Zubin Victim"), ("500000000001", "Zubin")], "account_no string, holder_name string")
    cars = spark.createDataFrame([("V1", "UP14AB0001", "Mr Zubin"), ("V2", "DL1C7777", "Kkkk")], "id string, reg_no string, owner_name string")
    top, total = L.search({"person": persons, "bank_txn": bank, "vehicle_reg": cars}, " zubin ")
    return top.select("type", "id", "relevance", F.lit(total).alias("total"))


# --- ledger ----------------------------------------------------------------------------------------


def _ledger(spark: SparkSession) -> K.Ledger:
    """Three blocks of a fresh ledger: genesis, two entries, one entry."""
    book = K.Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}", K.Keys(b"known"), lambda: "2024-01-01T00:00:00")
    book.ensure_genesis(["ann", "system"])
    book.commit([("INGEST_FILE", {"file": "a", "rows": 1}, "ann"), ("INGEST_FILE", {"file": "राम"}, "ann")])
    book.commit([("RUN", {}, "system")])
    return book


_SOUND = [(f"node-{i}", True, None, None, 2, "in_consensus", 3) for i in (1, 2, 3)]


@known("step, node, ok, bad_blocks, first_broken_entry, height, state, votes",
    *[("sound", *r) for r in _SOUND],
    *[("tampered", f"node-{i}", True, None, None, 2, "in_consensus", 2) for i in (1, 2)], ("tampered", "node-3", False, "1", 2, 2, "tampered", 0),
    *[("healed", f"node-{i}", True, None, None, 3, "in_consensus", 3) for i in (1, 2, 3)],
)
def known_ledger(spark: SparkSession) -> DataFrame:
    """Audits of all replicas before and after one is tampered with, and after it is healed."""
    book = _ledger(spark)

    def status(step: str) -> DataFrame:
        found = book.status().select(F.lit(step).alias("step"), "node", "ok", _text(F.transform("bad_blocks", lambda b: b.cast("string"))).alias("bad_blocks"), "first_broken_entry", "height", "state", F.when(F.col("ok"), F.col("votes")).otherwise(0).alias("votes"))
        return spark.createDataFrame(found.collect(), found.schema)

    out = status("sound")
    K.tamper(book, "node-3", 2, {"file": "b"})
    out = out.unionByName(status("tampered"))
    book.heal("node-3")
    return out.unionByName(status("healed"))


@known("kind, node, place, wrong", ("entry", "node-2", 3, "signature"), ("entry", "node-2", 4, "signature"), ("block", "node-2", 1, "entry 3: signature|proposer signature"), ("block", "node-2", 2, "entry 4: signature|proposer signature"), *[("endorsement", "node-2", h, e) for h in (1, 2) for e in K.NODES])
def known_faults(spark: SparkSession) -> DataFrame:
    """An entry forged with every later hash made to fit: signatures tell."""
    book = _ledger(spark)
    K.tamper(book, "node-2", 3, {"file": "b"}, rehash=True)
    entries = book.entry_faults().select(F.lit("entry").alias("kind"), "node", F.col("seq").alias("place"), "wrong")
    blocks = book.block_faults().select(F.lit("block").alias("kind"), "node", F.col("height").alias("place"), _text("errors").alias("wrong"))
    signed = book.endorsement_faults().select(F.lit("endorsement").alias("kind"), "node", F.col("height").alias("place"), F.col("endorser").alias("wrong"))
    return entries.unionByName(blocks).unionByName(signed)


@known("n, leads_to_root, altered_leads, steps", *[(n, True, False, s) for n, s in ((1, 0), (2, 1), (3, 2), (5, 3), (8, 3), (11, 4))])
def known_proofs(spark: SparkSession) -> DataFrame:
    """Every leaf's path leads to the root, and an altered leaf's doesn't."""
    rows = []
    for n in (1, 2, 3, 5, 8, 11):
        leaves = [H._hex(f"{n}/{i}") for i in range(n)]
        for i in range(n):
            rows.append((n, leaves[i], H._hex("x"), [(s["side"], s["hash"]) for s in H.proof_of(leaves, i)], H.root_of(leaves)))
    df = spark.createDataFrame(rows, "n int, leaf string, other string, steps array<struct<side:string,hash:string>>, root string")
    met = df.withColumn("good", H.fold_proof(F.col("leaf"), F.col("steps")) == F.col("root")).withColumn("bad", H.fold_proof(F.col("other"), F.col("steps")) == F.col("root"))
    return met.groupBy("n").agg(F.bool_and("good").alias("leads_to_root"), F.bool_or("bad").alias("altered_leads"), F.max(F.size("steps")).alias("steps"))


@known("what, faults", ("as exported", ""), ("payload", "content hash"), ("unknown actor", "signature"), ("proposer", "header|proposer"), ("endorsements", "endorsements"))
def known_bundles(spark: SparkSession) -> DataFrame:
    """What an offline check finds in an exported proof and in altered ones."""
    book = _ledger(spark)
    proof, registry = book.proof(3), book.registry(["ann", "system"])
    entry, block = proof["entry"], proof["block"]
    cases = {
        "as exported": proof, "payload": proof | {"entry": entry | {"payload": "{}"}}, "unknown actor": proof | {"entry": entry | {"actor": "eve"}},
        "proposer": proof | {"block": block | {"proposer": "node-1"}}, "endorsements": proof | {"endorsements": {}},
    }
    return spark.createDataFrame([(what, "|".join(K.verify_bundle(b, registry))) for what, b in cases.items()], "what string, faults string")


@known("seq, action, actor", (4, "RUN", "system"), (3, "INGEST_FILE", "ann"), (2, "INGEST_FILE", "ann"))
def known_rows(spark: SparkSession) -> DataFrame:
    """The last three entries."""
    return _ledger(spark).rows(3).select("seq", "action", "actor")


@known("height, n_entries, proposer, endorsed_by, actions", (1, 2, "node-2", "node-1|node-2|node-3", "INGEST_FILE"), (0, 1, "node-1", "node-1|node-2|node-3", "GENESIS"))
def known_blocks(spark: SparkSession) -> DataFrame:
    """Blocks below a height, newest first."""
    found = _ledger(spark).block_list(5, before=2)
    return found.select("height", "n_entries", "proposer", _text("endorsed_by").alias("endorsed_by"), _text("actions").alias("actions"))

"""Sources, resolution, graph, rules and lookup over a small made-up case."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import lookup as L
from tessera.operators import resolution as R
from tessera.operators import rules
from tessera.sources import case_files as C

FIRS = """id,station,date,section,narrative
F1,PS North,2024-01-03,318,"Ravi Sen, called
9812345678"
F2,PS South,2024-02-01,316,second
F3,PS North,2024-02-09,316,third
"""
PERSONS = """id,fir_id,name,alias,father_name,age,role,address,phone,vehicle,account_no,imei,notes
P1,F1,Ravi Sen,,Mohan Sen,30,ACCUSED,"Chowk, Aminabad",+91 98123-45678,up 14 cq 5566,,,
P2,F2,Ravee Sen,,Mohan Sen,31,WITNESS,Chowk,9812345678,UP14CQ5566,,,
P3,F2,Ravi Sen,,Other Das,55,ACCUSED,Aliganj,,,,,
P4,F3,Victim One,,,,VICTIM,Chowk,9800000001,,111122223333,,
P5,F3,Asha Rao,,,,ACCUSED,Chowk,9700000002,,,,
"""
CALLS = "id,caller,callee,ts,duration_s,tower_loc\n" + "".join(f"C{i},9812345678,97000000{i % 3:02d},2024-01-05T10:{5 * i:02d}:00,60,T{i % 2}\n" for i in range(8)) + "".join(f"V{i},9800000001,9812345678,2024-01-05T11:{i:02d}:00,,T1\n" for i in range(9))
BANK = """id,account_no,holder_name,linked_phone,txn_type,amount,ts,counterpart
B1,500000000001,Ann,9700000002,TRANSFER,60000,2024-01-01T00:00:00,500000000002
B2,500000000002,Bob,9700000002,TRANSFER,50000.5,2024-01-02T00:00:00,500000000003
B3,500000000003,Cy,9700000002,TRANSFER,40000,2024-01-03T00:00:00,500000000001
B4,500000000003,Cy,9700000002,CREDIT,70000,2024-01-04T00:00:00,SALARY
B5,111122223333,Victim One,,CREDIT,1,2024-01-04T00:00:00,SALARY
B6,500000000009,Zed,,DEBIT,1,2024-01-04T00:00:00,CASH
"""
CARS = "id,reg_no,owner_name,make,model,colour,chassis_no\nV1,UP14CQ5566,Asha Rao,Tata,Nexon,Red,1\nV2,UP99ZZ0001,Nobody,Tata,Nexon,Red,2\n"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("case")
    for name, text in (("fir.csv", FIRS), ("person.csv", PERSONS), ("cdr.csv", CALLS), ("bank_txn.csv", BANK), ("vehicle_reg.csv", CARS)):
        (folder / name).write_text("﻿" + text, encoding="utf-8")
    return folder


@pytest.fixture(scope="module")
def tables(spark, files):
    return C.load(spark, [str(p) for p in files.glob("*.csv")])


@pytest.fixture(scope="module")
def resolved(tables):
    return R.resolve(tables["person"], tables["fir"])


@pytest.fixture(scope="module")
def built(tables, resolved):
    return G.build(tables, resolved)


def test_sources(spark, files, tables, tmp_path):
    assert C.route("x/FIR_persons.csv") == "fir" and C.route("a/notes.txt") is None
    p1 = tables["person"].filter("id = 'P1'").first()
    assert (p1["phone"], p1["vehicle"], p1["alias"]) == ("9812345678", "UP14CQ5566", None)
    assert tables["fir"].filter("id = 'F1'").first()["narrative"].endswith("\n9812345678")
    assert tables["cdr"].filter("id = 'V0'").first()["duration_s"] == 0
    listed = {r["table"]: r for r in C.manifest(spark, [str(p) for p in files.glob("*.csv")]).collect()}
    assert len(listed) == 5 and len(listed["fir"]["sha256"]) == 64
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as archive:
        archive.write(files / "fir.csv", "fir.csv")
        archive.writestr("deep/person.csv", "\ufeff" + PERSONS)
        archive.writestr("readme.txt", "no table")
    assert sorted(r["file"] for r in C.read_zip(spark, str(tmp_path / "x.zip")).collect()) == ["deep/person.csv", "fir.csv"]
    zipped = C.load(spark, [str(tmp_path / "x.zip"), str(files / "bank_txn.csv")])
    assert {t: sorted(map(str, df.collect())) for t, df in zipped.items()} == {t: sorted(map(str, tables[t].collect())) for t in ("fir", "person", "bank_txn")}
    both = C.manifest(spark, [str(tmp_path / "x.zip"), str(files / "bank_txn.csv")]).collect()
    assert {(r["file"], r["table"], r["rows"]) for r in both} == {("fir.csv", "fir", 3), ("person.csv", "person", 5), ("bank_txn.csv", "bank_txn", 6)}
    assert C.store({"fir": tables["fir"]}, str(tmp_path / "out")) == {"fir": 3}
    with pytest.raises(ValueError):
        C.load(spark, ["nothing.txt"])


def test_violations(tables):
    assert C.violations(tables).count() == 0
    broken = dict(tables) | {"person": tables["person"].withColumn("fir_id", F.lit("F9")).withColumn("role", F.lit("X"))}
    assert {r["constraint"]: r["n"] for r in C.violations(broken).collect()} == {"person.role allowed": 5, "person.fir_id known": 5}


def test_resolution(resolved):
    pairs = {(r["id_a"], r["id_b"]): r for r in resolved["pairs"].collect()}
    assert set(pairs) == {("P1", "P2"), ("P1", "P3"), ("P2", "P3")}
    assert pairs["P1", "P2"]["decision"] == "accept" and pairs["P1", "P2"]["score"] == 1.0
    assert pairs["P1", "P2"]["first_block"] == "phone" and pairs["P1", "P3"]["decision"] == "reject"
    assert {f["label"] for f in pairs["P1", "P2"]["factors"]} >= {"Same phone 9812345678", "Same vehicle UP14CQ5566", "Same father/husband name (Mohan Sen)"}
    assert [f["points"] for f in pairs["P1", "P2"]["factors"] if f["kind"] == "strong"] == [0.6, 0.2]
    golden = resolved["masters"].collect()
    assert len(golden) == 1 and golden[0]["members"] == ["P1", "P2"] and golden[0]["role"] == "ACCUSED" and golden[0]["stations"] == ["PS North", "PS South"]
    assert all(r["id"] != "P4" for r in resolved["prepared"].collect())
    stats = R.funnel(resolved).first()
    assert (stats["candidates"], stats["accept"], stats["reject"], stats["entities"]) == (3, 1, 2, 1)


def test_decisions_are_replayed(spark, tables, resolved):
    log = spark.createDataFrame([("P1", "P3", "reject", "1"), ("P1", "P3", "accept", "2")], "id_a string, id_b string, decision string, ts string")
    again = R.resolve(tables["person"], tables["fir"], log)
    assert again["pairs"].filter("id_a = 'P1' AND id_b = 'P3'").first()["decision"] == "human_accept"
    assert again["masters"].first()["members"] == ["P1", "P2", "P3"]


def test_review_is_one_question_an_entity(spark):
    pairs = spark.createDataFrame([("A", "B", 0.9, "accept"), ("A", "C", 0.5, "review"), ("B", "C", 0.7, "review"), ("A", "B2", 0.5, "review")], "id_a string, id_b string, score double, decision string")
    members = spark.createDataFrame([("A", "A"), ("B", "A"), ("B2", "A")], "id string, master_id string")
    got = {(r["id_a"], r["id_b"]): r["decision"] for r in R.tidy_review(pairs, members).collect()}
    assert got == {("A", "B"): "accept", ("A", "C"): "review_grouped", ("B", "C"): "review", ("A", "B2"): "transitive"}
    asked = R.decide(R.tidy_review(pairs, members), members, "B", "C", "accept", "me", "now")
    assert {(r["id_a"], r["id_b"]) for r in asked.collect()} == {("A", "C"), ("B", "C")}
    with pytest.raises(ValueError):
        R.decide(pairs, members, "A", "C", "maybe", "me", "now")


def test_graph_protects_victims(built):
    nodes, edges = built
    every = {r["id"]: r for r in nodes.collect()}
    assert "P4" not in every and "PH:9800000001" not in every and "ACCT:111122223333" not in every
    hidden = [r for r in every.values() if r["protected"]]
    assert {r["label"] for r in hidden} == {"98•••••001", "11•••••••333"} and len(hidden) == 2
    assert every["P1"]["merged"] and every["P1"]["records"] == ["P1", "P2"] and every["P1"]["label"] == "Ravee Sen"
    assert "VEH:UP99ZZ0001" not in every and every["VEH:UP14CQ5566"]["make"] == "Tata"
    kinds = {r["etype"]: r["count"] for r in edges.groupBy("etype").count().collect()}
    assert kinds["TRANSFERRED_TO"] == 3 and kinds["REGISTERED_TO"] == 1 and kinds["NAMED_IN"] == 4 and kinds["CALLED"] == 4
    text = str(nodes.collect()) + str(edges.collect())
    assert "9800000001" not in text and "111122223333" not in text


def test_person_links(built):
    links = {(r["a"], r["b"]): r for r in G.persons_graph(*built).collect()}
    assert links["P1", "P3"]["kinds"] == ["co-accused"] or ("P1", "P3") not in links
    assert links["P1", "P5"]["kinds"] == ["calls", "shared vehicle"] and links["P1", "P5"]["weight"] == 3.5


def test_rules(tables, resolved, built):
    found = {r["rule"]: r for r in rules.run_rules(rules.Context(tables, resolved, *built)).collect()}
    assert found["SERIAL_OFFENDER"]["confidence"] == 0.75 and found["SHARED_DEVICE"]["confidence"] == 0.65
    assert found["CIRCULAR_FLOW"]["confidence"] == 0.85 and len(found["CIRCULAR_FLOW"]["evidence"]) == 3
    burst = found["CALL_BURST"]
    assert burst["entities"] == ["PH:9812345678"] and burst["confidence"] == 0.58 and burst["evidence"] == ["05 Jan 10:00-10:35: 8 calls"]
    assert len(burst["source_ids"]) == 8 and len(burst["alert_id"]) == 16


def test_lookup(spark, tables, resolved, built):
    found = L.lookup(tables, resolved, "P2")
    assert found["records"].count() == 2 and found["golden"].count() == 1
    kinds = [r["kind"] for r in found["timeline"].collect()]
    assert kinds == ["FIR", "CDR", "FIR"]
    assert L.lookup(tables, resolved, "PH:V-abc") == {"protected": True}
    assert L.lookup(tables, resolved, "P4")["records"].count() == 0
    phone = L.lookup(tables, resolved, "PH:9812345678")
    assert phone["calls"].first()["n"] == 8 and phone["towers"].first()["tower_loc"] == "T0" and phone["owners"].count() == 2
    account = L.lookup(tables, resolved, "ACCT:500000000003")
    assert account["incoming"].first()["n"] == 1 and account["holder"].first()["holder_name"] == "Cy"
    assert L.lookup(tables, resolved, "VEH:UP14CQ5566")["seen_with"].count() == 2
    assert L.lookup(tables, resolved, "FIR:F3")["victims_protected"].first()["n"] == 1


def test_search(tables):
    top, total = L.search(tables, "ravi")
    rows = top.collect()
    assert rows[0]["type"] == "Person" and rows[0]["relevance"] == 100 and total >= 2
    assert all("Victim" not in r["label"] and r["id"] != "ACCT:111122223333" for r in L.search(tables, "victim")[0].collect())
    assert {r["id"] for r in L.search(tables, "98123")[0].collect()} >= {"PH:9812345678", "P1", "P2"}


def test_feedback_and_export(spark, tables, resolved, built):
    alerts = rules.run_rules(rules.Context(tables, resolved, *built), ["SHARED_DEVICE", "CIRCULAR_FLOW"]).cache()
    first = alerts.first()
    log = L.feedback_row(alerts, first["alert_id"], "fp", "ann", "1").unionByName(L.feedback_row(alerts, first["alert_id"], "tp", "ann", "2"))
    assert L.with_verdicts(alerts, log).filter("verdict IS NOT NULL").first()["verdict"] == "tp"
    assert L.feedback_stats(log).first()["precision"] == 0.5
    with pytest.raises(ValueError):
        L.feedback_row(alerts, first["alert_id"], "maybe", "ann", "1")
    with pytest.raises(KeyError):
        L.feedback_row(alerts, "nothing", "tp", "ann", "1")
    rows = L.alert_sources(alerts, tables).collect()
    assert {r["table"] for r in rows} == {"bank_txn"} and all('"id"' in r["record"] for r in rows)
    counts = {r["what"]: r["n"] for r in L.case_stats({k: v for k, v in tables.items() if k != "cdr"}).collect()}
    assert counts["cdr"] == 0 and counts["person"] == 5


def test_overview(built):
    nodes, links = G.overview(*built)
    assert {"community", "betweenness", "centrality", "degree"} <= set(nodes.columns) and links.count() >= 1
    assert G.overview(*built, level="entities")[0].count() > 0


def test_whole_case(spark, files, tmp_path):
    from tessera.operators import ledger
    from tessera.plans import case

    book = ledger.Ledger(spark, str(tmp_path / "ledger"), ledger.Keys(b"k"), lambda: "2024-01-01T00:00:00")
    tables = case.ingest(spark, [str(p) for p in files.glob("*.csv")], book)
    done = case.process(tables, book)
    actions = {r["action"]: r["count"] for r in book.entries().filter("node = 'node-1'").groupBy("action").count().collect()}
    assert actions["INGEST_FILE"] == 5 and actions["GOLDEN_RECORD"] == 1 and actions["ALERT_RAISED"] == done.alerts.count()
    flagged = {r["id"] for r in G.flag_alerted(done.nodes, done.alerts).filter("alerted").collect()}
    assert {"P1", "PH:9812345678", "PH:9700000002"} <= flagged and "P3" not in flagged
    alert = done.alerts.filter("rule = 'SHARED_DEVICE'").first()["alert_id"]
    bundle, registry = case.export(done, alert, book), book.registry(case.ACTORS)
    assert bundle["sources"] and ledger.verify_bundle(bundle["proof"], registry) == []
    stored = [r.asDict() for r in book.blocks().collect()]
    assert ledger.verify_export(bundle, registry, stored) == []
    assert ledger.verify_export(bundle | {"sources": []}, registry) == ["bundle hash", "recorded hash"]
    assert ledger.verify_export(bundle, registry, stored[:1]) == ["replicas"]
    verdicts = case.feedback(done, alert, "tp", "analyst", str(tmp_path / "out"), book)
    assert [r["verdict"] for r in verdicts.collect()] == ["tp"] and book.rows(1).first()["action"] == "ALERT_FEEDBACK"
    assert [r["verdict"] for r in case.feedback(done, alert, "fp", "analyst", str(tmp_path / "out"), book).orderBy("ts").collect()] == ["tp", "fp"]
    with pytest.raises(KeyError):
        case.export(done, "none", book)
    case.write(done, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/masters")).count() == 1
    assert book.verify()
    case.wipe(spark, str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("*"))


def test_listings(resolved):
    listed = R.golden_list(resolved).collect()
    assert [(r["place"], r["n_records"], r["human_confirmed"], [x["id"] for x in r["records"]]) for r in listed] == [(1, 2, False, ["P1", "P2"])]
    pairs = {(r["id_a"], r["id_b"]): r for r in R.pair_list(resolved).collect()}
    assert pairs["P1", "P3"]["master_a"] == "P1" and pairs["P1", "P3"]["records_a"] == 2 and pairs["P1", "P3"]["records_b"] == 1 and pairs["P1", "P3"]["name_b"] == "Ravi Sen"
    assert R.review_list(resolved).count() == 0


def test_synthetic_case(spark):
    from tessera.plans import case
    from tessera.sources import synthetic

    tables, truth = synthetic.case(spark, 3, 40)
    assert C.violations(tables).count() == 0
    again, _ = synthetic.case(spark, 3, 40)
    assert sorted(map(str, again["person"].collect())) == sorted(map(str, tables["person"].collect()))
    done = case.process(tables)
    checked = R.check_truth(done.resolved["members"], truth["together"], truth["apart"]).collect()
    assert len(checked) == 2 * synthetic.TWICE - 1 and all(r["ok"] for r in checked)
    alerts = {}
    for r in done.alerts.collect():
        alerts.setdefault(r["rule"], []).append(r["entities"])
    assert any(f"PH:{truth['device']}" in e for e in alerts["SHARED_DEVICE"]) and [f"PH:{truth['caller']}"] in alerts["CALL_BURST"]
    assert any(e == [f"ACCT:{a}" for a in truth["loop"]] for e in alerts["CIRCULAR_FLOW"]) and len(alerts["SERIAL_OFFENDER"]) >= synthetic.TWICE


def test_alert_sources_of_few_and_many_ids(spark, monkeypatch):
    """Rows are chosen once for each source id, in tasks that follow the number of ids; few ids or many give the same."""
    calls = [(f"C{i}", i % 3) for i in range(20)]
    bank = [(f"T{i:03d}", None if i % 7 == 0 else f"A{i % 4}") for i in range(60)] + [("T001", "A1")] * 2
    named = {"x": ["A1", "C3", "A1", None], "y": ["A1", "A2", "T005"], "z": ["nothing"], "w": []}
    tables = {"cdr": spark.createDataFrame(calls, "id string, n int"), "bank_txn": spark.createDataFrame(bank, "id string, account_no string")}
    alerts = spark.createDataFrame(list(named.items()), "alert_id string, source_ids array<string>")
    want = []
    for alert, ids in named.items():
        for s in set(ids) - {None}:
            want += [(alert, s, "cdr", i) for i, _ in calls if i == s] + [(alert, s, "bank_txn", i) for i, _ in bank if i == s][:5]
            want += [(alert, s, "bank_txn", i) for i in sorted(i for i, a in bank if a == s)[:5]]
    for few in (100, 0):
        monkeypatch.setattr(L, "FEW", few, raising=False)
        monkeypatch.setattr(L, "NAMED", 1, raising=False)
        found = L.alert_sources(alerts, tables)
        rows = found.collect()
        assert sorted((r["alert_id"], r["source_id"], r["table"], r["row_id"]) for r in rows) == sorted(want)
        assert all(f'"id":"{r["row_id"]}"' in r["record"] for r in rows)
        plan = found._jdf.queryExecution().toString()
        assert "windowspecdefinition(source_id" in plan and "windowspecdefinition(alert_id" not in plan
        assert few or ", 5), REPARTITION_BY_NUM" in plan

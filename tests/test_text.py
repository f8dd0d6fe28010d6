import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.spans import extract_spans, spans_of


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").coalesce(1)
    return [r["o"] for r in df.select("i", make(F.col("s")).alias("o")).orderBy("i").collect()]


def test_display_and_phonetic(spark):
    names = ["Smt. Sunita Devi", "राकेश कुमार यादव", "Rakesh s/o Mahesh Yadav", "R.K. Yadav", "Md. Imran Qureshi", None, "", "A-B  c/o X"]
    assert column(spark, names, X.display_name) == ["Sunita Devi", "Raakesh Kumaar Yaadav", "Rakesh Mahesh Yadav", "R K Yadav", "Imran Qureshi", "", "", "A B X"]
    assert column(spark, ["Raakesh Kumaar Yaadav", "Imran Qureshi", "Vicky Roy", "  "], X.phonetic) == ["rakesh kumar yadav", "imran kureshi", "vicki roi", ""]


def test_transliteration(spark):
    given = ["चन्द्र", "चंद", "राकेश", "ज़मीन", "१२३", "abc", "कमल।", None]
    assert column(spark, given, X.transliterate) == ["chandra", "chand", "raakesh", "zameen", "123", "abc", "kamala.", None]


def test_surname_weight(spark):
    keys = ["rakesh yadav", "imran kureshi", ""]
    assert column(spark, keys, X.surname) == ["yadav", "kureshi", ""]
    assert column(spark, ["yadav", "kureshi"], lambda c: X.surname_weight(c)) == [0.55, 1.0]
    assert column(spark, ["kureshi"], lambda c: X.surname_weight(c, F.lit(0.2))) == [0.5]
    corpus = X.surname_corpus(spark.createDataFrame([("A Roy",), ("B Roy",), ("C Sen",), (" ",), (None,)], "name string"))
    assert {r["surname"]: (r["n"], round(r["share"], 3)) for r in corpus.collect()} == {"roi": (2, 0.667), "sen": (1, 0.333)}


def test_localities(spark):
    keys = column(spark, ["12, gomti nagar", "unknown road", "Chowk, Aminabad"], X.phonetic)
    assert column(spark, keys, X.localities) == [["Gomti Nagar"], ["unknovn"], ["Aminabad", "Chowk"]]


def test_identifiers_and_masks(spark):
    text = "call +91-9812345678 or 09876543210, IMEI 356938035643809, car UP 14 CQ 5566, a/c 900123456789"
    found = column(spark, [text, None], X.identifiers)
    assert found[0]["phones"] == ["9812345678", "9876543210"] and found[0]["imeis"] == ["356938035643809"]
    assert found[0]["vehicles"] == ["UP14CQ5566"] and found[0]["accounts"][-1] == "900123456789"
    assert found[1]["phones"] == []
    assert column(spark, ["9812345678", "12345", None], X.mask) == ["98•••••678", "•••", "•••"]
    assert column(spark, ["x"], X.opaque) == ["V-2d711642b7"]
    assert column(spark, ["+91 98123 45678", "12-34"], X.phone_digits) == ["9812345678", "1234"]
    assert column(spark, ["up 14-cq 5566"], X.plate) == ["UP14CQ5566"]
    assert column(spark, [" Ram s/o Shyam, "], X.strip_noise) == ["Ram Shyam"]


def test_spans():
    text = "Ram Lal called 9812345678 from UP14CQ5566; BNS 318 applies; a/c 900123456789; Ram"
    found = spans_of(text, ["Ram", "Ram Lal"])
    assert [(s["label"], s["text"]) for s in found] == [("PERSON", "Ram Lal"), ("PHONE", "9812345678"), ("VEHICLE", "UP14CQ5566"), ("ACCOUNT", "900123456789"), ("PERSON", "Ram")]
    assert all(text[s["start"] : s["end"]] == s["text"] for s in found)
    named = spans_of("Acme hired Bob", [], lambda t: [(0, 4, "ORG")])
    assert named[0]["source"] == "ner"


def test_extract_spans(spark):
    reports = spark.createDataFrame([("F1", "Bob has 9812345678"), ("F2", "राकेश"), ("F3", None)], "id string, narrative string")
    persons = spark.createDataFrame([("F1", "Bob"), ("F1", None)], "fir_id string, name string")
    rows = {r["fir_id"]: r for r in extract_spans(reports, persons).collect()}
    assert [s["label"] for s in rows["F1"]["spans"]] == ["PERSON", "PHONE"] and rows["F1"]["lang"] == "en"
    assert rows["F2"]["lang"] == "hi" and rows["F2"]["transliteration"] == "raakesh" and rows["F3"]["spans"] == []


@pytest.mark.parametrize("value", ["", None])
def test_blank_names_are_blank(spark, value):
    assert column(spark, [value], X.phonetic) == [""]


def test_several_ids_in_a_text_as_in_sql(spark):
    """Long random strings hold digits that look like phones: some texts of a large corpus have two of them."""
    import duckdb

    from tessera.plans.catalog import ORACLE_SQL, extract_ids

    texts = ["a7966384 b6000000001c9000000002d", "x123456789012345y923456789012345z 123456789012345", "08123456789, 8123456789 and 7123456789", "none 812345678", "", None]
    rows = list(enumerate(texts))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = extract_ids(lambda name: spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r[0]: (r[1] or "", r[2] or "") for r in found} == {r[0]: (r[1] or "", r[2] or "") for r in con.execute(ORACLE_SQL["extract_ids"]).fetchall()}
    assert next(r["phones"] for r in found if r["doc_id"] == 0) == "9000000002,6000000001"

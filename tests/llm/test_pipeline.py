import random

import corpus_pipeline
import duckdb
import pandas as pd
import pytest

from tessera.llm import blocks, queries


def test_stages_keep_columns_and_clean_rows(spark, tmp_path):
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("bcdfghlmnprstv") + rnd.choice("aeiou") for _ in range(3)) for _ in range(300)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    clean = [(i, text(60)) for i in range(80)]
    toxic = [(100 + i, f"{text(20)} idiot {text(20)} moron {text(5)}") for i in range(40)]
    base = text(80)
    copies = [(200 + i, base if i < 3 else base.replace(base.split()[5], "other")) for i in range(6)]
    item, passage = text(20), text(70)  # the item is shorter than what the stage before cuts
    leaks = [(300 + i, f"{text(20)} {item} {text(20)}") for i in range(3)]
    repeated = [(400 + i, f"{text(40)} {passage} {text(40)}") for i in range(3)]
    odd = [(500, None), (501, ""), (None, text(10)), (502, "word")]
    rows = clean + toxic + copies + leaks + repeated + odd
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 200)) for i, _ in clean[:60] + toxic[:30]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now, left = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = blocks.cut(stage(spark, now, folder))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == now.columns and out.schema == now.schema
        left[name] = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "repeats":
            cut = {r["doc_id"]: r for r in out.collect()}
            assert all(passage[:200] not in cut[400 + i]["text"] and cut[400 + i]["n_chars"] == len(cut[400 + i]["text"]) for i in range(3))
            assert all(cut[i]["text"] == t for i, t in clean)
        now = out
    stays = {i for i, _ in clean} | {500, 501, 502, None, 400, 401, 402}
    assert left["toxicity"] == stays | {i for i, _ in copies + leaks}
    assert left["near_duplicates"] == stays | {200} | {i for i, _ in leaks}
    assert left["decontamination"] == stays | {200} == left["bpe"]


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_registered_queries_run(spark, data, name):
    found = queries.QUERIES[name](spark, data).toPandas()
    assert len(found)
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for table in ("documents", "embeddings"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{data}/{table}.parquet')")
        want = con.execute(queries.ORACLE_SQL[name]).df()
        rows = lambda frame: sorted(tuple(x if isinstance(x, str) else -1 if pd.isna(x) else int(x) for x in r) for r in frame[list(found.columns)].itertuples(index=False))
        assert sorted(found.columns) == sorted(want.columns) and rows(found) == rows(want)

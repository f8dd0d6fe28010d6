import math
import random
import zlib

import pytest
from helpers import documents
from pyspark.sql import functions as F

from tessera.llm import blocks, cover_tree, sharding


def slow_top(rows, k, every):
    good = {}
    for i, v in sorted(((i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0], [math.floor(256 * x) for x in r[1]])):
        good.setdefault((i, len(v)), [math.floor(256 * x) for x in v])
    out = []
    for (i, n), v in good.items():
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for (j, m), w in good.items() if m == n and j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def ask(spark, rows, every=5, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("payload", F.lit(1)).withColumn("salt", F.lit(2)).withColumn("dim", F.lit("x")).repartition(3)
    got = cover_tree.top_k(df, F.col("vec_id") % every == 0, k=k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


def test_search_matches_brute_force(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1) + (i % 4) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, rows[10][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2005, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2010, [float("nan")] * 6), (2015, [float("inf")] * 6), (None, [1.0] * 6), (2020, [1.0, 2.0]), (2025, [2.0, 1.0]), (2030, []), (20, rows[20][1])]
    rows += [(-5, [0.1] * 6), (2035, [0.0] * 6)]
    assert ask(spark, rows) == slow_top(rows, 5, 5)


def test_few_candidates_and_none(spark):
    assert ask(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]
    assert ask(spark, [(0, [1.0])]) == []
    assert ask(spark, []) == []


def test_large_components_stay_exact(spark):
    rows = [(i, [1e6 + i, -1e6 + 3 * i, 1e5 + 0.3]) for i in range(12)]
    assert ask(spark, rows, every=3) == slow_top(rows, 5, 3)
    beyond = ask(spark, [(0, [1e12]), (1, [1e12]), (2, [-1e12])])
    assert beyond == [(0, 1, 1, 2**63 - 1), (0, 2, 2, 1 - 2**63)]


def test_repeated_ids_do_not_depend_on_partitions(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (1, [3.0, 3.0]), (2, [3.0, 0.5]), (1, [2.0, 1.0]), (5, [0.5, 0.5]), (5, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [sorted(map(tuple, cover_tree.top_k(df.repartition(n), F.col("vec_id") % 5 == 0, k=3).collect())) for n in (1, 8)]
    assert found[0] == found[1] == slow_top(rows, 3, 5)


def test_blocks_are_pruned(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    centers = rng.normal(0, 8, (16, 6))
    rows = [(i, (centers[i % 16] + rng.normal(0, 0.1, 6)).tolist()) for i in range(1600)]
    monkeypatch.setattr(cover_tree, "ROWS_A_BLOCK", 100)
    monkeypatch.setattr(cover_tree, "QUERIES_A_BLOCK", 10)
    asked = {}
    pairs = cover_tree.block_pairs

    def spy(queries, points, k, lots):
        asked["all"] = queries.crossJoin(points.select(F.col("n").alias("m"))).agg(F.sum(F.col("n") * F.col("m"))).first()[0]
        seeds, rest = pairs(queries, points, k, lots)
        both = seeds.select("q", "x").unionByName(rest.select("q", "x"))
        of = lambda df, c, n: df.select(F.col("block").alias(c), F.col("n").alias(n))
        asked["met"] = both.join(of(queries, "q", "a"), "q").join(of(points, "x", "b"), "x").agg(F.sum(F.col("a") * F.col("b"))).first()[0]
        return seeds, rest

    monkeypatch.setattr(cover_tree, "block_pairs", spy)
    assert ask(spark, rows, every=10) == slow_top(rows, 5, 10)
    assert asked["met"] < asked["all"] / 4


def test_a_tree_survives_its_payload():
    import numpy as np

    points = np.floor(np.random.default_rng(5).normal(0, 100, (500, 4)))
    tree = cover_tree.cover_tree(points)
    order, size, radius, fan = cover_tree.flatten(tree)
    again = cover_tree._restore(points[order], cover_tree._centers_of(tree, points, order), size, radius, fan)

    def same(a, b):
        assert (a.center == b.center).all() and a.radius == b.radius and sorted(a.rows) == sorted(order[b.rows])
        assert np.sqrt(((points[a.rows] - a.center) ** 2).sum(1)).max() <= a.radius
        assert len(a.children) == len(b.children)
        for x, y in zip(a.children, b.children):
            same(x, y)

    same(tree, again)


def test_trees_prune(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    centers = rng.normal(0, 400, (12, 5))
    points = np.floor(np.vstack([c + rng.normal(0, 4, (150, 5)) for c in centers]))
    ids = np.arange(len(points))
    seen = []
    add = cover_tree.Best.add
    monkeypatch.setattr(cover_tree.Best, "add", lambda self, rows, scores, i: (seen.append(scores.size), add(self, rows, scores, i)))
    best = cover_tree.dual_search(points[::10], ids[::10], points, ids, 3)
    exact = points[::10] @ points.T
    exact[np.arange(len(exact)), ids[::10]] = -np.inf
    assert (best.score == -np.sort(-exact, axis=1)[:, :3]).all() and sum(seen) < exact.size / 2


def check(rows, shards):
    """Slots without gaps, groups whole, and sizes apart by a group at most."""
    by, groups = {}, {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
        groups.setdefault((r["size"], r["text_crc32"]), []).append(r)
    assert all(0 <= s < shards for s in by) and all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    assert all(len({r["shard"] for r in v}) == 1 for v in groups.values())
    share, largest = sum(r["size"] for r in rows) / shards, max(sum(r["size"] for r in v) for v in groups.values())
    assert max(abs(sum(r["size"] for r in by.get(s, [])) - share) for s in range(shards)) <= largest + 0.002 * share + 1


def test_shards(spark):
    df = documents(spark, n=400, extra=True)
    rows = sharding.shard(df, 8).collect()
    given = sorted(((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in df.collect()), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=str) == given
    check(rows, 8)
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    again = sharding.shard(df.repartition(7), 8, rows_a_task=5).collect()  # many lots a shard
    check(again, 8)
    assert sorted((str(r["doc_id"]), r["shard"]) for r in again) == sorted((str(r["doc_id"]), r["shard"]) for r in rows)


def test_a_group_of_equal_texts_is_never_cut(spark):
    rnd = random.Random(4)
    rows = [(i, "the same text") for i in range(2000)] + [(5000 + i, "x" * rnd.randrange(60)) for i in range(1500)] + [(9000 + i, None) for i in range(40)]
    rows += [(9100 + i, f"{i} " * 9000) for i in (1, 1, 2, 3, 3)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 20).collect()
    check(got, 20)
    assert len({r["shard"] for r in got if r["size"] == 16}) == 1  # null and empty go together


def test_small_and_empty(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert sharding.shard(df.limit(0), 4).count() == 0
    assert sharding.shard(df, 4).count() == 1 and sharding.shard(df, 1).first()["shard"] == 0
    same = spark.createDataFrame([(1, "a")] * 9, "doc_id long, text string")
    assert sharding.shard(same, 3).count() == 9
    with pytest.raises(ValueError):
        sharding.shard(df, 0)


def test_payloads_round_trip():
    import numpy as np

    arrays = [np.array([1, 5, 9], np.uint64), np.zeros(0, np.int64), np.array([True, False]), b"raw", np.array([-1.5])]
    out = blocks.unpack(blocks.pack(*arrays))
    assert all((a == b) if isinstance(a, bytes) else (a.tolist() == b.tolist() and a.dtype == b.dtype) for a, b in zip(arrays, out))
    assert blocks.undeltas(blocks.deltas(arrays[0])).tolist() == [1, 5, 9]

"""Near duplicates and repeated strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, documents, words

from tessera.llm import near_dup, repeats


def slow_components(rows, k, percent):
    def shingles(text):
        w = words(text)
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = [(i, shingles(t)) for i, t in rows]
    live = sorted({(s, min(i for i, x in sets if x == s and i is not None)) for i, s in sets if s and i is not None}, key=lambda p: p[1])
    parent = {s: s for s, _ in live}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    least = dict(live)
    for a in range(len(live)):
        for b in range(a):
            x, y = live[a][0], live[b][0]
            if 100 * len(x & y) >= percent * len(x | y):
                parent[root(x)] = root(y)
    comp = {}
    for s, i in live:
        comp[root(s)] = min(comp.get(root(s), i), i)
    out = []
    for i, s in sets:
        c = None if i is None else comp[root(s)] if s else i
        out.append((i, len(s), c, i is not None and i == c))
    assert least
    return sorted(out, key=str)


def families(seed, n, copies, edits):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(5, 60))]
        for _ in range(copies):
            text = base[:]
            for _ in range(rnd.randint(0, edits)):
                text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
            out.append(" ".join(text))
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize(("k", "rows"), [(2, families(1, 40, 5, 4)), (5, families(2, 30, 4, 2)), (2, families(3, 2, 220, 3))])
def test_components_match_brute_force(spark, k, rows):
    # the last case has groups larger than a chunk, with members that only chains connect
    df = spark.createDataFrame([(10 + i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in near_dup.near_duplicates(df, k, 80).collect()), key=str)
    assert got == slow_components([(10 + i, t) for i, t in enumerate(rows)], k, 80)


def test_unpleasant_rows(spark):
    df = documents(spark, extra=True)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = near_dup.near_duplicates(df, 2, 80)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow_components(rows, 2, 80)
    assert near_dup.near_duplicates(df.limit(0), 2, 80).count() == 0


def test_one_id_with_two_texts(spark):
    rows = [(5, "aa bb cc dd"), (5, "ee ff gg hh"), (1, "ee ff gg hh"), (9, "aa bb cc dd"), (9, "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_dup.near_duplicates(df, 2, 80).collect()) == sorted(slow_components(rows, 2, 80))


def test_sketches_leave_room():
    assert near_dup.least_agreement(0.8) <= 0.62 * near_dup.TOKENS


def slow_removals(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if gone.any() else 0
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def stitched(seed, n, alphabet, length):
    rnd = random.Random(seed)
    parts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(length // 2, 3 * length))) for _ in range(12)]
    out = []
    for _ in range(n):
        t = "".join(rnd.choice(parts) if rnd.random() < 0.3 else "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 2 * length))) for _ in range(rnd.randint(0, 5)))
        out.append(t)
    return out


@pytest.mark.parametrize(
    ("texts", "length", "gram", "hot"),
    [
        (stitched(1, 150, "ab", 20) + ["", None, "a" * 300, "a" * 19, "a" * 20], 20, 6, 10**6),
        (stitched(2, 150, "abcdefé", 40), 40, 10, 10**6),
        (stitched(2, 150, "abcdefé", 40), 40, 10, 2),  # every repeated gram is hot
        (stitched(3, 80, "abcdefghijkl ", 200) + ["x" * 1000, "\0" * 500, "ab\0" * 100, "ab" * 101], 200, 50, 10**6),
        (stitched(3, 80, "abcdefghijkl ", 200) + ["x" * 1000, "ab" * 101], 200, 50, 5),
    ],
)
def test_removals_match_brute_force(spark, texts, length, gram, hot):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.removals(df, length, gram, hot).collect()}
    assert [got[i] for i in range(len(texts))] == slow_removals(texts, length)


def test_removals_of_unpleasant_rows(spark):
    df = documents(spark, extra=True)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = repeats.removals(df, 30, 8)
    want = sorted(((i, *x) for (i, _), x in zip(rows, slow_removals([t for _, t in rows], 30))), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert repeats.removals(df.limit(0)).count() == 0


def test_cut_keeps_rows_columns_and_characters(spark):
    df = documents(spark, extra=True)
    out = repeats.cut_repeats(df, 30, 8)
    assert out.schema == df.schema and out.count() == df.count()
    shared = "é" * 250
    some = spark.createDataFrame([(1, shared + "a", "x", "y", 1), (2, "b" + shared, None, None, None), (3, None, None, None, None)], SCHEMA)
    assert {r["doc_id"]: r["text"] for r in repeats.cut_repeats(some).collect()} == {1: "a", 2: "b", 3: ""}
    assert repeats.cut_repeats(df.limit(0)).count() == 0


def test_loser_tree_never_loses_order():
    rnd = random.Random(1)
    runs = []
    for _ in range(7):
        strings = sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 9))) for _ in range(rnd.randint(0, 30)))
        shared = [0] + [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(strings, strings[1:])]
        runs.append((strings, shared[: len(strings)]))
    out = list(repeats.LoserTree(runs).merge())
    assert [s for s, *_ in out] == sorted(s for r, _ in runs for s in r)
    for (a, *_), (b, known, *_) in zip(out, out[1:]):
        assert a[:known] == b[:known] and (known == min(len(a), len(b)) or a[known] != b[known])


def test_threshold_pairs_in_large_nodes_are_proposed(spark):
    # every node that a pair shares also holds a crowd of more than a chunk, whose sketches are far from the pair's
    rnd = np.random.default_rng(1)
    pairs, crowd, agree, rows = 100, near_dup.SMALL + 6, 48, []
    for i in range(pairs):
        tokens = rnd.integers(0, 1 << 32, (crowd + 2, near_dup.TOKENS), dtype=np.uint32)
        alike = rnd.permutation(near_dup.TOKENS)[:agree]
        tokens[:, alike] = tokens[0, alike]
        sketch = rnd.integers(0, 256, (crowd + 2, near_dup.TOKENS), dtype=np.uint8)
        sketch[1, alike] = sketch[0, alike]
        rows += [(1000 * i + j, bytearray(t.tobytes()), bytearray(s.tobytes())) for j, (t, s) in enumerate(zip(tokens, sketch))]
    vertices = spark.createDataFrame(rows, "vertex long, tokens binary, sketch binary").repartition(4)
    found = {tuple(sorted((r["u"], r["v"]))) for r in near_dup._proposed(vertices, near_dup.least_agreement(0.8)).collect()}
    assert found == {(1000 * i, 1000 * i + 1) for i in range(pairs)}

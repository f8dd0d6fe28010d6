"""Language-model scores, token counts and BPE."""

import base64
import hashlib
import math
import random
from array import array
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, documents, fold, words
from pyspark.sql import functions as F

from tessera.llm import bpe, lm, token_counts

P = pytest.importorskip("public_tokenizers")
END = object()


def slow_scores(rows, order, k):
    train = [words(t) + [END] for i, t in rows if fold(i, 7) != 2]
    counts = Counter()
    starts = len(train)
    for tokens in train:
        history = [END, *tokens]
        for i in range(1, len(history)):
            for n in range(1, order + 1):
                if i - n + 1 >= 0:
                    counts[tuple(history[i - n + 1 : i + 1])] += 1
    total = sum(c for g, c in counts.items() if len(g) == 1)
    types = sum(len(g) == 1 for g in counts)

    def p(history, w):
        base = (counts[w,] + 1) / (total + types + 1)
        for n in range(1, len(history) + 1):
            h = tuple(history[-n:])
            state = starts if h == (END,) else counts[h]
            base = (counts[*h, w] + k[n - 1] * base) / (state + k[n - 1])
        return base

    out = []
    for i, t in rows:
        history, score, own = [END], 0.0, words(t) + [END]
        for w in own:
            score += math.log10(p(history[-(order - 1) :] if order > 1 else [], w))
            history.append(w)
        out.append((i, fold(i, 7) == 2, len(own), sum(counts[w,] > 0 for w in own), total, sum(math.log10((counts[w,] + 1) / (total + types + 1)) for w in own), score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_matches_plain_counting(spark, order):
    df = documents(spark, extra=order == 2)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = sorted((tuple(r) for r in lm.lm_scores(df, order=order, concentration=(30.0, 7.0, 2.0)).collect()), key=str)
    want = sorted(slow_scores(rows, order, (30.0, 7.0, 2.0)), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5:] for g in got] == [pytest.approx(w[5:], rel=1e-9) for w in want]


def test_lm_without_rows_or_training(spark):
    df = documents(spark)
    assert lm.lm_scores(df.limit(0)).count() == 0
    none = lm.score(df, F.lit(None).cast("boolean")).collect()
    assert all(r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == 0 for r in none)
    with pytest.raises(ValueError):
        lm.score(df, F.lit(True), order=0)


def test_distributions_sum_to_one(spark):
    rows = [(i, t, None, None, 0) for i, t in enumerate(["a b", "a c", "b a"])]
    probes = [(100 + i, t, None, None, 0) for i, t in enumerate(["a", "b", "c", "never", ""])]
    df = spark.createDataFrame(rows + probes, SCHEMA)
    got = {r["doc_id"]: r for r in lm.score(df, F.col("doc_id") < 100, concentration=(2.0,)).collect()}
    # one-word texts "w": p(w | start) p(end | w); the empty text: p(end | start)
    assert got[103]["n_known"] == 1 and got[104]["n_tokens"] == 1 and all(r["score"] < 0 for r in got.values())


def test_token_counts_match_the_library(spark):
    from tokenizers import Tokenizer

    path = token_counts.vocabulary_path("byte_bpe_50k.json")
    library, rnd = Tokenizer.from_file(path), random.Random(2)
    odd = ["a<|endoftext|>b <|endoftext|>", " x  y\n\nz \t'll", "\n", "  ", " a", "b\n", "b\nc d", "don't I'LL we've", "１２３ ٣", "\x85\x1c x"]
    odd += ["".join(rnd.choice("abst ,.'\n\té漢🙂1\x1c　") for _ in range(30)) for _ in range(80)]
    df = documents(spark, extra=True).select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    want = sorted(((i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in rows), key=str)
    got = sorted((tuple(r) for r in token_counts.token_counts(df, path).collect()), key=str)
    assert got == want
    assert token_counts.token_counts(df.limit(0), path).count() == 0


@pytest.fixture(scope="module")
def library():
    import tiktoken

    path = token_counts.vocabulary_path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_queue_matches_the_library(library):
    path, encoding = library
    own, rnd = bpe.encoder(path, P.PATTERN), random.Random(3)
    for _ in range(1500):
        text = "".join(rnd.choice("abcdeEstthing ..,,'sntll  \n\n\té 　\x1c\x85é漢字🙂0123456789٣﷽") for _ in range(rnd.randint(0, 60)))
        assert list(array("I", own.encode_packed(text))) == encoding.encode_ordinary(text)
    long = "abcde" * 5000 + "".join(rnd.choice("abct") for _ in range(40_000))  # one match
    assert own.encode(long) == encoding.encode_ordinary(long)
    assert not any(own.queue.words) and not any(own.queue.buckets)


def test_bpe_memory_forgets(library, monkeypatch):
    path, encoding = library
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    own = bpe.Encoder(bpe.encoder(path, P.PATTERN).ranks, P.PATTERN)
    text = "one two three one four five six one two seven eight"
    assert list(array("I", own.encode_packed(text))) == encoding.encode_ordinary(text) and len(own.chunks) <= 3


def test_bpe_round_trip(spark, library):
    path, encoding = library
    df = documents(spark, extra=True)
    rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    want = sorted(((i, len(ids := encoding.encode_ordinary(t)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in bpe.round_trip(df, path, P.PATTERN).collect()), key=str) == want
    encoded = bpe.encode(df, path, P.PATTERN)
    assert sorted((r["doc_id"], list(r["ids"])) for r in encoded.filter("doc_id IS NOT NULL").collect()) == sorted((i, encoding.encode_ordinary(t)) for i, t in rows if i is not None)
    assert sorted((r["doc_id"], bytes(r["body"]).decode()) for r in bpe.decode(encoded, path, P.PATTERN).filter("doc_id IS NOT NULL").collect()) == sorted((i, t) for i, t in rows if i is not None)
    assert bpe.round_trip(df.limit(0), path, P.PATTERN).count() == 0

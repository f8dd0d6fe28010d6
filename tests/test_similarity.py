from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import similarity as S

words = st.text("abcd ", max_size=14)


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(words, words)
@settings(max_examples=200, deadline=None)
def test_common_subsequence(a, b):
    assert S.common_subsequence(a, b) == slow_lcs(a, b)


@given(words, words)
@settings(max_examples=100, deadline=None)
def test_ratios_are_symmetric_and_bounded(a, b):
    assert S.token_set_ratio(a, b) == S.token_set_ratio(b, a) and 0 <= S.token_set_ratio(a, b) <= 100
    assert 0 <= S.partial_ratio(a, b) <= 100 and S.partial_ratio(a, a) == 100


def test_known_values():
    assert S.token_set_ratio("rakesh kumar yadav", "yadav rakesh") == 100
    assert S.token_set_ratio("", "x") == 0
    assert round(S.token_set_ratio("rakesh kumar yadav", "rocki yadav"), 1) == 62.5
    assert S.partial_ratio("rakesh", "mr rakesh kumar") == 100 and S.partial_ratio("", "x") == 0


def test_udfs(spark):
    df = spark.createDataFrame([("a b", "b a"), (None, "x")], "x string, y string")
    assert [r[0] for r in df.select(S.token_set_udf("x", "y")).collect()] == [100.0, None]
    assert df.select(S.partial_udf(F.lit("b"), "y").alias("p")).first()["p"] == 100.0


def test_search_scores_only_what_can_be_relevant(spark):
    """No relevant text is left out, and most numbers never reach Python."""
    import random

    from pyspark.sql import functions as F

    from tessera.functions.similarity import partial_ratio
    from tessera.operators import lookup as L

    pick = random.Random(2)
    for term in ("supplier 12", "ab", "a", "zubin 98123 zubin"):
        texts = ["".join(pick.choice(term + "xyz0") for _ in range(pick.randrange(0, 24))) for _ in range(400)]
        kept = spark.createDataFrame([(t,) for t in texts], "t string").select("t", L._reachable(term, F.col("t")).alias("r")).collect()
        assert all(r["r"] == r["t"] for r in kept if partial_ratio(term, r["t"]) >= L.RELEVANT)
    numbers = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 9, "0").alias("t"))
    assert numbers.filter(L._reachable("supplier 12", F.col("t")).isNotNull()).count() == 0

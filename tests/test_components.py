import random

import pytest

from tessera.operators.components import connected_components, string_components


def brute(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    least = {}
    for x in parent:
        least[root(x)] = min(least.get(root(x), x), x)
    return {x: least[root(x)] for x in parent}


@pytest.mark.parametrize("finish", [0, 10**6])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, finish, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(-60, 60), rnd.randrange(-60, 60)) for _ in range(55)] + [(1, None), (3, 3), (1000, 1001), (1000, 1001)]
    edges += [(200 + i, 201 + i) for i in range(40)]  # a path
    df = spark.createDataFrame(edges, "u long, v long").repartition(3)
    got = {r["node"]: r["component"] for r in connected_components(df, contracted=finish == 0, finish=finish).collect()}
    assert got == brute(edges)


def test_strings_and_empty(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("z", None)], "u string, v string")
    assert {r["node"]: r["component"] for r in string_components(df).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert string_components(df.limit(0)).count() == 0

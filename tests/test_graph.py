import random
from collections import deque
from itertools import permutations

import numpy as np
import pytest

from tessera.operators import graph as G


def links_of(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a string, b string, weight double")


def neighbours(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def depths(near, start):
    seen, queue = {start: 0}, deque([start])
    while queue:
        at = queue.popleft()
        for to in near.get(at, ()):
            if to not in seen:
                seen[to] = seen[at] + 1
                queue.append(to)
    return seen


def paths(near, a, b, depth):
    if a == b:
        yield (a,)
        return
    for to in near[a]:
        if depth[to] == depth[a] - 1:
            for rest in paths(near, to, b, depth):
                yield (a, *rest)


def test_betweenness_matches_all_shortest_paths(spark):
    rnd = random.Random(5)
    names = [f"n{i}" for i in range(14)]
    pairs = sorted({tuple(sorted(rnd.sample(names, 2))) for _ in range(22)})
    near = neighbours(pairs)
    want = dict.fromkeys(near, 0.0)
    nodes = sorted(near)
    for a in nodes:
        for b in nodes:
            if a < b and b in (reach := depths(near, b)) and a in reach:
                found = list(paths(near, a, b, reach))
                for p in found:
                    for x in p[1:-1]:
                        want[x] += 1 / len(found)
    scale = 2 / ((len(nodes) - 1) * (len(nodes) - 2))
    got = {r["n"]: r["betweenness"] for r in G.betweenness(links_of(spark, pairs)).collect()}
    assert got == pytest.approx({k: v * scale for k, v in want.items()})
    joined = {r["n"]: r["betweenness"] for r in G.betweenness(links_of(spark, pairs), most_links=2).collect()}
    assert joined == pytest.approx(got)  # by joins, as for graphs that no worker can hold


def test_communities_split_two_cliques(spark):
    pairs = [(f"a{i}", f"a{j}") for i in range(5) for j in range(i)] + [(f"b{i}", f"b{j}") for i in range(4) for j in range(i)] + [("a0", "b0")]
    links = links_of(spark, pairs)
    found = G.communities(links)
    got = {r["n"]: r["community"] for r in found.collect()}
    assert len({got[f"a{i}"] for i in range(5)}) == 1 and len({got[f"b{i}"] for i in range(4)}) == 1
    assert got["a0"] == 0 and got["b0"] == 1 and G.modularity(links, found) > 0.3


def test_cycles_match_brute_force(spark):
    rnd = random.Random(9)
    edges = sorted({(a, b) for a, b in ((rnd.randrange(7), rnd.randrange(7)) for _ in range(18)) if a != b})
    have = set(edges)
    want = set()
    for n in (3, 4, 5):
        for p in permutations(range(7), n):
            if p[0] == min(p) and all((x, y) in have for x, y in zip(p, (*p[1:], p[0]))):
                want.add(p)
    df = spark.createDataFrame([(f"x{a}", f"x{b}") for a, b in [*edges, (2, 2)]], "src string, dst string")
    assert {tuple(int(c[1:]) for c in r["cycle"]) for r in G.cycles(df, 5).collect()} == want


@pytest.fixture(scope="module")
def small(spark):
    edges = [("P1", "PH:1"), ("P1", "LOC:x"), ("P2", "LOC:x"), ("P2", "PH:2"), ("PH:1", "PH:2"), ("P3", "LOC:x")] + [("P1", f"ACCT:{i}") for i in range(6)]
    kinds = {"P": "Person", "PH": "Phone", "ACCT": "Account", "LOC": "Location"}
    ids = sorted({x for e in edges for x in e})
    nodes = spark.createDataFrame([(i, kinds[i.split(":")[0].rstrip("0123456789")], i, [i]) for i in ids], "id string, type string, label string, records array<string>")
    return nodes, spark.createDataFrame([(a, b, "OWNS", "FIR") for a, b in edges], "src string, dst string, etype string, source string")


def test_ego_collapse_and_path(spark, small):
    nodes, edges = small
    near, inside = G.ego(nodes, edges, "P1", 2)
    hops = {r["id"]: r["hop"] for r in near.collect()}
    assert hops["P1"] == 0 and hops["LOC:x"] == 1 and hops["PH:2"] == 2 and "P3" not in hops
    kept, links = G.collapse(near, inside, "P1")
    summary = [r for r in kept.collect() if r["type"] == "Summary"]
    assert [r["label"] for r in summary] == ["+6 more"] and len(summary[0]["children"]) == 6 and summary[0]["hop"] == 1
    assert any(r["dst"] == "COLLAPSED:P1:OWNS" for r in links.collect())
    assert G.shortest_path(nodes, edges, "P1", "P2") == ["P1", "PH:1", "PH:2", "P2"]
    assert G.shortest_path(nodes, edges, "P1", "P3") == [] and G.shortest_path(nodes, edges, "P1", "P1") == ["P1"]
    assert G.shortest_path(nodes, edges, "P1", "nobody") == []
    some, steps = G.path_subgraph(nodes, edges, ["P1", "PH:1", "PH:2"])
    assert some.count() == 3 and steps.count() == 2
    assert G.resolve_id(nodes, "P2") == "P2"
    with pytest.raises(ValueError):
        G.ego(nodes, edges, "P1", 9)


def test_degree(spark):
    got = {r["n"]: (r["degree"], r["centrality"]) for r in G.degree(links_of(spark, [("a", "b"), ("a", "c")])).collect()}
    assert got == {"a": (2, 1.0), "b": (1, 0.5), "c": (1, 0.5)}


def test_betweenness_of_many_sources_at_a_time(spark):
    """Sources go together level by level, in parts of any size; their tasks are not left to the size of their names."""
    pick = random.Random(4)
    pairs = sorted({tuple(sorted(pick.sample(range(40), 2))) for _ in range(60)})
    names, start, near = G._adjacency([(f"n{a}", f"n{b}") for a, b in [*pairs, *[(b, a) for a, b in pairs[:9]]]])
    whole = G._path_shares(start, near, np.arange(len(names)))
    parts = sum(G._path_shares(start, near, np.arange(i, min(i + 3, len(names)))) for i in range(0, len(names), 3))
    assert len(near) == 2 * len(pairs) and np.allclose(whole, parts)
    found = G.betweenness(spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "a string, b string"))
    assert f"Range (0, {len(names)}, step=1, splits=4)" in found._jdf.queryExecution().toString()
    got = {r["n"]: r["betweenness"] for r in found.collect()}
    assert np.allclose([got[n] for n in names], whole / ((len(names) - 1) * (len(names) - 2)))
    assert G.betweenness(spark.createDataFrame([], "a string, b string")).collect() == []


def test_links_of_persons_made_from_lists(spark, monkeypatch):
    """Short lists and small tasks change no link; sums are of fixed size, and tasks follow the number of links."""
    monkeypatch.setattr(G, "TOGETHER", 3)
    monkeypatch.setattr(G, "LINKS", 40)
    rnd = random.Random(3)
    people, things = [f"P{i}" for i in range(30)], {"PH:1": "1", "PH:2": None, "ACCT:1": "a1", "ACCT:2": "a2", "VEH:1": "v1"}
    kind = {"PH": "Phone", "AC": "Account", "VE": "Vehicle"}
    role = {p: "ACCUSED" if i % 3 else "WITNESS" for i, p in enumerate(people)}
    nodes = [(p, "Person", p, role[p]) for p in people] + [(t, kind[t[:2]], label, None) for t, label in things.items()]
    own = {(t, p) for t in things for p in rnd.sample(people, rnd.choice([1, 4, 12]))}
    own |= {("PH:1", p) for p in people[:20]}  # more than a list holds
    named = {(p, f"FIR:{rnd.randrange(4)}") for p in people}
    met = [(a, b, "CALLED", rnd.choice([1, 7, 30]), None) for a, b in (("PH:1", "PH:2"), ("PH:2", "PH:1"), ("PH:1", "PH:1"))]
    met += [(a, b, "TRANSFERRED_TO", 2, rnd.randrange(1000) / 4) for a, b in (("ACCT:1", "ACCT:2"), ("ACCT:2", "ACCT:1"))]
    edges = [(p, t, "OWNS", None, None) for t, p in own] + [(p, f, "NAMED_IN", None, None) for p, f in named] + met
    want = {}

    def link(p, q, weight, kind, calls=0, amount=0.0, shared=()):
        if p != q:
            at = want.setdefault((min(p, q), max(p, q)), [0.0, set(), 0, 0.0, []])
            at[0], at[2], at[3] = at[0] + weight, at[2] + calls, at[3] + amount
            at[1].add(kind)
            at[4] += shared

    of = lambda t: [p for u, p in own if u == t]
    for a, b, etype, n, amount in met:
        for p in of(a):
            for q in of(b):
                link(p, q, *((min(n, 20) / 4, "calls", n) if etype == "CALLED" else (3.0, "money", 0, amount)))
    for t, label in things.items():
        for p in of(t):
            for q in of(t):
                if p < q:
                    link(p, q, 3.0, f"shared {kind[t[:2]].lower()}", shared=[label] if label else [])
    for p, f in named:
        for q, g in named:
            if p < q and f == g and role[p] == role[q] == "ACCUSED":
                link(p, q, 4.0, "co-accused")
    found = G.persons_graph(
        spark.createDataFrame(nodes, "id string, type string, label string, role string"),
        spark.createDataFrame(edges, "src string, dst string, etype string, count long, amount double"),
    )
    got = {(r["a"], r["b"]): [r["weight"], r["kinds"], r["calls"], r["amount"], r["shared"]] for r in found.collect()}
    assert got == {k: [w, sorted(kinds), calls, amount, sorted(shared)] for k, (w, kinds, calls, amount, shared) in want.items()}
    assert "collect_set" not in found._jdf.queryExecution().toString() and found.rdd.getNumPartitions() >= len(want) // 40
    none = G.persons_graph(spark.createDataFrame(nodes, "id string, type string, label string, role string"), spark.createDataFrame([], "src string, dst string, etype string, count long, amount double"))
    assert none.count() == 0

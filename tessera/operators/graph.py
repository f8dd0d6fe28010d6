"""The property graph: building, projecting to persons, walking, ranking and grouping."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as X
from tessera.operators.components import cut, string_components

OWNING = ["OWNS", "SEEN_WITH", "REGISTERED_TO"]
#: Node types that connect everything with everything.
HUBS = ["Location"]
COLLAPSIBLE, COLLAPSE_OVER = ["Phone", "Account"], 4
NODE = (
    "id string, type string, label string, role string, protected boolean, holder string, station string, date string, make string, "
    "model string, colour string, owner string, stations array<string>, aka array<string>, records array<string>, merged boolean, in_review boolean"
)
EDGE = "src string, dst string, etype string, source string, record string, count long, amount double, duration_s long, first string, last string"


def _fit(df: DataFrame, schema: str) -> DataFrame:
    """The schema's columns, in order; absent ones null."""
    out = []
    for part in schema.split(", "):
        name, kind = part.split()
        out.append((F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name))
    return df.select(*out)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def build(tables: dict[str, DataFrame], resolved: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the five sources; victims' people never appear, their numbers only masked and opaque."""
    persons = tables["person"].join(tables["fir"].select(F.col("id").alias("fir_id"), "station", "date"), "fir_id")
    victims, people = persons.filter("role = 'VICTIM'"), persons.filter("role <> 'VICTIM'")
    secret = lambda c: victims.filter(F.col(c).isNotNull()).select(F.col(c).alias("value")).distinct().withColumn("secret", F.lit(True))
    phones, accounts = secret("phone"), secret("account_no")
    if resolved:
        people = people.join(resolved["members"], "id", "left")
    else:
        people = people.withColumn("master_id", F.lit(None).cast("string"))
    people = people.withColumn("node", F.coalesce("master_id", "id"))

    def coded(df: DataFrame, column: str, prefix: str, secrets: DataFrame) -> DataFrame:
        """The column as node ids; a victim's value as an opaque one."""
        marked = df.join(secrets.withColumnRenamed("value", column), column, "left")
        node = F.when(F.col("secret"), F.concat(F.lit(f"{prefix}:"), X.opaque(column))).otherwise(F.concat(F.lit(f"{prefix}:"), F.col(column)))
        return marked.withColumn(f"{column}_node", F.when(F.col(column).isNotNull(), node)).drop("secret")

    people = coded(coded(people, "phone", "PH", phones), "account_no", "ACCT", accounts)
    places = F.explode(X.known_localities(F.col("address_key")))
    located = people.withColumn("address_key", X.phonetic("address")).select("node", "id", places.alias("place"))
    from_report = lambda df, dst, etype: df.filter(dst.isNotNull()).select(F.col("node").alias("src"), dst.alias("dst"), F.lit(etype).alias("etype"), F.lit("FIR").alias("source"), F.col("id").alias("record"))
    edges = [
        from_report(people, F.concat(F.lit("FIR:"), F.col("fir_id")), "NAMED_IN"),
        from_report(people, F.col("phone_node"), "OWNS"),
        from_report(people, F.col("account_no_node"), "OWNS"),
        from_report(people, F.concat(F.lit("VEH:"), F.col("vehicle")), "SEEN_WITH"),
        from_report(located, F.concat(F.lit("LOC:"), F.col("place")), "LIVES_IN"),
    ]
    # registrations: to the one person of that display name, if there is exactly one
    owners = people.select(F.lower(X.display_name("name")).alias("owner_key"), "node").groupBy("owner_key").agg(F.collect_set("node").alias("who")).filter("size(who) = 1")
    cars = tables["vehicle_reg"].withColumn("owner_key", F.lower(X.display_name("owner_name"))).join(owners, "owner_key", "left").withColumn("vid", F.concat(F.lit("VEH:"), F.col("reg_no")))
    edges.append(cars.filter("who IS NOT NULL").select(F.col("vid").alias("src"), F.col("who")[0].alias("dst"), F.lit("REGISTERED_TO").alias("etype"), F.lit("RTO").alias("source")))
    calls = tables.get("cdr")
    if calls is not None:
        links = coded(coded(call_links(calls), "caller", "PH", phones), "callee", "PH", phones)
        edges.append(links.select(F.col("caller_node").alias("src"), F.col("callee_node").alias("dst"), F.lit("CALLED").alias("etype"), F.lit("CDR").alias("source"), "count", "duration_s", "first", "last"))
    bank = tables["bank_txn"]
    kyc = coded(coded(bank.select("account_no", "holder_name", "linked_phone").distinct(), "account_no", "ACCT", accounts), "linked_phone", "PH", phones)
    edges.append(kyc.filter("linked_phone IS NOT NULL").select(F.col("account_no_node").alias("src"), F.col("linked_phone_node").alias("dst"), F.lit("KYC_PHONE").alias("etype"), F.lit("BANK").alias("source")))
    moved = coded(coded(transfer_links(bank), "account_no", "ACCT", accounts), "counterpart", "ACCT", accounts)
    edges.append(moved.select(F.col("account_no_node").alias("src"), F.col("counterpart_node").alias("dst"), F.lit("TRANSFERRED_TO").alias("etype"), F.lit("BANK").alias("source"), "count", "amount", "first", "last"))
    edges = cut(_all([_fit(e, EDGE) for e in edges]))

    first = people.groupBy("node").agg(F.min_by(F.struct("role", "name", "station"), "id").alias("r"), F.array_sort(F.collect_set("id")).alias("records"))
    nodes = first.select(F.col("node").alias("id"), F.lit("Person").alias("type"), "r.role", F.coalesce(F.nullif(X.display_name("r.name"), F.lit("")), "r.name").alias("label"), F.array("r.station").alias("stations"), "records")
    if resolved:
        masters = resolved["masters"].select(F.col("master_id").alias("id"), "canonical", "names", F.col("stations").alias("all_stations"), "members")
        asked = resolved["review"].select(F.explode(F.array("id_a", "id_b")).alias("rid")).distinct()
        reviewed = people.join(asked, F.col("id") == F.col("rid"), "left_semi").select(F.col("node").alias("id")).distinct().withColumn("in_review", F.lit(True))
        nodes = nodes.join(masters, "id", "left").join(reviewed, "id", "left")
        nodes = nodes.select(
            "id", "type", "role", F.coalesce("canonical", "label").alias("label"), F.coalesce("all_stations", "stations").alias("stations"),
            F.filter("names", lambda n: X.latin_display(n) != F.col("canonical")).alias("aka"), F.coalesce("members", "records").alias("records"),
            F.col("canonical").isNotNull().alias("merged"), F.coalesce("in_review", F.lit(False)).alias("in_review"),
        )
    parts = [nodes]
    reports = people.select("fir_id", "station", "date").distinct()
    parts.append(reports.select(F.concat(F.lit("FIR:"), F.col("fir_id")).alias("id"), F.lit("FIR").alias("type"), F.col("fir_id").alias("label"), "station", "date"))
    parts.append(located.select(F.concat(F.lit("LOC:"), F.col("place")).alias("id"), F.lit("Location").alias("type"), F.col("place").alias("label")).distinct())
    seen = people.filter("vehicle IS NOT NULL").select(F.concat(F.lit("VEH:"), F.col("vehicle")).alias("id")).distinct().withColumn("seen", F.lit(True))
    registered = cars.select(F.col("vid").alias("id"), "reg_no", "make", "model", "colour", F.col("owner_name").alias("owner"), F.col("who").isNotNull().alias("known"))
    vehicles = seen.join(registered, "id", "full").filter("seen OR known")
    parts.append(vehicles.select("id", F.lit("Vehicle").alias("type"), F.substring_index("id", ":", -1).alias("label"), "make", "model", "colour", "owner"))
    numbers = [people.select(F.col("phone").alias("value"), F.col("phone_node").alias("id")), kyc.select(F.col("linked_phone").alias("value"), F.col("linked_phone_node").alias("id"))]
    if calls is not None:
        numbers += [links.select(F.col(c).alias("value"), F.col(f"{c}_node").alias("id")) for c in ("caller", "callee")]
    hidden = F.startswith(F.substring_index("id", ":", -1), F.lit("V-"))
    parts.append(_all(numbers).filter("value IS NOT NULL").distinct().select("id", F.lit("Phone").alias("type"), F.when(hidden, X.mask("value")).otherwise(F.col("value")).alias("label"), hidden.alias("protected")))
    held = [people.select(F.col("account_no").alias("value"), F.col("account_no_node").alias("id"), F.lit(None).cast("string").alias("holder")), kyc.select(F.col("account_no").alias("value"), F.col("account_no_node").alias("id"), F.col("holder_name").alias("holder"))]
    held += [moved.select(F.col(c).alias("value"), F.col(f"{c}_node").alias("id"), F.lit(None).cast("string").alias("holder")) for c in ("account_no", "counterpart")]
    held = _all(held).filter("value IS NOT NULL").groupBy("value", "id").agg(F.min("holder").alias("holder"))
    parts.append(held.select("id", F.lit("Account").alias("type"), F.when(hidden, X.mask("value")).otherwise(F.col("value")).alias("label"), F.when(hidden, F.lit("Protected (victim)")).otherwise(F.col("holder")).alias("holder"), hidden.alias("protected")))
    return cut(_all([_fit(p, NODE) for p in parts])), edges


def call_links(calls: DataFrame) -> DataFrame:
    return calls.groupBy("caller", "callee").agg(F.count("*").alias("count"), F.sum("duration_s").alias("duration_s"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def transfer_links(bank: DataFrame) -> DataFrame:
    moved = bank.filter((F.col("txn_type") == "TRANSFER") & F.col("counterpart").rlike("^[0-9]"))
    return moved.groupBy("account_no", "counterpart").agg(F.count("*").alias("count"), F.round(F.sum("amount"), 2).alias("amount"), F.min("ts").alias("first"), F.max("ts").alias("last"))


# --- persons ---------------------------------------------------------------------------------------


def owners(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """thing and person, through ownership in either direction; an account follows its phone."""
    people = nodes.filter("type = 'Person'").select(F.col("id").alias("person"))
    owning = edges.filter(F.col("etype").isin(OWNING)).select("src", "dst")
    direct = owning.join(people, F.col("src") == F.col("person")).select(F.col("dst").alias("thing"), "person")
    direct = direct.unionByName(owning.join(people, F.col("dst") == F.col("person")).select(F.col("src").alias("thing"), "person")).distinct()
    kyc = edges.filter("etype = 'KYC_PHONE'").select(F.col("src").alias("account"), F.col("dst").alias("thing"))
    return direct.unionByName(kyc.join(direct, "thing").select(F.col("account").alias("thing"), "person")).distinct()


#: Persons of a thing in one row, and links that one task makes.
TOGETHER, LINKS = 1000, 1_000_000
KINDS = ["calls", "co-accused", "money", "shared account", "shared phone", "shared vehicle"]


def _lists(owned: DataFrame) -> DataFrame:
    """thing, lot and who: the persons of each thing in lists of about TOGETHER."""
    lots = owned.groupBy("thing").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("lots"))
    lot = F.pmod(F.xxhash64("person"), F.col("lots")).cast("int")
    return cut(owned.join(lots, "thing").groupBy("thing", lot.alias("lot")).agg(F.collect_list("person").alias("who")))


def _together(lists: DataFrame) -> DataFrame:
    """Two lists ``us`` and ``them`` of one thing, each two once; ``within``: a list with itself."""
    first = lists.select("thing", F.col("lot").alias("here"), F.col("who").alias("us"))
    second = lists.select("thing", F.col("lot").alias("there"), F.col("who").alias("them"))
    return first.join(second, "thing").filter("here <= there").withColumn("within", F.expr("here = there"))


def _paired(lists: DataFrame, lots: int, *more: str) -> DataFrame:
    """Pairs a < b of ``us`` and ``them``, in ``lots`` partitions by pair; lists are dealt first, so no task makes many more than LINKS."""
    pairs = lists.repartition(lots, "us", "them").select(F.explode("us").alias("u"), "them", "within", *more).select("u", F.explode("them").alias("v"), "within", *more)
    pairs = pairs.filter("u < v OR (u > v AND NOT within)")
    return pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), *more).repartition(lots, "a", "b")


def persons_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected links a < b with weight, kinds, calls, amount and what they share.

    Persons stay in lists until the number of links is known, which sets the number of tasks; sums of a pair are of fixed size.
    """
    bit = lambda kind: 1 << KINDS.index(kind)
    own = owners(nodes, edges)
    lists = _lists(own)
    met = edges.filter(F.col("etype").isin("CALLED", "TRANSFERRED_TO")).withColumn("called", F.col("etype") == "CALLED")
    met = met.groupBy(F.least("src", "dst").alias("thing"), F.greatest("src", "dst").alias("other")).agg(
        F.sum(F.when(F.col("called"), F.least("count", F.lit(20)) / 4).otherwise(3.0)).alias("weight"),
        F.bit_or(F.when(F.col("called"), bit("calls")).otherwise(bit("money"))).alias("kinds"),
        F.sum(F.when(F.col("called"), F.col("count"))).alias("calls"),
        F.sum(F.when(~F.col("called"), F.col("amount"))).alias("amount"),
    )
    met = met.join(lists.select("thing", F.col("who").alias("us")), "thing").join(lists.select(F.col("thing").alias("other"), F.col("who").alias("them")), "other")
    met = met.select("us", "them", F.lit(False).alias("within"), "weight", "kinds", "calls", "amount")
    accused = nodes.filter("type = 'Person' AND role = 'ACCUSED'").select(F.col("id").alias("person"))
    named = edges.filter("etype = 'NAMED_IN'").select(F.col("src").alias("person"), F.col("dst").alias("thing")).distinct().join(accused, "person")
    co = _together(_lists(named)).select("us", "them", "within", F.lit(4.0).alias("weight"), F.lit(bit("co-accused")).alias("kinds"))
    kind = F.when(F.col("type") == "Account", bit("shared account")).when(F.col("type") == "Phone", bit("shared phone")).otherwise(bit("shared vehicle"))
    things = nodes.filter(F.col("type").isin("Phone", "Vehicle", "Account")).select(F.col("id").alias("thing"), kind.alias("kinds"), F.col("label").alias("shared"))
    shared = _together(lists).join(things, "thing").select("us", "them", "within", F.lit(3.0).alias("weight"), "kinds", "shared")
    dealt = cut(met.unionByName(co, True).unionByName(shared, True))
    lots = -(-(dealt.agg(F.sum(F.size("us").cast("long") * F.size("them"))).first()[0] or 1) // LINKS)
    links = _paired(dealt, lots, "weight", "kinds", "calls", "amount").groupBy("a", "b").agg(
        F.sum("weight").alias("weight"), F.bit_or("kinds").alias("kinds"), F.sum("calls").alias("calls"), F.sum("amount").alias("amount")
    )
    labels = _paired(dealt.filter("shared IS NOT NULL"), lots, "shared").groupBy("a", "b").agg(F.array_sort(F.collect_list("shared")).alias("shared"))
    # both are dealt by pair already, and a task's share of labels is bounded by LINKS: no sort
    return links.join(labels.hint("shuffle_hash"), ["a", "b"], "left").select(
        "a", "b", "weight",
        F.array_compact(F.array(*[F.when(F.col("kinds").bitwiseAND(bit(k)) != 0, k) for k in KINDS])).alias("kinds"),
        F.coalesce("calls", F.lit(0)).alias("calls"),
        F.coalesce("amount", F.lit(0.0)).alias("amount"),
        F.coalesce("shared", F.array().cast("array<string>")).alias("shared"),
    )


def _both_ways(links: DataFrame, *more: str) -> DataFrame:
    extra = [F.col(c) for c in more]
    return links.select(F.col("a").alias("n"), F.col("b").alias("m"), *extra).unionByName(links.select(F.col("b").alias("n"), F.col("a").alias("m"), *extra))


def degree(links: DataFrame) -> DataFrame:
    """n, degree, and centrality: degree over the number of other nodes."""
    counted = _both_ways(links).distinct().groupBy("n").agg(F.count("*").alias("degree"))
    total = counted.agg((F.count("*") - 1).alias("others"))
    return counted.crossJoin(F.broadcast(total)).select("n", "degree", F.coalesce(F.try_divide("degree", "others"), F.lit(0.0)).alias("centrality"))


#: Links that one worker may hold for shortest-path counting.
MOST_LINKS = 5_000_000


#: Array entries that a task works on at a time, and tasks that share the sources at most.
PATHS, PATH_TASKS = 2_000_000, 960


def _adjacency(pairs: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the nodes in order, and for node i its neighbours ``near[start[i]:start[i + 1]]``."""
    names, at = np.unique(np.array(pairs, dtype=object).reshape(-1, 2), return_inverse=True)
    a, b = at.reshape(-1, 2).T
    one, other = np.concatenate([a, b]), np.concatenate([b, a])
    links = np.unique(one * max(len(names), 1) + other)  # a link given both ways counts once
    one, other = np.divmod(links, max(len(names), 1))
    return names, np.searchsorted(one, np.arange(len(names) + 1)), other


def _path_shares(start: np.ndarray, near: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Every node's sum of shares in the shortest paths from ``sources``, all of which go level by level together."""
    n = len(start) - 1
    level = np.arange(len(sources)) * n + sources
    firsts, new, ways, mark = level, np.ones(len(sources) * n, bool), np.zeros(len(sources) * n), np.empty(len(sources) * n, np.int64)
    new[level], ways[level], steps = False, 1.0, []
    while len(level):
        node = level % n
        degree = start[node + 1] - start[node]
        at = np.arange(degree.sum()) - np.repeat(np.cumsum(degree) - degree - start[node], degree)
        to = np.repeat(level - node, degree) + near[at]
        ahead = new[to]
        by, to = np.repeat(level, degree)[ahead], to[ahead]
        np.add.at(ways, to, ways[by])
        steps.append((by, to))
        places = np.arange(len(to))
        mark[to] = places
        level = to[mark[to] == places]
        new[level] = False
    share = np.zeros(len(ways))
    for by, to in reversed(steps):
        np.add.at(share, by, ways[by] / ways[to] * (1.0 + share[to]))
    share[firsts] = 0.0
    return share.reshape(len(sources), n).sum(0)


def betweenness(links: DataFrame, most_links: int = MOST_LINKS) -> DataFrame:
    """Exact normalised betweenness (unweighted): each task counts shortest paths from its share of sources.

    Every worker holds the links, whose number is checked first; of a larger graph the paths are counted by
    joins, level by level, for blocks of sources.
    """
    spark = links.sparkSession
    pairs = links.select("a", "b").filter("a <> b").distinct()
    if pairs.count() > most_links:
        return _betweenness_joined(pairs)
    names, start, near = _adjacency([tuple(r) for r in pairs.collect()])
    held, total = spark.sparkContext.broadcast((start, near)), len(names)
    scale = 1.0 / ((total - 1) * (total - 2)) if total > 2 else 1.0

    def run(frames):
        start, near = held.value
        score = np.zeros(len(start) - 1)
        most = max(1, PATHS // (len(score) + len(near)))
        for pdf in frames:
            sources = pdf["id"].to_numpy()
            for at in range(0, len(sources), most):
                score += _path_shares(start, near, sources[at : at + most])
        found = np.flatnonzero(score)
        yield pd.DataFrame({"id": found, "part": score[found]})

    # the sources are few and small, their work is not: their tasks are set here
    sources = spark.range(0, total, 1, max(1, min(total, PATH_TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    summed = sources.mapInPandas(run, "id long, part double").groupBy("id").agg(F.sum("part").alias("part"))
    named = spark.createDataFrame(pd.DataFrame({"id": np.arange(total), "n": names}), "id long, n string")
    return named.join(summed, "id", "left").select("n", (F.coalesce("part", F.lit(0.0)) * scale).alias("betweenness"))


#: Sources whose paths are counted at a time when no worker can hold the links.
SOURCES = 1000


def _betweenness_joined(pairs: DataFrame, block: int = SOURCES) -> DataFrame:
    """:func:`betweenness` by joins: (source, node, depth, ways) forwards, then each node's share backwards."""
    ways_of = cut(_both_ways(pairs).distinct())
    nodes = cut(ways_of.select("n").distinct())
    total = nodes.count()
    lots = -(-total // block)
    scale, score = 1.0 / ((total - 1) * (total - 2)) if total > 2 else 1.0, None
    for lot in range(lots):
        seen = cut(nodes.filter(F.pmod(F.xxhash64("n"), F.lit(lots)) == lot).select(F.col("n").alias("source"), "n", F.lit(0).alias("depth"), F.lit(1.0).alias("ways")))
        depth, level = 0, seen
        while not level.isEmpty():
            ahead = level.join(ways_of, "n").groupBy("source", F.col("m").alias("n")).agg(F.sum("ways").alias("ways"))
            level = cut(ahead.join(seen, ["source", "n"], "left_anti").select("source", "n", F.lit(depth + 1).alias("depth"), "ways"))
            seen, depth = cut(seen.unionByName(level)), depth + 1
        shares = None  # of the level below: source, m, ways, share
        for at in range(depth - 1, 0, -1):
            here = seen.filter(F.col("depth") == at).select("source", "n", "ways")
            if shares is None:
                here = here.withColumn("share", F.lit(0.0))
            else:
                given = shares.select("source", F.col("n").alias("m"), ((1.0 + F.col("share")) / F.col("ways")).alias("each")).join(ways_of, "m").groupBy("source", "n").agg(F.sum("each").alias("each"))
                here = here.join(given, ["source", "n"], "left").select("source", "n", "ways", F.coalesce(F.col("ways") * F.col("each"), F.lit(0.0)).alias("share"))
            shares = cut(here)
            part = shares.groupBy("n").agg(F.sum("share").alias("part"))
            score = part if score is None else cut(score.unionByName(part).groupBy("n").agg(F.sum("part").alias("part")))
    if score is None:
        return nodes.select("n", F.lit(0.0).alias("betweenness"))
    return nodes.join(score, "n", "left").select("n", (F.coalesce("part", F.lit(0.0)) * scale).alias("betweenness"))


def _louvain(links: list[tuple[str, str, float]]) -> dict[str, int]:
    """Communities by local moves and contraction; nodes in order of name, so the result is repeatable."""
    names = sorted({x for a, b, _ in links for x in (a, b)})
    at = {n: i for i, n in enumerate(names)}
    near: list[dict[int, float]] = [{} for _ in names]
    for a, b, w in links:
        i, j = at[a], at[b]
        near[i][j] = near[i].get(j, 0.0) + w
        if i != j:
            near[j][i] = near[j].get(i, 0.0) + w
    loops, where = [0.0] * len(names), list(range(len(names)))
    total = sum(sum(x.values()) for x in near) / 2
    while total:
        strength = [sum(x.values()) + 2 * loops[i] for i, x in enumerate(near)]
        home, sums = list(range(len(near))), strength[:]
        moved, moved_ever = True, False
        while moved:
            moved = False
            for i in range(len(near)):
                to: dict[int, float] = {}
                for j, w in near[i].items():
                    if j != i:
                        to[home[j]] = to.get(home[j], 0.0) + w
                sums[home[i]] -= strength[i]
                gain = lambda c: to.get(c, 0.0) - sums[c] * strength[i] / (2 * total)  # noqa: B023, E731
                best = max(sorted(to), key=gain, default=home[i])
                if gain(best) > gain(home[i]) + 1e-12:
                    home[i], moved, moved_ever = best, True, True
                sums[home[i]] += strength[i]
        if not moved_ever:
            break
        kept = {c: k for k, c in enumerate(sorted(set(home)))}
        home = [kept[c] for c in home]
        where = [home[c] for c in where]
        fresh: list[dict[int, float]] = [{} for _ in kept]
        inner = [0.0] * len(kept)
        for i, x in enumerate(near):
            inner[home[i]] += loops[i]
            for j, w in x.items():
                if home[i] == home[j]:
                    inner[home[i]] += w / 2
                else:
                    fresh[home[i]][home[j]] = fresh[home[i]].get(home[j], 0.0) + w
        near, loops = fresh, inner
    return dict(zip(names, where))


def communities(links: DataFrame) -> DataFrame:
    """n and community, numbered from the largest; weighted Louvain, one connected component a task.

    A component has to fit a worker: one of more than MOST_LINKS links raises.
    """
    part = string_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "a")
    weight = F.col("weight") if "weight" in links.columns else F.lit(1.0)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = _louvain(list(zip(pdf["a"], pdf["b"], pdf["weight"])))
        return pd.DataFrame({"n": list(found), "part": [f"{key[0]}/{c}" for c in found.values()]})

    placed = links.select("a", "b", weight.cast("double").alias("weight")).join(part, "a")
    most = placed.groupBy("component").count().agg(F.max("count")).first()[0] or 0
    if most > MOST_LINKS:
        raise ValueError(f"a component of {most} links is more than a worker may hold ({MOST_LINKS})")
    found = placed.groupBy("component").applyInPandas(run, "n string, part string")
    found = cut(found)
    sizes = found.groupBy("part").agg(F.count("*").alias("size"), F.min("n").alias("least"))
    numbered = sizes.withColumn("community", F.row_number().over(Window.orderBy(F.desc("size"), "least")) - 1)
    return found.join(numbered.select("part", "community"), "part").select("n", "community")


def modularity(links: DataFrame, found: DataFrame) -> float:
    """Weighted modularity of a division into communities."""
    of = lambda c, k: found.select(F.col("n").alias(c), F.col("community").alias(k))
    both = links.join(of("a", "ca"), "a").join(of("b", "cb"), "b")
    total = both.agg(F.sum("weight")).first()[0] or 0.0
    if not total:
        return 0.0
    inner = both.filter("ca = cb").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    strength = _both_ways(links, "weight").join(found, "n").groupBy("community").agg(F.sum("weight").alias("s"))
    return inner / total - strength.agg(F.sum(F.pow(F.col("s") / (2 * total), 2))).first()[0]


def key_players(nodes: DataFrame, links: DataFrame, top: int = 8) -> DataFrame:
    """The ``top`` persons by betweenness, then degree, with why they matter."""
    grouped, degrees = communities(links), degree(links)
    reach = _both_ways(links).join(grouped.withColumnRenamed("n", "m"), "m").groupBy("n").agg(F.countDistinct("community").alias("groups"))
    ranked = betweenness(links).join(degrees, "n").orderBy(F.desc("betweenness"), F.desc("degree"), "n").limit(top)
    reason = F.when(F.col("groups") > 1, F.concat(F.lit("bridges "), F.col("groups"), F.lit(" groups"))).otherwise(F.concat(F.lit("hub of "), F.col("degree"), F.lit(" direct contacts")))
    about = nodes.select(F.col("id").alias("n"), "label", F.size("records").alias("records"))
    out = ranked.join(reach, "n").join(grouped, "n").join(about, "n", "left")
    return out.select(F.col("n").alias("id"), "label", F.round("betweenness", 4).alias("betweenness"), "degree", "community", reason.alias("reason"), "records")


# --- walks -----------------------------------------------------------------------------------------


def ego(nodes: DataFrame, edges: DataFrame, center: str, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``hops`` (1 to 4) with their hop, and the edges among them; hubs are reached, not crossed."""
    if not 1 <= hops <= 4:
        raise ValueError("hops is 1 to 4")
    ways = edges.select(F.col("src").alias("n"), F.col("dst").alias("m")).unionByName(edges.select(F.col("dst").alias("n"), F.col("src").alias("m"))).distinct()
    hubs = nodes.filter(F.col("type").isin(HUBS)).select(F.col("id").alias("n"))
    seen = nodes.filter(F.col("id") == center).select(F.col("id").alias("n"), F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        frontier = seen.filter(F.col("hop") == hop - 1)
        if hop > 1:
            frontier = frontier.join(hubs, "n", "left_anti")
        reached = frontier.join(ways, "n").select(F.col("m").alias("n")).distinct().join(seen, "n", "left_anti")
        seen = cut(seen.unionByName(reached.withColumn("hop", F.lit(hop))))
    inside = seen.select(F.col("n").alias("id"), "hop")
    kept = edges.join(inside.select(F.col("id").alias("src")), "src", "left_semi").join(inside.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes.join(inside, "id"), kept


def collapse(nodes: DataFrame, edges: DataFrame, center: str, over: int = COLLAPSE_OVER) -> tuple[DataFrame, DataFrame]:
    """More than ``over`` phones or accounts that hang on one node by one kind of edge become one Summary node."""
    ends = edges.select(F.col("src").alias("id"), F.col("dst").alias("parent"), "etype", "source").unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("parent"), "etype", "source"))
    single = ends.groupBy("id").agg(F.count("*").alias("n"), F.first("parent").alias("parent"), F.first("etype").alias("etype"), F.first("source").alias("source")).filter("n = 1")
    leaves = single.join(nodes.filter(F.col("type").isin(COLLAPSIBLE) & (F.col("id") != center)), "id")
    child = F.struct("id", "type", "label")
    groups = leaves.groupBy("parent", "etype").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(child)).alias("children"), F.min("source").alias("source")).filter(F.col("n") > over)
    gone = groups.select(F.explode("children.id").alias("id"))
    hop = nodes.select(F.col("id").alias("parent"), (F.col("hop") + 1).alias("hop")) if "hop" in nodes.columns else nodes.select(F.col("id").alias("parent"), F.lit(1).alias("hop"))
    made = groups.join(hop, "parent").select(F.concat(F.lit("COLLAPSED:"), "parent", F.lit(":"), "etype").alias("id"), F.lit("Summary").alias("type"), F.concat(F.lit("+"), F.col("n"), F.lit(" more")).alias("label"), "hop", "children", "parent", "etype", "source")
    kept = nodes.join(gone, "id", "left_anti").unionByName(made.drop("parent", "etype", "source"), allowMissingColumns=True)
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    added = made.select(F.col("parent").alias("src"), F.col("id").alias("dst"), "etype", "source")
    return kept, left.unionByName(added, allowMissingColumns=True)


def shortest_path(nodes: DataFrame, edges: DataFrame, start: str, end: str) -> list[str]:
    """Node ids along a shortest undirected path without hubs (smallest ids first on ties); [] if there is none, at any length."""
    plain = nodes.filter(~F.col("type").isin(HUBS)).select(F.col("id").alias("n"))
    if plain.filter(F.col("n").isin(start, end)).count() < len({start, end}):
        return []
    if start == end:
        return [start]
    ways = edges.select(F.col("src").alias("n"), F.col("dst").alias("m")).unionByName(edges.select(F.col("dst").alias("n"), F.col("src").alias("m"))).distinct()
    ways = cut(ways.join(plain, "n", "left_semi").join(plain.withColumnRenamed("n", "m"), "m", "left_semi"))
    seen = plain.filter(F.col("n") == start).select("n", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("via"))
    for hop in itertools.count(1):
        reached = seen.filter(F.col("hop") == hop - 1).select("n").join(ways, "n").groupBy("m").agg(F.min("n").alias("via"))
        reached = cut(reached.withColumnRenamed("m", "n").join(seen, "n", "left_anti").select("n", F.lit(hop).alias("hop"), "via"))
        if reached.isEmpty():
            return []
        seen = cut(seen.unionByName(reached))
        if not reached.filter(F.col("n") == end).isEmpty():
            break
    path, at = [end], end
    while at != start:  # one row a hop
        at = seen.filter(F.col("n") == at).first()["via"]
        path.append(at)
    return path[::-1]


def path_subgraph(nodes: DataFrame, edges: DataFrame, path: list[str]) -> tuple[DataFrame, DataFrame]:
    """The path's nodes with their place as ``hop`` and whose they are (``owned_by``), and all edges between neighbours on it."""
    spark = nodes.sparkSession
    places = spark.createDataFrame([(n, i) for i, n in enumerate(path)], "id string, hop int")
    steps = spark.createDataFrame([(a, b) for x, y in zip(path, path[1:]) for a, b in ((x, y), (y, x))], "src string, dst string").distinct()
    own = owners(nodes, edges).withColumnRenamed("thing", "id").join(places.select("id"), "id", "left_semi")
    label = nodes.select(F.col("id").alias("person"), F.col("label").alias("owner_label"))
    named = own.join(label, "person").groupBy("id").agg(F.array_sort(F.collect_set("owner_label")).alias("owned_by"))
    return nodes.join(F.broadcast(places), "id").join(named, "id", "left"), edges.join(F.broadcast(steps), ["src", "dst"])


def cycles(links: DataFrame, most: int = 5) -> DataFrame:
    """Simple directed cycles of 3 to ``most`` nodes: column ``cycle``, starting at its smallest node.

    Paths only pass nodes larger than their start, so each cycle is found once; length is bounded by joins.
    """
    steps = links.select("src", "dst").filter("src <> dst").distinct()
    # a node without a way in and out is on no cycle
    steps = steps.join(steps.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(steps.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    path = steps.filter("dst > src").select(F.col("src").alias("start"), F.col("dst").alias("at"), F.array("src", "dst").alias("cycle"))
    found = None
    for size in range(3, most + 1):
        path = path.join(steps.select(F.col("src").alias("at"), F.col("dst").alias("to")), "at").filter((F.col("to") > F.col("start")) & ~F.array_contains("cycle", F.col("to")))
        path = path.select("start", F.col("to").alias("at"), F.array_append("cycle", F.col("to")).alias("cycle"))
        closed = path.join(steps.select(F.col("src").alias("at"), F.col("dst").alias("start")), ["at", "start"], "left_semi").select("cycle")
        found = closed if found is None else found.unionByName(closed)
    return found


def overview(nodes: DataFrame, edges: DataFrame, level: str = "persons") -> tuple[DataFrame, DataFrame]:
    """Nodes with community and centrality, and links: of persons, or of all entities without hubs and loose ends."""
    if level not in ("persons", "entities"):
        raise ValueError("level is persons or entities")
    if level == "persons":
        links = cut(persons_graph(nodes, edges))
    else:
        owned = owners(nodes, edges).select(F.col("thing").alias("id")).distinct()
        loose = nodes.filter(F.col("type").isin(COLLAPSIBLE)).join(owned, "id", "left_anti").select("id")
        kept = nodes.filter(~F.col("type").isin(HUBS)).join(loose, "id", "left_anti").select("id")
        inside = edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi")
        links = cut(inside.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().withColumn("weight", F.lit(1.0)))
    scored = communities(links).join(degree(links), "n").join(betweenness(links), "n")
    return nodes.join(scored.withColumnRenamed("n", "id"), "id"), links


def resolve_id(nodes: DataFrame, raw: str) -> str:
    """The node that stands for a record."""
    row = nodes.filter(F.array_contains("records", raw) | (F.col("id") == raw)).orderBy((F.col("id") != raw)).select("id").first()
    return row["id"] if row else raw


def flag_alerted(nodes: DataFrame, alerts: DataFrame) -> DataFrame:
    """Nodes with ``alerted``: whether an alert names them or a record that they stand for."""
    named = alerts.select(F.explode("entities").alias("entity")).distinct()
    own = nodes.select("id", F.explode(F.array_union(F.array("id"), F.coalesce("records", F.array().cast("array<string>")))).alias("entity"))
    hit = own.join(named, "entity", "left_semi").select("id").distinct().withColumn("alerted", F.lit(True))
    return nodes.join(hit, "id", "left").withColumn("alerted", F.coalesce("alerted", F.lit(False)))


def as_json(df: DataFrame) -> Column:
    """A row as JSON without nulls and empties."""
    blank = lambda c, t: F.when(F.col(c) != "", F.col(c)) if t == "string" else F.when(F.size(c) > 0, F.col(c)) if t.startswith("array") else F.col(c)
    return F.to_json(F.struct(*[blank(c, t).alias(c) for c, t in df.dtypes]))

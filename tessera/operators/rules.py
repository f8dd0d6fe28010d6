"""Pattern rules: each turns tables, resolution and graph into alerts; register more in RULES."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import windows as W
from tessera.operators.components import cut

ALERT = ["alert_id", "rule", "title", "detail", "entities", "confidence", "source_ids", "evidence"]


@dataclass
class Context:
    """What rules look at; the persons' graph is made when first asked for."""

    tables: dict[str, DataFrame]
    resolved: dict[str, DataFrame]
    nodes: DataFrame
    edges: DataFrame
    _links: DataFrame | None = field(default=None, repr=False)

    @property
    def links(self) -> DataFrame:
        if self._links is None:
            self._links = cut(G.persons_graph(self.nodes, self.edges))
        return self._links


Rule = Callable[[Context], DataFrame]
RULES: dict[str, Rule] = {}


def rule(name: str):
    def add(function: Rule) -> Rule:
        RULES[name] = function
        return function

    return add


def _alerts(df: DataFrame, name: str, title: Column, detail: Column, entities: Column, confidence: Column, sources: Column, evidence: Column) -> DataFrame:
    """Rows in the form of alerts; the id follows from rule and entities, so feedback stays with its alert."""
    out = df.select(F.lit(name).alias("rule"), title.alias("title"), detail.alias("detail"), entities.cast("array<string>").alias("entities"), F.round(F.least(confidence, F.lit(0.97)), 3).alias("confidence"), sources.cast("array<string>").alias("source_ids"), evidence.cast("array<string>").alias("evidence"))
    return out.withColumn("alert_id", F.substring(F.sha2(F.concat_ws("|", "rule", "entities"), 256), 1, 16)).select(*ALERT)


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@rule("SERIAL_OFFENDER")
def serial(context: Context) -> DataFrame:
    """An accused person on reports of two or more stations."""
    found = context.resolved["masters"].filter((F.col("role") == "ACCUSED") & (F.size("stations") >= 2))
    n = F.size("stations")
    ids = [F.when(F.size(f"identifiers.{f}") > 0, _text(f"{f.replace('_no', '')} ", F.array_join(f"identifiers.{f}", ", "))) for f in ("phone", "imei", "vehicle", "account_no")]
    entities = F.concat(F.array("master_id"), F.transform("identifiers.phone", lambda p: F.concat(F.lit("PH:"), p)))
    evidence = F.array(_text("Names used: ", F.array_join("names", ", ")), _text("Stations: ", F.array_join("stations", ", ")), _text("Linked by: ", F.concat_ws("; ", *ids)))
    return _alerts(found, "SERIAL_OFFENDER", _text(F.col("canonical"), " active across ", n, " police stations"), _text(F.col("n_records"), " FIR records resolve to one person"), entities, 0.55 + 0.1 * n, F.col("firs"), evidence)


@rule("SHARED_DEVICE")
def shared_device(context: Context, least: int = 3) -> DataFrame:
    """A phone registered on ``least`` or more accounts; blank phones are no phone."""
    bank = context.tables["bank_txn"].filter("linked_phone IS NOT NULL")
    found = bank.groupBy("linked_phone").agg(F.array_sort(F.collect_set("account_no")).alias("accounts"), F.array_sort(F.collect_set("holder_name")).alias("holders")).filter(F.size("accounts") >= least)
    n = F.size("accounts")
    entities = F.concat(F.array(_text("PH:", F.col("linked_phone"))), F.transform("accounts", lambda a: F.concat(F.lit("ACCT:"), a)))
    return _alerts(found, "SHARED_DEVICE", _text("One phone controls ", n, " bank accounts"), _text("KYC phone ", F.col("linked_phone"), " is registered on accounts of different holders"), entities, 0.55 + 0.1 * (n - 2), F.col("accounts"), F.array(_text("Holders: ", F.array_join("holders", ", ")), F.lit("Classic mule-account pattern")))


@rule("CIRCULAR_FLOW")
def circular(context: Context, most: int = 5) -> DataFrame:
    """Transfers that come back to their origin over 3 to ``most`` accounts; their order in time isn't asked."""
    moved = context.edges.filter("etype = 'TRANSFERRED_TO'").select("src", "dst", "amount")
    found = G.cycles(moved, most).withColumn("key", F.xxhash64("cycle"))
    nxt = lambda i: F.element_at("cycle", F.when(i + 1 < F.size("cycle"), i + 2).otherwise(F.lit(1)))
    hops = found.select("key", F.posexplode("cycle").alias("place", "src"), "cycle").withColumn("dst", nxt(F.col("place")))
    label = context.nodes.select("id", "label")
    hops = hops.join(moved.groupBy("src", "dst").agg(F.max("amount").alias("amount")), ["src", "dst"])
    hops = hops.join(label.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(label.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    step = F.struct("place", _text(F.col("a"), " -> ", F.col("b"), ": Rs ", F.format_number("amount", 0)).alias("step"))
    steps = hops.groupBy("key", "cycle").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    n = F.size("cycle")
    return _alerts(steps, "CIRCULAR_FLOW", _text("Money loops through ", n, " accounts back to its origin"), F.lit("Layering pattern: funds return to the source after passing through intermediaries"), F.col("cycle"), 0.7 + 0.05 * n, F.transform("cycle", lambda c: F.substring_index(c, ":", -1)), F.col("steps.step"))


@rule("CALL_BURST")
def call_burst(context: Context, seconds: int = 3600, least: int = 6) -> DataFrame:
    """Callers, victims excepted, with ``least`` or more calls inside ``seconds``."""
    if "cdr" not in context.tables:
        return shared_device(context).filter("false")
    victims = context.tables["person"].filter("role = 'VICTIM' AND phone IS NOT NULL").select(F.col("phone").alias("caller")).distinct()
    calls = context.tables["cdr"].join(victims, "caller", "left_anti").withColumn("epoch", F.unix_timestamp(F.to_timestamp("ts")))
    inside = cut(W.islands(calls, "caller", "epoch", "id", seconds, least))
    found = inside.groupBy("caller", "burst").agg(F.min("epoch").alias("first"), F.max("epoch").alias("last"), F.count("*").alias("calls"), F.countDistinct("callee").alias("numbers"), F.array_sort(F.collect_list(F.struct("epoch", "id"))).alias("ids"))
    when = lambda c, pattern: F.date_format(F.timestamp_seconds(c), pattern)
    line = _text(when("first", "dd MMM HH:mm"), "-", when("last", "HH:mm"), ": ", F.col("calls"), " calls")
    lines = found.groupBy("caller").agg(F.array_sort(F.collect_list(F.struct("first", line.alias("line")))).alias("lines"))
    big = W.largest_burst(found, "caller").join(lines, "caller")
    return _alerts(big, "CALL_BURST", _text(F.col("bursts"), " call burst(s) from ", F.col("caller")), _text(F.col("calls"), " calls to ", F.col("numbers"), " numbers in under an hour"), F.array(_text("PH:", F.col("caller"))), 0.5 + 0.08 * F.col("bursts"), F.slice("ids.id", 1, 12), F.col("lines.line"))


@rule("BROKER")
def broker(context: Context, top: int = 5) -> DataFrame:
    """Key players whose contacts belong to more than one community."""
    found = G.key_players(context.nodes, context.links, top).filter(F.startswith("reason", F.lit("bridges")))
    score = F.col("betweenness")
    evidence = F.array(_text("Betweenness centrality ", F.format_string("%.3f", score)), _text(F.col("degree"), " direct associates"), F.col("reason"))
    return _alerts(found, "BROKER", _text(F.col("label"), " bridges separate criminal groups"), _text("Highest betweenness in the network (", F.format_string("%.2f", score), "); ", F.col("reason")), F.array("id"), 0.6 + score, F.array().cast("array<string>"), evidence)


def run_rules(context: Context, names: list[str] | None = None) -> DataFrame:
    """All alerts, the most confident first."""
    out = None
    for name in names or list(RULES):
        found = RULES[name](context)
        out = found if out is None else out.unionByName(found)
    return out.orderBy(F.desc("confidence"), "alert_id")

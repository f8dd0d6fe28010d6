"""A whole case from files to sealed alerts: ingest, extract, resolve, fuse, raise alerts, log.

    python -m tessera.plans.case CASE_FOLDER OUT_FOLDER

Everything but the ledger's few rows stays in DataFrames; each result is written once.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.spans import Recogniser, extract_spans
from tessera.operators import graph, ledger, lookup, resolution, rules
from tessera.sources import case_files, synthetic

ACTORS = ["system", "analyst"]


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="milliseconds")


@dataclass
class Case:
    tables: dict[str, DataFrame]
    extracted: DataFrame
    resolved: dict[str, DataFrame]
    nodes: DataFrame
    edges: DataFrame
    alerts: DataFrame


def ingest(spark: SparkSession, paths: list[str], book: ledger.Ledger) -> dict[str, DataFrame]:
    """Clean tables; each file's fingerprint goes into the ledger, all in one block."""
    tables = case_files.load(spark, paths)
    files = case_files.manifest(spark, paths).orderBy("file").collect()
    book.ensure_genesis(ACTORS)
    book.commit([("INGEST_FILE", f.asDict(), "system") for f in files])
    return tables


def process(tables: dict[str, DataFrame], book: ledger.Ledger | None = None, decisions: DataFrame | None = None, recognise: Recogniser | None = None) -> Case:
    """Every analysis of the tables; golden records and alerts are sealed in one block."""
    extracted = extract_spans(tables["fir"], tables["person"], recognise)
    resolved = resolution.resolve(tables["person"], tables["fir"], decisions)
    nodes, edges = graph.build(tables, resolved)
    alerts = rules.run_rules(rules.Context(tables, resolved, nodes, edges)).cache()
    if book is not None:
        stats = resolution.funnel(resolved).first().asDict()
        items = [("PIPELINE_RUN", stats, "system")]
        items += [("GOLDEN_RECORD", {"master_id": r["master_id"], "members": r["members"]}, "system") for r in resolved["masters"].select("master_id", "members").orderBy("master_id").toLocalIterator()]
        items += [("ALERT_RAISED", {"alert_id": r["alert_id"], "rule": r["rule"], "confidence": r["confidence"]}, "system") for r in alerts.select("alert_id", "rule", "confidence").toLocalIterator()]
        book.commit(items)
    return Case(tables, extracted, resolved, nodes, edges, alerts)


def review(case: Case, id_a: str, id_b: str, decision: str, actor: str, log: DataFrame | None, book: ledger.Ledger | None = None, clock: Callable[[], str] = _now) -> tuple[Case, DataFrame]:
    """A human decision on the entities of two records: logged, sealed, and everything derived anew."""
    new = resolution.decide(case.resolved["pairs"], case.resolved["members"], id_a, id_b, decision, actor, clock())
    log = new if log is None else log.unionByName(new)
    if book is not None:
        book.commit([("REVIEW_DECISION", {"id_a": id_a, "id_b": id_b, "decision": decision}, actor)])
    return process(case.tables, None, log), log


def export(case: Case, alert_id: str, book: ledger.Ledger) -> dict:
    """An alert with its source records and the proof that it was sealed; logged as exported."""
    alert = case.alerts.filter(F.col("alert_id") == alert_id)
    if alert.isEmpty():
        raise KeyError(alert_id)
    sources = [r.asDict() for r in lookup.alert_sources(alert, case.tables).orderBy("table", "row_id").collect()]
    sealed = book.entries().filter((F.col("node") == ledger.NODES[0]) & (F.col("action") == "ALERT_RAISED") & (F.get_json_object("payload", "$.data.alert_id") == alert_id)).orderBy("seq").first()
    bundle = {"alert": alert.first().asDict(recursive=True), "sources": sources, "proof": book.proof(sealed["seq"]) if sealed else None}
    digest = ledger.H._hex(ledger.canonical(bundle))
    done = book.commit([("EXPORT", {"alert_id": alert_id, "bundle_hash": digest}, "analyst")])
    return bundle | {"bundle_hash": digest, "anchor": book.proof(done["seqs"][0])}


def feedback(case: Case, alert_id: str, verdict: str, analyst: str, folder: str, book: ledger.Ledger, note: str = "", clock: Callable[[], str] = _now) -> DataFrame:
    """An analyst's verdict on an alert: stored below ``folder``, sealed, and returned with all before it."""
    row = lookup.feedback_row(case.alerts, alert_id, verdict, analyst, clock(), note)
    row.coalesce(1).write.mode("append").parquet(f"{folder}/feedback")
    book.commit([("ALERT_FEEDBACK", {"alert_id": alert_id, "verdict": verdict, "note": note}, analyst)])
    return row.sparkSession.read.schema(row.schema).parquet(f"{folder}/feedback")


def write(case: Case, folder: str) -> None:
    frames = {f"tables/{k}": v for k, v in case.tables.items()} | {"extracted": case.extracted, "nodes": case.nodes, "edges": case.edges, "alerts": case.alerts}
    frames |= {k: case.resolved[k] for k in ("pairs", "masters", "members", "review")}
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


DERIVED = ["tables", "extracted", "nodes", "edges", "alerts", "pairs", "masters", "members", "review", "feedback"]


def wipe(spark: SparkSession, folder: str, chain: bool = False) -> None:
    """Remove a case's tables and all that was derived from them; with ``chain`` its ledger and keys too."""
    for name in DERIVED + (["ledger", "keys"] if chain else []):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def main(argv: list[str]) -> None:
    from tessera.session import session

    options = argparse.ArgumentParser(prog="tessera.plans.case", description="A case from files to sealed alerts.")
    options.add_argument("source", help="folder with CSV files or archives of them, or 'synthetic'")
    options.add_argument("folder", help="folder for tables, results and the ledger")
    options.add_argument("--reset", action="store_true", help="remove the folder's tables and results first")
    options.add_argument("--fresh-chain", action="store_true", help="remove its ledger and keys as well")
    options.add_argument("--seed", type=int, default=7, help="of a synthetic case")
    asked = options.parse_args(argv)
    spark = session()
    if asked.reset or asked.fresh_chain:
        wipe(spark, asked.folder, asked.fresh_chain)
    book = ledger.Ledger(spark, f"{asked.folder}/ledger", ledger.Keys.stored(spark, f"{asked.folder}/keys", [*ledger.NODES, *ACTORS]), _now)
    truth = None
    if asked.source == "synthetic":
        tables, truth = synthetic.case(spark, asked.seed)
        book.ensure_genesis(ACTORS)
    else:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(asked.source)
        listing = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)
        tables = ingest(spark, [p for f in listing if (p := str(f.getPath())).lower().endswith((".csv", ".zip"))], book)
    case = process(tables, book)
    write(case, asked.folder)
    case.alerts.select("rule", "title", "confidence").show(50, truncate=False)
    if truth:
        resolution.check_truth(case.resolved["members"], truth["together"], truth["apart"]).show(50, truncate=False)


if __name__ == "__main__":
    main(sys.argv[1:])

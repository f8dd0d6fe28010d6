"""Case files: which table a file feeds, reading, cleaning, checking, and the manifest of what was read."""

from __future__ import annotations

import csv
import io
import itertools
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X

#: Text columns of each source table, in order; a mark after a name: ! required, # number, + whole number.
TABLES = {
    "fir": "id! station! date! section! narrative!",
    "person": "id! fir_id! name! alias father_name age role! address phone vehicle account_no imei notes",
    "cdr": "id! caller! callee! ts! duration_s+! tower_loc",
    "bank_txn": "id! account_no! holder_name! linked_phone txn_type! amount#! ts! counterpart",
    "vehicle_reg": "id! reg_no! owner_name! make model colour chassis_no",
}
#: What a file's name contains, in order of precedence, and its table.
ROUTES = [("fir", "fir"), ("person", "person"), ("cdr", "cdr"), ("bank", "bank_txn"), ("vehicle", "vehicle_reg")]
ROLES, TXN_TYPES = ["VICTIM", "WITNESS", "ACCUSED", "UNKNOWN"], ["CREDIT", "DEBIT", "TRANSFER"]
_PHONES = {"person": ["phone"], "cdr": ["caller", "callee"], "bank_txn": ["linked_phone"]}
_PLATES = {"person": ["vehicle"], "vehicle_reg": ["reg_no"]}


def columns(table: str) -> list[str]:
    return [c.rstrip("!#+") for c in TABLES[table].split()]


def route(path: str) -> str | None:
    """The table that a file feeds by its name, or None."""
    name = path.rsplit("/", 1)[-1].lower()
    return next((table for part, table in ROUTES if part in name), None)


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A file's columns by header, as text; missing ones are null.  Quoted cells may span lines."""
    raw = spark.read.options(header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8").csv(path)
    plain = {c.lstrip("﻿").strip(): c for c in raw.columns}
    return raw.select(*[(F.col(f"`{plain[c]}`") if c in plain else F.lit(None)).cast("string").alias(c) for c in columns(table)])


def _members(content: bytes):
    """Names and bytes of an archive's CSV files."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for name in archive.namelist():
            if name.lower().endswith(".csv"):
                yield name, archive.read(name)


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """Members of archives as rows: file, content.  An archive is opened by the task that reads it."""

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                yield pd.DataFrame(list(_members(content)), columns=["file", "content"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "file string, content binary")


def read_member(spark: SparkSession, path: str, member: str, table: str) -> DataFrame:
    """One file of an archive, like :func:`read_csv`; parsed by the task that opens the archive."""
    names = columns(table)

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                for name, body in _members(content):
                    if name == member:
                        lines = csv.DictReader(io.StringIO(body.decode("utf-8-sig"), newline=""))
                        lines.fieldnames = [(f or "").strip() for f in lines.fieldnames or []]
                        while rows := list(itertools.islice(lines, 10_000)):
                            yield pd.DataFrame([[r.get(c) for c in names] for r in rows], columns=names, dtype=object)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, ", ".join(f"`{c}` string" for c in names))


def sources(spark: SparkSession, paths: list[str]) -> list[tuple[str, str, str | None, str]]:
    """(file name, path, member or None, table) of all that feeds a table, archives opened, in order of name."""
    out = []
    for path in paths:
        if path.lower().endswith(".zip"):
            out += [(m["file"].rsplit("/", 1)[-1], path, m["file"], t) for m in read_zip(spark, path).select("file").collect() if (t := route(m["file"]))]
        elif table := route(path):
            out.append((path.rstrip("/").rsplit("/", 1)[-1], path, None, table))
    return sorted(out, key=lambda s: (s[0], s[1]))


def _read(spark: SparkSession, path: str, member: str | None, table: str) -> DataFrame:
    return read_csv(spark, path, table) if member is None else read_member(spark, path, member, table)


def manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, table, bytes, sha256 and rows of every file, in an archive or by itself, that feeds a table."""
    name = F.element_at(F.split("file", "/"), -1)
    plain, archives = [p for p in paths if not p.lower().endswith(".zip")], [p for p in paths if p.lower().endswith(".zip")]
    parts = [spark.read.format("binaryFile").load(plain).select(F.col("path").alias("file"), "content")] if plain else []
    parts += [read_zip(spark, p) for p in archives]
    files = parts[0]
    for p in parts[1:]:
        files = files.unionByName(p)
    table = F.coalesce(*[F.when(F.contains(F.lower(name), F.lit(part)), table) for part, table in ROUTES])
    listed = files.select(name.alias("file"), table.alias("table"), F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    counts = [(f, t, _read(spark, p, m, t).count()) for f, p, m, t in sources(spark, paths)]
    rows = spark.createDataFrame(counts, "file string, table string, rows long").groupBy("file", "table").agg(F.max("rows").alias("rows"))
    return listed.filter("table IS NOT NULL").join(rows, ["file", "table"])


def clean(df: DataFrame, table: str) -> DataFrame:
    """Trimmed text, blanks as null, phones and plates in one form, numbers as numbers (blank: 0)."""
    out = []
    for mark in TABLES[table].split():
        name = mark.rstrip("!#+")
        c = F.trim(F.col(name).cast("string"))
        if name in _PHONES.get(table, []):
            c = X.phone_digits(c)
        if name in _PLATES.get(table, []):
            c = X.plate(c)
        c = F.nullif(c, F.lit(""))
        if "#" in mark:
            c = F.coalesce(c.cast("double"), F.lit(0.0))
        elif "+" in mark:
            c = F.coalesce(c.cast("int"), F.lit(0))
        out.append(c.alias(name))
    return df.select(*out)


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """constraint and n, of those that rows break: keys, references, required and allowed values."""
    found = []

    def add(name: str, broken: DataFrame) -> None:
        found.append(broken.agg(F.count("*").alias("n")).select(F.lit(name).alias("constraint"), "n"))

    for table, df in tables.items():
        add(f"{table}.id unique", df.groupBy("id").count().filter("count > 1"))
        for mark in TABLES[table].split():
            if "!" in mark:
                add(f"{table}.{mark.rstrip('!#+')} required", df.filter(F.col(mark.rstrip("!#+")).isNull()))
    if "person" in tables:
        add("person.role allowed", tables["person"].filter(~F.col("role").isin(ROLES)))
        if "fir" in tables:
            add("person.fir_id known", tables["person"].join(tables["fir"].select(F.col("id").alias("fir_id")), "fir_id", "left_anti"))
    if "bank_txn" in tables:
        add("bank_txn.txn_type allowed", tables["bank_txn"].filter(~F.col("txn_type").isin(TXN_TYPES)))
    if "vehicle_reg" in tables:
        add("vehicle_reg.reg_no unique", tables["vehicle_reg"].groupBy("reg_no").count().filter("count > 1"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.filter("n > 0")


def load(spark: SparkSession, paths: list[str], check: bool = True) -> dict[str, DataFrame]:
    """Clean tables from files and archives; of two files for a table the last by name counts.  Breaches raise."""
    chosen = {table: (path, member) for _, path, member, table in sources(spark, paths)}
    if not chosen:
        raise ValueError("no file feeds a table")
    out = {table: clean(_read(spark, path, member, table), table) for table, (path, member) in chosen.items()}
    if check and (broken := violations(out).collect()):
        raise ValueError("; ".join(f"{r['constraint']}: {r['n']}" for r in broken))
    return out


def store(tables: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Full refresh: each table overwritten; rows per table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return {name: df.sparkSession.read.parquet(f"{folder}/{name}").count() for name, df in tables.items()}

"""Spans of identifiers and names in a text, with offsets in code points."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.functions.text import DEVANAGARI, identifiers, transliterate

SPAN = "array<struct<start:int,end:int,label:string,text:string,source:string>>"
_PATTERNS = [(re.compile(p), label) for p, label in ((V.PHONE, "PHONE"), (V.IMEI, "IMEI"), (V.VEHICLE, "VEHICLE"), (V.ACCOUNT, "ACCOUNT"))]
#: A recogniser gets a text and gives (start, end, label) triples; none is built in.
Recogniser = Callable[[str], list[tuple[int, int, str]]]


def _taken(found: list[dict], start: int, end: int) -> bool:
    return any(start < f["end"] and f["start"] < end for f in found)


def spans_of(text: str, names: list[str], recognise: Recogniser | None = None) -> list[dict]:
    """First come, first served: identifiers by priority, known names (longest first), then the recogniser's."""
    found: list[dict] = []

    def offer(start: int, end: int, label: str, source: str) -> None:
        if not _taken(found, start, end):
            found.append({"start": start, "end": end, "label": label, "text": text[start:end], "source": source})

    for pattern, label in _PATTERNS:
        for m in pattern.finditer(text):
            value = re.sub(r"[-\s]", "", m[1])
            plate_without_number = label == "VEHICLE" and not re.search(r"\d{3,}", value)
            other_kind = label == "ACCOUNT" and len(value) in (10, 15)
            if not plate_without_number and not other_kind:
                offer(*m.span(1), label, "regex")
    for name in sorted({n for n in names if n}, key=lambda n: (-len(n), n)):
        for m in re.finditer(re.escape(name), text):
            offer(*m.span(), "PERSON", "record")
    if recognise and not re.search(DEVANAGARI, text):
        for start, end, label in recognise(text):
            offer(start, end, label, "ner")
    return sorted(found, key=lambda f: f["start"])


#: The lists that a recogniser's labels feed.
NAMED = {"PERSON": "persons", "ORG": "orgs", "GPE": "locations", "LOC": "locations"}


def named_of(text: str, recognise: Recogniser | None) -> dict[str, list[str]]:
    """What a recogniser finds beside identifiers: persons, orgs and locations, each once, in order."""
    out: dict[str, list[str]] = {"persons": [], "orgs": [], "locations": []}
    taken = [{"start": m.start(), "end": m.end()} for p, _ in _PATTERNS for m in p.finditer(text)]
    for start, end, label in recognise(text) if recognise else []:
        value = text[start:end].strip()
        if label == "PERSON":
            value = re.sub(r"^[ ,.\-]+|[ ,.\-]+$", "", re.sub(r"\s{2,}", " ", re.sub(V.NOISE, " ", value)))
        held = out.get(NAMED.get(label, ""))
        if held is not None and value and value not in held and not _taken(taken, start, end):
            held.append(value)
    return out


def extract_entities(texts: DataFrame, column: str = "text", recognise: Recogniser | None = None) -> DataFrame:
    """``texts`` with ``entities``: seven lists, each value once.  Identifiers in the JVM, names by the recogniser."""

    @F.pandas_udf("struct<persons:array<string>,orgs:array<string>,locations:array<string>>")
    def named(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([named_of(t or "", recognise) for t in column], columns=["persons", "orgs", "locations"])

    empty = F.array().cast("array<string>")
    found = texts.withColumn("_i", identifiers(column))
    if recognise is None:
        found = found.withColumn("_n", F.struct(empty.alias("persons"), empty.alias("orgs"), empty.alias("locations")))
    else:
        found = found.withColumn("_n", named(column))
    entities = F.struct("_n.persons", "_i.phones", "_i.accounts", "_i.vehicles", "_i.imeis", "_n.orgs", "_n.locations")
    return found.withColumn("entities", entities).drop("_i", "_n")


def extract_spans(reports: DataFrame, persons: DataFrame, recognise: Recogniser | None = None) -> DataFrame:
    """fir_id, lang ('hi' or 'en'), spans and transliteration of every report's narrative."""

    @F.pandas_udf(SPAN)
    def spans(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([spans_of(t or "", list(n) if n is not None else [], recognise) for t, n in zip(texts, names)])

    names = persons.groupBy("fir_id").agg(F.collect_set("name").alias("names")).withColumnRenamed("fir_id", "id")
    hindi = F.coalesce(F.col("narrative").rlike(DEVANAGARI), F.lit(False))
    joined = reports.select("id", "narrative").join(names, "id", "left")
    return joined.select(
        F.col("id").alias("fir_id"),
        F.when(hindi, "hi").otherwise("en").alias("lang"),
        spans("narrative", F.coalesce("names", F.array().cast("array<string>"))).alias("spans"),
        F.when(hindi, transliterate("narrative")).alias("transliteration"),
    )

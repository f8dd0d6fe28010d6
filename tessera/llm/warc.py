"""Derived WARC records: for every response a linked metadata record and a plain-text conversion record.

A derivative names its response in WARC-Refers-To, keeps the response's target URI, date, and payload digest,
and has its own id and block digest.  Ids are name-based (from the response's id and the record type), so the same
response gives the same derivatives whenever and wherever a task runs.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tessera:warc")
#: WARC-Date of responses whose table has no date column.
UNDATED = "1970-01-01T00:00:00Z"

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.S | re.I)
_HEAD = re.compile(r"<head\b.*?</head\s*>", re.S | re.I)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>?")
_BLANK = re.compile(r"[ \t\r\f\v ]+")
_LINES = re.compile(r" ?\n[ \n]*")
_LINK = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_LANG = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z-]+)""", re.I)
_CHARSET = re.compile(r"""<meta\b[^>]*?charset\s*=\s*["']?([\w-]+)""", re.I)

RECORDS = "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_payload_digest string, source_headers string, block string"
_ARROW = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in RECORDS.split(", ")])


def sha1(body: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()


def plain_text(page: str) -> str:
    """The text a reader sees, one line a block; entities resolved, white space squeezed."""
    body = _DROP.sub(" ", page)
    body = _HEAD.sub("\n", body)
    body = _TAG.sub("", _BREAK.sub("\n", body.replace("\n", " ")))
    body = html.unescape(body).replace("\x00", "")
    return _LINES.sub("\n", _BLANK.sub(" ", body)).strip(" \n")


def describe(page: str) -> str:
    """The block of a metadata record: title, language, charset and out-links, as warc-fields."""
    head = _DROP.sub(" ", page)
    one_line = lambda s: _BLANK.sub(" ", html.unescape(_TAG.sub("", s)).replace("\n", " ")).strip()
    out = []
    for name, found in (("title", _TITLE.search(head)), ("language", _LANG.search(head)), ("charset", _CHARSET.search(head))):
        if found:
            out.append(f"{name}: {one_line(found[1])}\r\n")
    links = dict.fromkeys(one_line(next(filter(None, g), "")) for g in _LINK.findall(head))
    out += [f"outlink: {link}\r\n" for link in links if link]
    return "".join(out)


def response(url: str | None, page: str, page_id, date: str) -> tuple[str, str, str]:
    """Id, HTTP headers and payload digest of the response record that a raw page stands for."""
    body = page.encode("utf-8", "replace")
    digest = sha1(body)
    own = uuid.uuid5(NAMESPACE, f"response|{page_id}|{url}|{date}|{digest}")
    headers = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(body)}\r\n"
    return f"<urn:uuid:{own}>", headers, digest


def derive(page_id, url, page, date, record_id=None, headers=None, digest=None) -> list[tuple]:
    """The rows of a response's two derivatives."""
    page = page or ""
    date = date or UNDATED
    own, own_headers, own_digest = response(url, page, page_id, date)
    source, headers, digest = record_id or own, headers or own_headers, digest or own_digest
    out = []
    for kind, content, block in (("metadata", "application/warc-fields", describe(page)), ("conversion", "text/plain; charset=UTF-8", plain_text(page))):
        body = block.encode("utf-8", "replace")
        name = uuid.uuid5(NAMESPACE, f"{kind}|{source}")
        out.append((page_id, kind, f"<urn:uuid:{name}>", source, url, date, content, len(body), sha1(body), digest, headers, body.decode()))
    return out


def _derive(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            found = [row for values in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)) for row in derive(*values)]
            if found:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*found), _ARROW)], schema=_ARROW)


def derivatives(pages: DataFrame, source_columns: dict[str, str] | None = None) -> DataFrame:
    """Two rows for every response: its metadata and its conversion record.

    ``pages`` has page_id, url and html; ``source_columns`` may name columns with the responses' own
    date, record_id, headers and digest, which are then kept.  A null or empty page has empty blocks, a null url or
    id stays null, repeated rows have records of equal ids, an empty table gives no rows, other columns are ignored.
    """
    own = source_columns or {}
    kept = [F.col(own[c]).cast("string").alias(c) if c in own else F.lit(None).cast("string").alias(c) for c in ("date", "record_id", "headers", "digest")]
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", *kept).mapInArrow(_derive, RECORDS)


def _one_line(value):
    """A header's value: line ends percent-encoded and other control characters gone, so none can start a header of its own."""
    value = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.regexp_replace(value, r"[\x00-\x1F\x7F]", "")


def serialise(records: DataFrame) -> DataFrame:
    """Each record as WARC text without the two newlines that end it: column ``value``.

    Nulls are left out as headers and empty as blocks; control characters never reach a header; repeated records
    are written each; an empty table gives no rows; other columns are ignored.
    """
    line = lambda name, value: F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), _one_line(value), F.lit("\r\n")))
    return records.select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            line("WARC-Type", F.col("record_type")),
            line("WARC-Record-ID", F.col("record_id")),
            line("WARC-Refers-To", F.col("refers_to")),
            line("WARC-Target-URI", F.col("target_uri")),
            line("WARC-Date", F.col("warc_date")),
            line("WARC-Block-Digest", F.col("block_digest")),
            line("WARC-Source-Payload-Digest", F.col("source_payload_digest")),
            line("WARC-Source-HTTP-Headers", F.regexp_replace(F.rtrim(F.regexp_replace("source_headers", r"[\r\n]+$", "")), r"\r?\n", " | ")),
            line("Content-Type", F.col("content_type")),
            line("Content-Length", F.col("content_length").cast("string")),
            F.lit("\r\n"),
            F.coalesce("block", F.lit("")),
        ).alias("value")
    )


def write(records: DataFrame, path: str) -> None:
    """WARC files: a record ends with two newlines, which is what separates the sink's rows.

    What :func:`serialise` says of nulls, repeats and empty tables holds; a folder that is there is replaced.
    """
    serialise(records).write.mode("overwrite").option("lineSep", "\r\n\r\n").text(path)


def parse(body: bytes):
    """(headers, block) of every record of a file, gzipped as a whole or record by record, or not at all.

    Lengths alone say where a record ends; a file that isn't of whole records, each with its length, raises.
    """
    if body[:2] == b"\x1f\x8b":
        body = gzip.decompress(body)
    at = 0
    while True:
        while body[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(body):
            return
        end = body.find(b"\r\n\r\n", at)
        if end < 0 or body[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        lines = [line.split(":", 1) for line in body[at:end].decode("utf-8", "replace").split("\r\n")[1:] if ":" in line]
        headers = {name.strip(): value.strip() for name, value in lines}
        length = next((v for k, v in headers.items() if k.lower() == "content-length"), "")
        if not length.isdigit() or end + 4 + int(length) > len(body):
            raise ValueError(f"no whole record at byte {at}")
        at = end + 4 + int(length)
        yield headers, body[end + 4 : at]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, gzipped or not: headers (map) and block (binary).

    A file is one row of Spark's binary source, hence of less than 2 GB; a folder without files gives no rows, repeated
    records are rows each, and a broken file raises (see :func:`parse`).
    """

    def run(batches):
        for batch in batches:
            for body in batch.column("content"):
                found = list(parse(body.as_py()))
                if not found:
                    continue
                yield pa.record_batch([pa.array([list(h.items()) for h, _ in found], pa.map_(pa.string(), pa.string())), pa.array([b for _, b in found], pa.binary())], names=["headers", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "headers map<string,string>, block binary")


_RESPONSE = "page_id long, url string, html string, date string, record_id string, headers string, digest string"
_RESPONSES = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in _RESPONSE.split(", ")])


def _page(headers: dict[str, str], block: bytes) -> tuple:
    """A response record as a page with its own date, id, HTTP headers and payload digest."""
    named = {k.lower(): v for k, v in headers.items()}
    head, _, body = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    text = head.decode("iso-8859-1")
    stated = re.search(r"charset\s*=\s*\"?([\w-]+)", text, re.I) or _CHARSET.search(body[:65_536].decode("ascii", "replace"))
    try:
        page = body.decode(stated[1] if stated else "utf-8", "replace")
    except LookupError:  # a charset that nobody knows
        page = body.decode("utf-8", "replace")
    digest = named.get("warc-payload-digest") or sha1(body)
    return None, named.get("warc-target-uri"), page, named.get("warc-date"), named.get("warc-record-id"), text + "\r\n" if text else None, digest


def responses(records: DataFrame) -> DataFrame:
    """The response records of :func:`read` as pages, with the columns that :func:`derivatives` keeps.

    Other kinds of records are left out; a null block is an empty page; absent headers are null.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for headers, block in zip(batch.column("headers").to_pylist(), batch.column("block").to_pylist()):
                headers = dict(headers or [])
                if next((v for k, v in headers.items() if k.lower() == "warc-type"), "") == "response":
                    rows.append(_page(headers, block or b""))
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _RESPONSES)], schema=_RESPONSES)

    return records.mapInArrow(run, _RESPONSE)


def derive_files(spark: SparkSession, source: str, target: str) -> None:
    """Derivatives of all responses in WARC files, written as WARC files."""
    own = {c: c for c in ("date", "record_id", "headers", "digest")}
    write(derivatives(responses(read(spark, source)), own), target)

"""Shared plumbing: vectorised tokenising, compact binary payloads, and the block exchange.

The *block exchange* answers, for every distinct key of every block of documents, a question that
only the whole corpus can answer (a count, a piece count), without moving one row per key:

1. a block (some megabytes of documents) keeps a compact payload, hashed on its block id;
2. it sends one row per key range, holding its sorted distinct keys of that range;
3. a range merges the rows of all blocks and sends every block one row of answers back;
4. payload and answers meet again under the block id.

Each step is bounded by a block or by a key range, a hot key costs one entry per block, and lineage
covers the loss of any executor because block ids follow from content.
"""

from __future__ import annotations

import ctypes
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.components import cut, shared_dir  # noqa: F401

#: Text bytes worked on at a time; NumPy temporaries are some dozens of times that.
SLICE_BYTES = 1 << 20
#: Text bytes of a block.
BLOCK_BYTES = 14 << 20
U64 = np.uint64
_MULT, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_INVERSE = pow(_MULT, -1, 1 << 64)
_TABLE = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODEC = pa.Codec("zstd", compression_level=1)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give freed memory back to the system: workers live on after a task, and others need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """A batch function that releases memory at its end."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


# --- text ------------------------------------------------------------------------------------------


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (one more entry than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def byte_slices(batch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator:
    """Zero-copy pieces of a batch or table, each of ``limit`` text bytes or one longer text."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(np.asarray(lengths, dtype=np.int64))
    row = 0
    while row < len(ends):
        done = ends[row - 1] if row else 0
        to = max(row + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(row, to - row)
        row = to


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(_MIX1)
    x = (x ^ (x >> U64(27))) * U64(_MIX2)
    return x ^ (x >> U64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 4096)
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def prefix_hashes(body: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any range of bytes follows; see :func:`range_hashes`."""
    sums = np.zeros(len(body) + 1, U64)
    np.cumsum(_TABLE[body] * powers(_MULT, len(body)), out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``body[start:end]``, independent of where the bytes stand."""
    raw = (sums[end] - sums[start]) * powers(_INVERSE, len(sums))[start]
    return mix(raw + (end - start).astype(U64) * U64(_MIX2))


def words(body: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) and the number in each text."""
    if lower:
        body = _LOWER[body]
    inside = ~_SPACE[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[at] = True
    before = np.ones(len(body), bool)
    before[1:] = ~inside[:-1]
    start = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.ones(len(body), bool)
    after[:-1] = ~inside[1:]
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    found = range_hashes(prefix_hashes(body), start, end) if len(start) else np.zeros(0, U64)
    return found, np.diff(np.searchsorted(start, at))


def chain(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The hash of a sequence from the hash of all but its last item and that of the last."""
    return mix(first * U64(_MULT) + second)


# --- payloads --------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays as compressed byte planes (sorted integers are worth :func:`deltas` first)."""
    out = [struct.pack("<i", len(arrays))]
    for a in arrays:
        if isinstance(a, bytes):
            kind, raw, width = b"bytes   ", a, 1
        else:
            a = np.ascontiguousarray(a)
            kind, width = a.dtype.str.encode().ljust(8), a.dtype.itemsize
            raw = a.view(np.uint8).reshape(-1, width).T.tobytes() if width > 1 else a.tobytes()
        body = _CODEC.compress(raw, asbytes=True) if raw else b""
        out += [kind, struct.pack("<qq", len(raw), len(body)), body]
    return b"".join(out)


def unpack(blob: bytes) -> list:
    blob = memoryview(blob)
    (n,), at, out = struct.unpack("<i", blob[:4]), 4, []
    for _ in range(n):
        kind = bytes(blob[at : at + 8]).strip().decode()
        size, packed = struct.unpack("<qq", blob[at + 8 : at + 24])
        raw = _CODEC.decompress(bytes(blob[at + 24 : at + 24 + packed]), size, asbytes=True) if size else b""
        at += 24 + packed
        if kind == "bytes":
            out.append(raw)
        else:
            dtype = np.dtype(kind)
            planes = np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, -1)
            out.append(np.ascontiguousarray(planes.T).view(dtype).ravel())
    return out


def deltas(ordered: np.ndarray) -> np.ndarray:
    return np.diff(ordered, prepend=ordered.dtype.type(0))


def undeltas(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=steps.dtype)


def small(values: np.ndarray) -> np.ndarray:
    """Non-negative integers in the narrowest type that holds them."""
    most = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


# --- blocks ----------------------------------------------------------------------------------------


def block_key(ordinal: int, *parts: bytes) -> int:
    """A block's id: from its content and place, hence the same when its task runs again."""
    context = TaskContext.get()
    seed = f"{context.partitionId() if context else 0}/{ordinal}".encode()
    crc = zlib.crc32(seed)
    for p in parts:
        crc = zlib.crc32(p, crc)
    high = zlib.crc32(struct.pack("<I", crc) + seed + b"".join(p[:64] + p[-64:] for p in parts))
    return (high << 31 | crc >> 1) & ((1 << 63) - 1)


def ranges_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` equal ranges of the 64-bit space begins among sorted keys, and the end."""
    edges = np.array([(i << 64) // n for i in range(n)], dtype=U64)
    return np.append(np.searchsorted(keys, edges, side="left"), len(keys))


def rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema)], schema=schema)


def block_exchange(
    payloads: DataFrame,
    ask: Callable[[bytes, int], list[bytes]],
    answer: Callable[[list[bytes]], list[bytes]],
    finish: Callable[[bytes, list[bytes]], pa.Table],
    schema,
    arrow: pa.Schema,
) -> DataFrame:
    """Run the block exchange on ``payloads`` (block long, payload binary).

    ``ask(payload, n)`` gives one request for each of n key ranges; ``answer(requests)`` gives one
    reply for each request of a range; ``finish(payload, replies)`` gives the block's result rows.
    """
    n = partitions(payloads.sparkSession)
    held = payloads.repartition(n, "block")
    sent_schema = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("body", pa.binary())])
    back_schema = pa.schema([("block", pa.int64()), ("range", pa.int32()), ("body", pa.binary())])

    def send(batches):
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                bodies = ask(payload.as_buffer().to_pybytes(), n)
                yield rows(sent_schema, list(range(n)), [block] * n, bodies)

    def merge(key, table):
        table = table.sort_by("block")
        found = answer(table.column("body").to_pylist())
        release()
        return pa.table([table.column("block").cast(pa.int64()), table.column("range").cast(pa.int32()), pa.array(found, pa.binary())], schema=back_schema)

    def close(key, left, right):
        right = right.sort_by("range")
        replies, out = right.column("body").to_pylist(), []
        for payload in left.column("payload").to_pylist():
            out.append(finish(payload, replies))
            release()
        return pa.concat_tables(out).cast(arrow) if out else arrow.empty_table()

    sent = held.mapInArrow(tidy(send), "range int, block long, body binary").repartition(n, "range")
    back = sent.groupBy("range").applyInArrow(merge, "block long, range int, body binary")
    return held.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(close, schema)


def crc_of_id(column: str = "doc_id"):
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))

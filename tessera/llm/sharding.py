"""Sharding by histogram sort: splitters from exact byte counts, then one exchange.

Rows are keyed by the first 60 bits of their text's MD5, so equal texts share a key.  Rounds of probes cut each
unresolved key interval into 4,096 parts and count, in every partition, the exact bytes in each part; the
driver sees those counts only (at most 4,096 for each splitter) and keeps the part that holds the
wanted boundary, until a boundary is within tolerance or lies between two neighbouring keys.  Boundaries
stand between texts always, so a group of equal texts is never cut: the nearer of its two ends counts.
DataFrame operations only.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import blocks as B

#: Bits of the key that each round leaves open.
SHIFTS = (48, 36, 24, 12, 0)
#: Tolerated distance of a boundary from its target, in mean shard sizes.
TOLERANCE = 0.001
#: Rows numbered by one task.
ROWS_A_TASK = 250_000


def _probe(rows: DataFrame, level: int, prefixes: list[int]) -> dict[int, list[tuple[int, int]]]:
    """Bytes in each part of the open intervals, in key order; an interval is a prefix of the key."""
    whole = F.shiftright("text_key", SHIFTS[level - 1]) if level else F.lit(0).cast("long")
    inside = rows.select(whole.alias("whole"), F.shiftright("text_key", SHIFTS[level]).alias("part"), "size").filter(F.col("whole").isin(prefixes))
    out: dict[int, list[tuple[int, int]]] = {p: [] for p in prefixes}
    for r in inside.groupBy("whole", "part").agg(F.sum("size").alias("bytes")).collect():
        out[r["whole"]].append((r["part"], r["bytes"]))
    return {k: sorted(v) for k, v in out.items()}


def splitters(rows: DataFrame, shards: int, total: int, tolerance: float) -> list[int]:
    """The first key of each shard but the first, so that shards hold nearly equal bytes."""
    found = [0] * (shards - 1)
    # of each unresolved boundary: its interval and the bytes below that
    state = dict.fromkeys(range(shards - 1), (0, 0))
    for level, shift in enumerate(SHIFTS):
        if not state:
            break
        parts = _probe(rows, level, sorted({p for p, _ in state.values()}))
        for i, (prefix, below) in list(state.items()):
            target = total * (i + 1) / shards
            sums = [below]
            for _, size in parts[prefix]:
                sums.append(sums[-1] + size)
            at = max(1, bisect_left(sums, target))  # the boundary lies in the part before sums[at]
            key, low, high = parts[prefix][at - 1][0], target - sums[at - 1], sums[at] - target
            if min(low, high) <= tolerance * total / shards or not shift:
                found[i] = (key if low <= high else key + 1) << shift
                del state[i]
            else:
                state[i] = key, sums[at - 1]
    return found


def _shard(bounds: list[int]) -> Column:
    """How many splitters lie at or below a row's key."""
    out = F.lit(0)
    for bound in bounds:
        out = out + (F.col("text_key") >= bound).cast("int")
    return out


def shard(documents: DataFrame, shards: int = 40, tolerance: float = TOLERANCE, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """Put rows into shards of nearly equal bytes (text bytes plus 16 a row) and number each shard's rows.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in a shard) and
    grown_shard (null: this law has none).  Equal texts share a shard, whatever their number: a group larger than a
    shard's share leaves neighbours small or empty, as a large row does.  A null text has no bytes and goes
    with the empty ones, a null id is a value like any other, repeated rows are separate rows in any order, an
    empty table gives no rows, and other columns are ignored.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = B.cut(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").alias("text_key"),
        )
    )
    n_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    bounds = splitters(rows, shards, total, tolerance) if n_rows else []
    dealt = rows.withColumn("shard", _shard(bounds).cast("int"))
    lots = max(1, -(-n_rows // (shards * rows_a_task)))
    dealt = dealt.withColumn("lot", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(lots)).cast("int"))
    place = F.row_number().over(Window.partitionBy("shard", "lot").orderBy("text_key", "doc_id")).cast("long") - 1
    numbered = dealt.withColumn("place", place)
    if lots > 1:
        before = Window.partitionBy("shard").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
        offsets = dealt.groupBy("shard", "lot").agg(F.count("*").alias("n"))
        offsets = offsets.select("shard", "lot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        numbered = numbered.join(offsets, ["shard", "lot"]).withColumn("place", F.col("place") + F.col("offset"))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

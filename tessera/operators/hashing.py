"""Hash chains and Merkle trees over DataFrames."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GENESIS = "0" * 64


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def build_chains(rows: DataFrame, key: str, order: str, payload: str, start: str = GENESIS) -> DataFrame:
    """key, ord (from 1), payload, prev and hash: hash = sha256(prev + payload), a fold along each key's rows.

    The fold is sequential within a chain by nature: rows are dealt by key and sorted, and one pass over each
    partition carries a head from batch to batch, so memory is that of a batch however long a chain is.
    """
    spark = rows.sparkSession
    lined = rows.select(F.col(key).alias("key"), F.col(order).alias("order"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    kind = lined.schema["key"].dataType.simpleString()

    def run(batches):
        last, head, place = None, start, 0
        for batch in batches:
            keys, payloads = batch.column("key").to_pylist(), batch.column("payload").to_pylist()
            ords, prevs, hashes = [], [], []
            for at, text in zip(keys, payloads):
                if place == 0 or at != last:
                    last, head, place = at, start, 0
                place += 1
                ords.append(place)
                prevs.append(head)
                head = hashlib.sha256((head + text).encode()).hexdigest()
                hashes.append(head)
            yield pa.record_batch([batch.column("key"), pa.array(ords, pa.int64()), batch.column("payload"), pa.array(prevs, pa.string()), pa.array(hashes, pa.string())], names=["key", "ord", "payload", "prev", "hash"])

    dealt = lined.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", "order", "payload")
    return dealt.mapInArrow(run, f"key {kind}, ord long, payload string, prev string, hash string").withColumnRenamed("key", key)


def audit_chains(chains: DataFrame, key: str, start: str = GENESIS) -> DataFrame:
    """key, ord and the first thing wrong with each bad entry: 'sequence', 'link' or 'hash'.  Entirely parallel."""
    by = Window.partitionBy(key).orderBy("ord")
    before = F.coalesce(F.lag("hash").over(by), F.lit(start))
    place = F.row_number().over(by)
    wrong = F.when(F.col("ord") != place, "sequence").when(F.col("prev") != before, "link").when(F.col("hash") != sha256(F.concat("prev", "payload")), "hash")
    return chains.withColumn("wrong", wrong).filter("wrong IS NOT NULL").select(key, "ord", "wrong")


def merkle_levels(leaves: DataFrame, key: str, index: str, leaf: str) -> list[DataFrame]:
    """Levels from the leaves to the roots: key, idx (from 0), hash.  An odd node pairs with itself."""
    by = Window.partitionBy(key).orderBy(index)
    level = leaves.select(key, (F.row_number().over(by) - 1).cast("long").alias("idx"), F.col(leaf).alias("hash"))
    out, most = [level], leaves.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        pair = level.groupBy(key, F.expr("idx div 2").alias("idx")).agg(F.min_by("hash", "idx").alias("a"), F.max_by("hash", "idx").alias("b"))
        level = pair.select(key, "idx", sha256(F.concat("a", "b")).alias("hash"))
        out.append(level)
        most = -(-most // 2)
    return out


def merkle_roots(leaves: DataFrame, key: str, index: str, leaf: str) -> DataFrame:
    """key and root.  Levels of all keys fold together; a key that is down to one node stays."""
    by = Window.partitionBy(key).orderBy(index)
    level = leaves.select(key, (F.row_number().over(by) - 1).cast("long").alias("idx"), F.col(leaf).alias("hash"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    most = leaves.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        pair = level.groupBy(key, F.expr("idx div 2").alias("idx"), "n").agg(F.min_by("hash", "idx").alias("a"), F.max_by("hash", "idx").alias("b"))
        level = pair.select(key, "idx", F.when(F.col("n") > 1, sha256(F.concat("a", "b"))).otherwise(F.col("a")).alias("hash"), F.expr("(n + 1) div 2").alias("n"))
        most = -(-most // 2)
    return level.select(key, F.col("hash").alias("root"))


def fold_proof(leaf: Column, steps: Column) -> Column:
    """The root that a proof (array of struct side, hash) leads to from a leaf."""
    return F.aggregate(steps, leaf, lambda h, s: F.when(s["side"] == "left", sha256(F.concat(s["hash"], h))).otherwise(sha256(F.concat(h, s["hash"]))))


def root_of(hashes: list[str]) -> str:
    """The Merkle root of one block's few hashes, on the driver."""
    return (levels_of(hashes)[-1] or [_hex("")])[0]


def levels_of(hashes: list[str]) -> list[list[str]]:
    out = [list(hashes)]
    while len(out[-1]) > 1:
        row = out[-1]
        out.append([_hex(row[i] + row[min(i + 1, len(row) - 1)]) for i in range(0, len(row), 2)])
    return out


def proof_of(hashes: list[str], index: int) -> list[dict[str, str]]:
    out = []
    for row in levels_of(hashes)[:-1]:
        other = index ^ 1
        out.append({"side": "left" if index & 1 else "right", "hash": row[other] if other < len(row) else row[index]})
        index //= 2
    return out


def check_proof(leaf: str, steps: list[dict[str, str]], root: str) -> bool:
    for s in steps:
        leaf = _hex(s["hash"] + leaf) if s["side"] == "left" else _hex(leaf + s["hash"])
    return leaf == root


def _hex(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()

"""Bursts: events inside dense time windows, joined to islands.

An event is hot if some window of ``seconds`` (both ends included) that holds it has at least ``least`` events of its
key.  Windows run over stretches of time of each key, each with a margin of its neighbours' events, so a key with a
third of all events is still dealt to many tasks.  Events without a time are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Length of a stretch, in windows: the margins add about 3 / STRETCH to the rows.
STRETCH = 64


def _stretches(events: DataFrame, epoch: str, seconds: int, length: int) -> DataFrame:
    """Events with the stretch they belong to (``_own``), once for each stretch (``_in``) that needs them.

    A stretch needs what happened two windows before it (one for counts, one for the event before) and one after.
    """
    at = lambda shift: F.floor((F.col(epoch) + shift) / length)
    return events.withColumn("_own", at(0)).withColumn("_in", F.explode(F.sequence(at(-seconds), at(2 * seconds))))


def _hot(events: DataFrame, key: str, epoch: str, seconds: int, least: int, length: int) -> DataFrame:
    back = Window.partitionBy(key, "_in").orderBy(epoch).rangeBetween(-seconds, Window.currentRow)
    ahead = Window.partitionBy(key, "_in").orderBy(epoch).rangeBetween(Window.currentRow, seconds)
    counted = _stretches(events, epoch, seconds, length).withColumn("n", F.count("*").over(back))
    return counted.withColumn("hot", F.max("n").over(ahead) >= least)


def hot_events(events: DataFrame, key: str, epoch: str, seconds: int, least: int, stretch: int = STRETCH) -> DataFrame:
    """Events with ``n`` (events in the window that ends here) and ``hot``."""
    return _hot(events, key, epoch, seconds, least, stretch * seconds).filter(F.col("_own") == F.col("_in")).drop("_own", "_in")


def islands(events: DataFrame, key: str, epoch: str, order: str, seconds: int, least: int, stretch: int = STRETCH) -> DataFrame:
    """Hot events with the number of their burst: a new one after a cool event or a longer gap."""
    by = Window.partitionBy(key, "_in").orderBy(epoch, order)
    hot = _hot(events, key, epoch, seconds, least, stretch * seconds)
    # the event before, if it is near enough to matter, is in the margin
    starts = ~F.lag("hot", 1, False).over(by) | (F.col(epoch) - F.lag(epoch).over(by) > seconds)
    own = hot.withColumn("_start", F.coalesce(starts, F.lit(True)).cast("int")).filter(F.col("_own") == F.col("_in"))
    local = Window.partitionBy(key, "_own").orderBy(epoch, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # bursts begun in earlier stretches: one row a stretch
    before = Window.partitionBy(key).orderBy("_own").rowsBetween(Window.unboundedPreceding, -1)
    begun = own.groupBy(key, "_own").agg(F.sum("_start").alias("_n")).select(key, "_own", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = own.withColumn("_local", F.sum("_start").over(local)).filter("hot").join(begun, [key, "_own"])
    return numbered.withColumn("burst", F.col("_local") + F.col("_before")).drop("_own", "_in", "_start", "_local", "_before")


def bursts(events: DataFrame, key: str, epoch: str, order: str, seconds: int, least: int, stretch: int = STRETCH) -> DataFrame:
    """key, burst, first, last, calls."""
    found = islands(events, key, epoch, order, seconds, least, stretch)
    return found.groupBy(key, "burst").agg(F.min(epoch).alias("first"), F.max(epoch).alias("last"), F.count("*").alias("calls"))


def largest_burst(found: DataFrame, key: str) -> DataFrame:
    """Each key's burst of most events, the earliest on ties, and how many bursts it has."""
    by = Window.partitionBy(key).orderBy(F.desc("calls"), "first")
    return found.withColumn("place", F.row_number().over(by)).withColumn("bursts", F.count("*").over(Window.partitionBy(key))).filter("place = 1").drop("place")

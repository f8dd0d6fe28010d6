"""Connected components by alternating large-star and small-star steps.

Each step only rewires edges towards smaller neighbours, so edges never grow beyond their first number, a hub
costs one minimum a neighbour, and a path of n nodes needs O(log n) rounds.  Every round is written to the
shared folder: lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; on one machine, a session without one (a test) gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tessera-')}")
        folder = spark.sparkContext.getCheckpointDir()
    return folder


_cleaned: set[str] = set()


def _tables(spark: SparkSession) -> str:
    """This application's folder for tables, removed when Python ends."""
    folder = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"
    if folder not in _cleaned:
        _cleaned.add(folder)

        def remove() -> None:
            try:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            except Exception:  # noqa: BLE001, S110  the session is gone: nothing more can be done here
                pass

        atexit.register(remove)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{_tables(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Forest:
    """Union-find over any hashable nodes; a root is the smallest node of its set."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        parent, top = self.parent, x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        return True


#: Edges a task contracts at a time, and that one task may finish.
CONTRACT, FINISH = 200_000, 400_000


def contract(batches):
    """Edges of each stretch of a partition as stars around their smallest nodes."""

    def stars(us, vs):
        forest = Forest()
        for u, v in zip(us, vs):
            forest.join(u, v)
        pairs = [(x, forest.root(x)) for x in list(forest.parent)]
        return pa.record_batch([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])

    us, vs = [], []
    for batch in batches:
        us += batch.column(0).to_pylist()
        vs += batch.column(1).to_pylist()
        if len(us) >= CONTRACT:
            yield stars(us, vs)
            us, vs = [], []
    if us:
        yield stars(us, vs)


def _finish(batches):
    """Every node with its component, from all edges; for a bounded number of them."""
    forest = Forest()
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(u, v)
    nodes = list(forest.parent)
    roots = [forest.root(x) for x in nodes]
    every = {*roots} - {*nodes}
    nodes, roots = nodes + sorted(every), roots + sorted(every)
    for at in range(0, len(nodes), 50_000):
        yield pa.record_batch([pa.array(nodes[at : at + 50_000], pa.int64()), pa.array(roots[at : at + 50_000], pa.int64())], names=["node", "component"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, contracted: bool = False, finish: int = FINISH) -> DataFrame:
    """Columns ``u`` and ``v`` (long) in; ``node`` and ``component`` (its smallest node) out.

    Loops and edges with a null end are left out, repeated edges count once, and nodes without an edge to
    another node don't appear.  ``contracted`` says that :func:`contract` has been over the edges.  Once no more than
    ``finish`` edges are left, one task's union-find ends the rounds early; the result is the same.
    """
    now = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    now = now.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now, before = cut((now if contracted else now.mapInArrow(contract, "u long, v long")).distinct()), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] <= finish:
            return cut(now.coalesce(1).mapInArrow(_finish, "node long, component long"))
        if state == before:
            break
        before = state
        now = cut(_small_star(_large_star(now)))
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def string_components(edges: DataFrame) -> DataFrame:
    """:func:`connected_components` for string nodes; a component is its smallest node.

    Nodes are numbered in their own order (sorted over all partitions), so the smallest number is the smallest string.
    """
    names = edges.select(F.col("u").alias("name")).unionByName(edges.select(F.col("v").alias("name"))).filter("name IS NOT NULL").distinct()
    names = cut(names.orderBy("name").select("name", F.monotonically_increasing_id().alias("n")))
    of = lambda c: names.select(F.col("name").alias(c), F.col("n").alias(f"n_{c}"))
    coded = edges.join(of("u"), "u").join(of("v"), "v").select(F.col("n_u").alias("u"), F.col("n_v").alias("v"))
    found = connected_components(coded)
    named = lambda c, n: names.select(F.col("name").alias(c), F.col("n").alias(n))
    return found.join(named("node_name", "node"), "node").join(named("component_name", "component"), "component").select(F.col("node_name").alias("node"), F.col("component_name").alias("component"))


def spanning(n: int, linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of the graph whose boolean adjacency matrix is ``linked``."""
    left, out = np.ones(n, bool), []
    for start in range(n):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            at = queue.pop()
            for found in np.flatnonzero(linked[at] & left).tolist():
                left[found] = False
                out.append((at, found))
                queue.append(found)
    return out

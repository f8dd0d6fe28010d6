"""Exact top-k inner-product search with two cover trees, of queries and of all rows.

The top level is shared: centres picked farthest-first from a bounded sample, of which any first few are a coarser
cover.  Every row goes to the cell of its nearest centre, a cell's rows to blocks, and each block
gets a cover tree, once (a node has a centre, a covering radius, and children whose centres are separated).
Nodes, be they blocks or parts of them, meet in pairs, and a pair is pruned when

    q . x  <=  cq . cr + |cq| Rr + |cr| Rq + Rq Rr

is below the worst k-th best score of the query node's group.  Those scores start from the block of rows whose centre
fits a query block best; then only block pairs that the bound leaves are fetched and their trees walked.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import blocks as B

ROWS_A_BLOCK, QUERIES_A_BLOCK, LEAF, MOST_CHILDREN = 2048, 256, 48, 24
#: Rows that centres are picked from (those of the smallest hashes), and centres at most.
SAMPLE, CENTERS = 4096, 1024
#: Blocks whose centres and radii one row holds when blocks are paired.
SUMMARIES = 1024
_BIG = float(1 << 52)


class Node:
    __slots__ = ("center", "norm", "radius", "rows", "children")

    def __init__(self, center, norm, radius, rows, children):
        self.center, self.norm, self.radius, self.rows, self.children = center, norm, radius, rows, children


def _gaps(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    away = points - center
    return np.sqrt(np.einsum("ij,ij->i", away, away))


def farthest_first(points: np.ndarray, first: int, most: int, reach: float) -> tuple[list[int], list[np.ndarray]]:
    """Up to ``most`` rows, each the farthest from those before, until all are within ``reach``; and all distances to each."""
    centers, gaps = [first], [_gaps(points, points[first])]
    near = gaps[0]
    while len(centers) < most and near.max() > reach:
        centers.append(int(near.argmax()))
        gaps.append(_gaps(points, points[centers[-1]]))
        near = np.minimum(near, gaps[-1])
    return centers, gaps


def cover_tree(points: np.ndarray) -> Node:
    """A cover tree over the rows of ``points``; a level's separation shrinks with its covering radius."""

    def build(rows: np.ndarray, center: int) -> Node:
        own = points[rows]
        radius = float(_gaps(own, points[center]).max())
        children: list[Node] = []
        if len(rows) > LEAF // 4 and radius > 0:
            # few rows are worth children only if those are tight
            reach, enough = (radius / 2, 0.95 * radius) if len(rows) > LEAF else (radius / 8, radius / 4)
            centers, gaps = farthest_first(own, int(np.flatnonzero(rows == center)[0]), min(MOST_CHILDREN, len(rows) // 4), reach)
            to = np.argmin(gaps, axis=0)
            if np.min(gaps, axis=0).max() < enough:
                children = [build(rows[to == k], int(rows[c])) for k, c in enumerate(centers) if (to == k).any()]
        norm = float(np.sqrt(points[center] @ points[center]))
        return Node(points[center], norm, radius * (1 + 1e-9) + 1e-6, rows, children if len(children) > 1 else [])

    return build(np.arange(len(points)), int(_gaps(points, points.mean(axis=0)).argmin()))


def flatten(tree: Node) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows in the order of the leaves; and each node's number of rows, radius, and number of children, parents first."""
    order, size, radius, fan = [], [], [], []

    def visit(node: Node) -> None:
        size.append(len(node.rows))
        radius.append(node.radius)
        fan.append(len(node.children))
        for child in node.children:
            visit(child)
        if not node.children:
            order.append(node.rows)

    visit(tree)
    return np.concatenate(order), np.array(size), np.array(radius), np.array(fan)


def _restore(points: np.ndarray, centers: np.ndarray, size, radius, fan) -> Node:
    at = 0

    def visit(start: int) -> Node:
        nonlocal at
        k, at = at, at + 1
        children, begin = [], start
        for _ in range(int(fan[k])):
            children.append(visit(begin))
            begin += len(children[-1].rows)
        center = points[centers[k]]
        return Node(center, float(np.sqrt(center @ center)), float(radius[k]), np.arange(start, start + int(size[k])), children)

    return visit(0)


def _centers_of(tree: Node, points: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The place, in leaf order, of each node's centre, parents first."""
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    out = []

    def visit(node: Node) -> None:
        equal = (points[node.rows] == node.center).all(axis=1)
        out.append(int(place[node.rows[equal.argmax()]]))
        for child in node.children:
            visit(child)

    visit(tree)
    return np.array(out, np.int64)


class Best:
    """The k best of each query so far: score descending, then id ascending; ``floor`` is what they are known to reach."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        self.floor = np.full(queries, -np.inf) if floor is None else floor

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.concatenate([self.score[rows], scores], axis=1)
        ids = np.concatenate([self.id[rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
        order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(scores, order, 1)
        self.id[rows] = np.take_along_axis(ids, order, 1)

    def worst(self, rows: np.ndarray) -> float:
        return float(np.maximum(self.score[rows, -1], self.floor[rows]).min())


def dual_search(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, trees=None, floor=None) -> Best:
    """For each query its k best points of another id; exact for integer values whose products float64 holds."""
    best = Best(len(queries), k, floor)

    def bound(q: Node, x: Node) -> float:
        return float(q.center @ x.center) + q.norm * x.radius + x.norm * q.radius + q.radius * x.radius + 1e-3

    def walk(q: Node, x: Node, most: float) -> None:
        if most < best.worst(q.rows):
            return
        if not q.children and not x.children:
            scores = queries[q.rows] @ points[x.rows].T
            scores[query_ids[q.rows][:, None] == ids[x.rows][None, :]] = -np.inf
            best.add(q.rows, scores, ids[x.rows])
            return
        split = q if q.children and (not x.children or q.radius > x.radius) else x
        pairs = [(c, x) if split is q else (q, c) for c in split.children]
        for most, a, b in sorted(((bound(a, b), a, b) for a, b in pairs), key=lambda p: -p[0]):
            walk(a, b, most)

    tree_q, tree_x = trees or (cover_tree(queries), cover_tree(points))
    walk(tree_q, tree_x, math.inf)
    return best


def _search_exact(queries, query_ids, points, ids, k) -> Best:
    """For components too large for exact float64 products: whole numbers, all pairs of the two blocks."""
    best = Best(len(queries), k)
    best.score = np.full((len(queries), k), -(1 << 63), object)
    q = [[int(v) for v in row] for row in queries]
    for at in range(0, len(points), 256):
        part = [[int(v) for v in row] for row in points[at : at + 256]]
        some = ids[at : at + 256]
        for i, row in enumerate(q):
            found = [(-s, j) for s, j in zip(best.score[i], best.id[i]) if s > -(1 << 63)]
            found += [(-max(min(sum(a * b for a, b in zip(row, p)), (1 << 63) - 1), 1 - (1 << 63)), int(j)) for p, j in zip(part, some) if j != query_ids[i]]
            for c, (s, j) in enumerate(sorted(found)[:k]):
                best.score[i, c], best.id[i, c] = -s, j
    return best


# --- cells and blocks ------------------------------------------------------------------------------


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(len(column), dim)


def centers_of(sample: list[list[float]]) -> dict[int, np.ndarray]:
    """By number of components, centres in farthest-first order."""
    out = {}
    for dim, rows in groupby(sorted((r for r in sample if r), key=len), key=len):
        points = np.unique(np.array(list(rows), np.float64), axis=0)
        out[dim] = points[farthest_first(points, 0, min(CENTERS, len(points)), 0.0)[0]]
    return out


class Cells:
    """The first ``many`` centres of each number of components, and how many blocks a cell is dealt to.

    The sample tells about how many of all ``rows`` rows a cell holds; blocks are to have ``size`` of them.
    """

    def __init__(self, centers: dict[int, np.ndarray], sample: list[list[float]], rows: int, size: int):
        many = max(1, min(CENTERS, -(-rows // size)))
        self.centers, self.lots = {d: c[:many] for d, c in centers.items()}, {}
        by_dim = {d: np.array([v for v in sample if len(v) == d], np.float64) for d in centers}
        for dim, points in by_dim.items():
            held = np.bincount(self.nearest(points, dim), minlength=len(self.centers[dim]))
            self.lots[dim] = np.maximum(1, np.ceil(held * rows / (len(sample) * size))).astype(np.int64)

    def nearest(self, points: np.ndarray, dim: int) -> np.ndarray:
        some = self.centers[dim]
        return ((some * some).sum(axis=1)[None, :] - 2.0 * (points @ some.T)).argmin(axis=1)

    def blocks(self, ids: np.ndarray, points: np.ndarray, dim: int) -> np.ndarray:
        """Each vector's block: its cell, and its lot there by the hash of its id."""
        mixed = B.mix(ids.astype(np.uint64) + np.uint64(dim))
        if dim not in self.centers:
            return np.zeros(len(ids), np.int64)
        cell = self.nearest(points, dim)
        return cell << 32 | (mixed % self.lots[dim][cell].astype(np.uint64)).astype(np.int64)


def _placed(points: Cells, queries: Cells):
    """Each row with its block of rows, and once more with its block of queries if it is one."""
    schema = pa.schema([("asked", pa.bool_()), ("block", pa.int64()), ("dim", pa.int32()), ("vec_id", pa.int64()), ("v", pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            dims, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "vec_id"))
            asks = np.asarray(batch.column("asked").to_numpy(zero_copy_only=False), bool)
            for dim in np.unique(dims):
                for asked, cells in ((False, points), (True, queries)):
                    at = np.flatnonzero((dims == dim) & asks) if asked else np.flatnonzero(dims == dim)
                    some = batch.take(pa.array(at))
                    block = cells.blocks(ids[at], _matrix(some.column("v"), int(dim)), int(dim))
                    yield pa.record_batch([pa.array([asked] * len(at), pa.bool_()), pa.array(block), some.column("dim"), some.column("vec_id"), some.column("v").cast(schema.field("v").type)], schema=schema)

    return run


BLOCK = "asked boolean, block long, dim int, n int, exact boolean, center binary, radius double, payload binary"
_BLOCK = pa.schema([("asked", pa.bool_()), ("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("exact", pa.bool_()), ("center", pa.binary()), ("radius", pa.float64()), ("payload", pa.binary())])


def _build(key, table):
    """One block's tree, centre and radius."""
    table = table.sort_by("vec_id")
    dim = key[2].as_py()
    ids, points = table.column("vec_id").to_numpy(), _matrix(table.column("v"), dim)
    most = float(np.abs(points).max(initial=0))
    exact = most * most * max(1, dim) < _BIG
    tree = cover_tree(points) if exact else Node(points[0], 0.0, 0.0, np.arange(len(points)), [])
    order, size, radius, fan = flatten(tree)
    payload = B.pack(ids[order], points[order].ravel(), _centers_of(tree, points, order), size, radius, fan)
    columns = [[key[0].as_py()], [key[1].as_py()], [dim], [len(ids)], [exact], [tree.center.tobytes()], [tree.radius], [payload]]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _BLOCK)], schema=_BLOCK)


def _open(payload, dim: int) -> tuple[np.ndarray, np.ndarray, tuple]:
    ids, flat, *tree = B.unpack(payload.as_buffer().to_pybytes())
    return ids, flat.reshape(len(ids), dim), tuple(tree)


# --- pairs of blocks -------------------------------------------------------------------------------


def _summaries(blocks: DataFrame, lots: int, *more: str) -> DataFrame:
    """Centres and radii of some hundred blocks in a row: dim, payload."""

    def run(key, table):
        columns = [table.column(c).to_numpy() for c in ("block", "n", "radius", "exact", *more)]
        payload = B.pack(b"".join(table.column("center").to_pylist()), *columns)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([payload], pa.binary())], names=["dim", "payload"])

    some = blocks.select("dim", "block", "n", "radius", "exact", "center", *more)
    return some.groupBy("dim", F.pmod(F.xxhash64("block"), F.lit(lots)).alias("lot")).applyInArrow(run, "dim int, payload binary")


def _meet(queries: DataFrame, rows: DataFrame, run, schema: str) -> DataFrame:
    """Every row of summaries of query blocks with every one of blocks of rows."""
    salts = B.partitions(rows.sparkSession)
    queries = queries.withColumnRenamed("payload", "query_payload").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("payload"), F.lit(salts)).cast("int"))
    return rows.join(queries, ["dim", "salt"]).select("dim", "query_payload", "payload").mapInArrow(run, schema)


def _bounds(dim: int, mine: bytes, theirs: bytes):
    """Both sides' columns, the products of centres, and the bounds; whatever is too large for them is never pruned."""
    (c, q, _, r, fine, *more), (d, x, n, s, well, *_) = B.unpack(mine), B.unpack(theirs)
    c, d = (np.frombuffer(bytearray(side)).reshape(n, dim) for side, n in ((c, len(q)), (d, len(x))))
    products = c @ d.T
    bound = products + np.sqrt((c * c).sum(1))[:, None] * s[None, :] + np.sqrt((d * d).sum(1))[None, :] * r[:, None] + r[:, None] * s[None, :] + 1e-3
    bound[~(fine[:, None].astype(bool) & well[None, :].astype(bool))] = np.inf
    return q, x, n, more, products, bound


def _best_fit(k: int):
    """Each query block's block of rows with the largest product of centres, among those with more than k rows if any."""

    def run(batches):
        for batch in batches:
            for dim, mine, theirs in zip(*(batch.column(c) for c in ("dim", "query_payload", "payload"))):
                q, x, n, _, products, _ = _bounds(dim.as_py(), mine.as_buffer().to_pybytes(), theirs.as_buffer().to_pybytes())
                at = np.lexsort((np.broadcast_to(-x, products.shape), products, np.broadcast_to(n > k, products.shape)), axis=1)[:, -1]
                yield pa.record_batch([pa.array(q), pa.array(x[at]), pa.array(n[at] > k), pa.array(products[np.arange(len(q)), at])], names=["q", "x", "full", "fit"]).add_column(0, "dim", pa.array([dim.as_py()] * len(q), pa.int32()))

    return run


def _left(batches):
    """Pairs that the bound leaves: those that may reach the query block's worst k-th score, but for the first pair."""
    for batch in batches:
        for dim, mine, theirs in zip(*(batch.column(c) for c in ("dim", "query_payload", "payload"))):
            q, x, _, (worst, first), _, bound = _bounds(dim.as_py(), mine.as_buffer().to_pybytes(), theirs.as_buffer().to_pybytes())
            a, b = np.nonzero((bound >= worst[:, None]) & (first[:, None] != x[None, :]))
            yield pa.record_batch([pa.array([dim.as_py()] * len(a), pa.int32()), pa.array(q[a]), pa.array(x[b])], names=["dim", "q", "x"])


_FOUND = "dim int, q long, x long, worst double, floors binary, found binary"


def _search(k: int):
    """Each pair's trees walked: the k best of every query, and what they reach."""

    def run(batches):
        for batch in batches:
            columns = (batch.column(c) for c in ("q", "x", "dim", "query_payload", "payload", "floors"))
            for q, x, dim, mine, theirs, floors in zip(*columns):
                (query_ids, queries, one), (ids, points, two) = _open(mine, dim.as_py()), _open(theirs, dim.as_py())
                most = float(np.abs(queries).max(initial=0)), float(np.abs(points).max(initial=0))
                if max(most) ** 2 * max(1, dim.as_py()) < _BIG:
                    known = B.unpack(floors.as_py())[0] if floors.is_valid else None
                    best = dual_search(queries, query_ids, points, ids, k, (_restore(queries, *one), _restore(points, *two)), known)
                    keep, reach = best.score >= best.floor[:, None], np.maximum(best.score[:, -1], best.floor)
                else:
                    best = _search_exact(queries, query_ids, points, ids, k)
                    keep, reach = np.ones((len(queries), k), bool), np.full(len(queries), -np.inf)
                row, col = np.nonzero((best.id != np.iinfo(np.int64).max) & (best.score != -np.inf) & keep)
                found = B.pack(query_ids[row], best.id[row, col], np.array([int(s) for s in best.score[row, col]], np.int64))
                yield pa.record_batch([pa.array([dim.as_py()], pa.int32()), pa.array([q.as_py()]), pa.array([x.as_py()]), pa.array([float(reach.min())]), pa.array([B.pack(reach)], pa.binary()), pa.array([found], pa.binary())], names=["dim", "q", "x", "worst", "floors", "found"])

    return run


def _unpacked(batches):
    for batch in batches:
        for found in batch.column("found"):
            yield pa.record_batch(B.unpack(found.as_py()), names=["query_id", "vec_id", "score"])


def _searched(pairs: DataFrame, queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    mine = queries.select(F.col("block").alias("q"), "dim", F.col("payload").alias("query_payload"), "floors")
    theirs = rows.select(F.col("block").alias("x"), "dim", "payload")
    return pairs.join(mine, ["dim", "q"]).join(theirs, ["dim", "x"]).select("q", "x", "dim", "query_payload", "payload", "floors").mapInArrow(B.tidy(_search(k)), _FOUND)


def block_pairs(queries: DataFrame, rows: DataFrame, k: int, lots: tuple[int, int] = (1, 1)) -> tuple[DataFrame, DataFrame]:
    """The searched first pair of each block of queries, and the searched pairs that are left by what those reach."""
    fits = _meet(_summaries(queries, lots[0]), _summaries(rows, lots[1]), _best_fit(k), "dim int, q long, x long, full boolean, fit double")
    first = fits.groupBy("dim", "q").agg(F.max(F.struct("full", "fit", F.negative("x").alias("x"))).alias("b")).select("dim", "q", F.negative("b.x").alias("x"))
    seeds = B.cut(_searched(first, queries.withColumn("floors", F.lit(None).cast("binary")), rows, k))
    known = queries.join(seeds.select("dim", F.col("q").alias("block"), F.col("x").alias("first"), "worst", "floors"), ["dim", "block"])
    left = _meet(_summaries(known, lots[0], "worst", "first"), _summaries(rows, lots[1]), _left, "dim int, q long, x long")
    return seeds, _searched(left, known, rows, k)


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Each query's ``k`` highest integer inner products with other rows: query_id, rank, vec_id, score.

    Components become floor(scale * x), x as double; ties go to the smaller id; a query with fewer
    candidates gets all.  Rows with a null id, a null vector, or a null or non-finite component take no part;
    vectors meet only those of their own length; of rows that share an id and a length the smallest vector counts,
    wherever they are stored; scores beyond 64 bits are held at the limit; an empty table gives no rows; other
    columns are ignored.  Centres come from a sample of SAMPLE rows; they decide on speed only.
    """
    good = F.forall(vector_column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    floors = F.transform(vector_column, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    rows = vectors.filter(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & good)
    rows = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.size(vector_column).alias("dim"), floors.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    n, asked = rows.agg(F.count("*"), F.count_if("asked")).first()
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()]
    centers = centers_of(sample)
    cells = Cells(centers, sample, n, ROWS_A_BLOCK), Cells(centers, sample, asked, QUERIES_A_BLOCK)
    once = rows.groupBy("vec_id", "dim").agg(F.min("v").alias("v"), F.max("asked").alias("asked"))
    placed = once.mapInArrow(_placed(*cells), "asked boolean, block long, dim int, vec_id long, v array<double>")
    blocks = B.cut(placed.groupBy("asked", "block", "dim").applyInArrow(_build, BLOCK))
    lots = tuple(-(-(m // size + CENTERS) // SUMMARIES) for m, size in ((asked, QUERIES_A_BLOCK), (n, ROWS_A_BLOCK)))
    seeds, rest = block_pairs(blocks.filter("asked"), blocks.filter("NOT asked"), k, lots)
    found = seeds.unionByName(rest).select("found").mapInArrow(_unpacked, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

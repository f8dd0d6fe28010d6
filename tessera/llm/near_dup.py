"""Near-duplicate groups by a chosen-path set similarity join.

A document is the set of its distinct word shingles.  Equal sets become one vertex.  Independent trees
recursively branch the vertices: a node picks one of the minwise tokens (sometimes two, so that a pair at the
threshold is expected to stay together at every level), and a vertex moves to the child named by its own
token there.  Small nodes are compared exhaustively on minwise sketches; large ones (many near copies, or a
shared boilerplate) in chunks that all hold the node's pivot, and whatever those leave apart is compared with the
whole node.  So a pair meets wherever it shares a node, however large that is.  Sketches only propose: vertices that they connect form
candidate groups, and within those every pair not yet connected is confirmed, or not, on the full sets.
Groups of unbounded size are worked in chunks throughout; connections are spanning forests, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks as B
from tessera.operators.components import connected_components, contract, cut, spanning

#: Minwise tokens of a document.
TOKENS = 64
#: Independent trees: a pair at the threshold stays together in one with probability above 1/2, so 14 miss
#: about one such pair in 6,700 (1.5e-4), in small nodes and in large ones.
TREES, DEPTH = 14, 4
#: Probability of a second token at a node.
SECOND = 0.25
#: Rows of a chunk, and of a small node.
SMALL = 64
#: Tasks among which a group's rows are dealt where they meet what is known of the group.
SALTS = 16
#: A sketch proposes a pair from four standard deviations below the threshold.
SLACK = 4.0

_ODD = np.random.default_rng(515).integers(0, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(body: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, one after another, and where each text's begin.

    A text of fewer than ``k`` words has its whole sequence as one shingle; one without words has none.
    """
    found, counts = B.words(body, at)
    ends = np.cumsum(counts)
    hashes, owner = [], []
    if len(found):
        rolled = found.copy()
        for step in range(1, k):
            rolled = B.chain(rolled[: len(found) - step], found[step:]) if len(found) > step else rolled[:0]
        doc = np.repeat(np.arange(len(counts)), counts)
        start = np.arange(len(rolled))
        whole = doc[start] == doc[start + k - 1] if len(rolled) else np.zeros(0, bool)
        hashes.append(rolled[whole])
        owner.append(doc[start][whole])
        for i in np.flatnonzero((counts > 0) & (counts < k)):
            h = found[ends[i] - counts[i] : ends[i] - counts[i] + 1]
            for j in range(1, counts[i]):
                h = B.chain(h, found[ends[i] - counts[i] + j : ends[i] - counts[i] + j + 1])
            hashes.append(B.mix(h + np.uint64(counts[i])))
            owner.append(np.array([i]))
    every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    own = np.concatenate(owner).astype(np.int64) if owner else np.zeros(0, np.int64)
    order = np.lexsort((every, own))
    every, own = every[order], own[order]
    if len(every):
        keep = np.append(True, (every[1:] != every[:-1]) | (own[1:] != own[:-1]))
        every, own = every[keep], own[keep]
    return every, np.searchsorted(own, np.arange(len(counts) + 1))


_BASE = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("key_a", pa.int64()), ("key_b", pa.int64()), ("tokens", pa.binary())])


def _sketches(k: int):
    def run(batches):
        for whole in batches:
            for batch in B.byte_slices(whole, limit=B.SLICE_BYTES // 2):
                hashes, at = shingle_sets(*B.text_buffers(batch.column("text")), k)
                sizes = np.diff(at)
                some = np.flatnonzero(sizes)
                tokens = np.zeros((len(sizes), TOKENS), np.uint32)
                keys = np.zeros((2, len(sizes)), np.uint64)
                if len(some):
                    for t in range(TOKENS):
                        tokens[some, t] = np.minimum.reduceat(hashes * _ODD[t], at[some]) >> np.uint64(32)
                    keys[0, some] = np.add.reduceat(B.mix(hashes), at[some])
                    keys[1, some] = np.add.reduceat(B.mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at[some])
                packed = [row.tobytes() if n else None for row, n in zip(tokens, sizes)]
                yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), batch.column("text_key"), pa.array(sizes.astype(np.int64)), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.array(packed, pa.binary())], schema=_BASE)

    return run


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), TOKENS)


def _descend(nodes: np.ndarray, rows: np.ndarray, tokens: np.ndarray, levels: int, second_token: float) -> tuple[np.ndarray, np.ndarray]:
    """The nodes reached ``levels`` further down; ``rows`` says whose tokens each entry follows.

    ``second_token`` is the probability that a node picks two tokens.
    """
    u = np.uint64
    for _ in range(levels):
        draw = B.mix(nodes + u(0x51ED270B))
        first = (draw % u(TOKENS)).astype(np.int64)
        second = (B.mix(draw) % u(TOKENS)).astype(np.int64)
        also = ((draw >> u(32)).astype(np.float64) < second_token * 2.0**32) & (second != first)
        children = [B.mix(B.chain(nodes, tokens[rows, first].astype(u)) + first.astype(u))]
        children.append(B.mix(B.chain(nodes[also], tokens[rows[also], second[also]].astype(u)) + second[also].astype(u)))
        nodes, rows = np.concatenate(children), np.concatenate([rows, rows[also]])
    return nodes, rows


def _placed(nodes, rows, vertices):
    return pa.record_batch([pa.array(nodes.view(np.int64)), pa.array(vertices[rows])], names=["node", "vertex"])


def _plant(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            some = batch.slice(at, 4096)
            vertices, tokens = some.column("vertex").to_numpy(), _tokens(some.column("tokens"))
            rows = np.tile(np.arange(len(vertices)), TREES)
            roots = np.repeat(B.mix(np.arange(1, TREES + 1, dtype=np.uint64)), len(vertices))
            yield _placed(*_descend(roots, rows, tokens, DEPTH, SECOND), vertices)


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _edges(pairs: list[tuple[int, int]], ids) -> pa.RecordBatch:
    return pa.record_batch([pa.array([int(ids[a]) for a, _ in pairs], pa.int64()), pa.array([int(ids[b]) for _, b in pairs], pa.int64())], schema=_EDGE)


def groups(batches, key: str, once: str = "vertex") -> Iterator[pa.Table]:
    """The rows of each key in turn, from batches sorted by key and ``once``; a repeated row counts once."""
    held: list = []
    last = before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, each = (batch.column(c).to_numpy(zero_copy_only=False) for c in (key, once))
        new = np.append((keys[0], each[0]) != before, (keys[1:] != keys[:-1]) | (each[1:] != each[:-1]))
        before = keys[-1], each[-1]
        if not new.all():
            batch, keys = batch.filter(pa.array(new)), keys[new]
            if not len(keys):
                continue
        edges = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        for a, b in zip(edges, edges[1:]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def least_agreement(similarity: float) -> int:
    """How many of a pair's tokens agree at least, short of chance that SLACK covers."""
    return int(np.floor(TOKENS * similarity - SLACK * np.sqrt(TOKENS * similarity * (1 - similarity))))


def _compare_sketches(least: int):
    """Spanning forests of the pairs in each (sorted) node that sketches propose; rows are node, vertex, sketch."""

    def proposals(node, vertex, sketch):
        edge = np.concatenate(([0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]))
        size = np.diff(edge)
        us, vs = [], []
        pair = edge[:-1][size == 2]  # most nodes are pairs: all at once
        near = (sketch[pair] == sketch[pair + 1]).sum(axis=1) >= least
        us.append(vertex[pair[near]])
        vs.append(vertex[pair[near] + 1])
        for a, n in zip(edge[:-1][size > 2], size[size > 2]):
            part = sketch[a : a + n]
            linked = (part[:, None, :] == part[None, :, :]).sum(axis=2) >= least
            found = spanning(n, linked)
            if found:
                x = np.array(found)
                us.append(vertex[a + x[:, 0]])
                vs.append(vertex[a + x[:, 1]])
        return pa.record_batch([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], schema=_EDGE)

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            node, vertex = batch.column("node").to_numpy(), batch.column("vertex").to_numpy()
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(len(node), TOKENS)
            if rest is not None:
                node, vertex, sketch = (np.concatenate(x) for x in zip(rest, (node, vertex, sketch)))
            last = int(np.searchsorted(node, node[-1], side="left"))
            if last:
                yield proposals(node[:last], vertex[:last], sketch[:last])
            rest = node[last:], vertex[last:], sketch[last:]
        if rest is not None:
            yield proposals(*rest)

    return run


def _forest(edges_of):
    """Edges contracted in the worker that finds them: a stage with two Python operators has twice the workers."""
    return B.tidy(lambda batches: contract(edges_of(batches)))


def _sorted_map(df: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    return df.repartition(B.partitions(df.sparkSession), keys[0]).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _chunk_key(group: str, chunk) -> F.Column:
    return F.xxhash64(F.col(group), chunk)


def _salted(rows: DataFrame, each: DataFrame, group: str, how: str = "inner") -> DataFrame:
    """Join rows with the one row of their group; a group's rows are dealt to SALTS tasks."""
    each = each.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("vertex", F.lit(7)), F.lit(SALTS)).cast("int"))
    return rows.join(each, [group, "salt"], how).drop("salt")


def _in_chunks(wide: DataFrame, sizes: DataFrame, group: str, *carried: str) -> DataFrame:
    """Rows (group, vertex, chunk_key, and what is carried) in chunks of about SMALL; each chunk also has its group's pivot.

    ``wide`` has each row's n (rows in its group) and pivot, ``sizes`` those of each group and, as pivot_*, what the pivot carries.
    """
    chunks = F.ceil(F.col("n") / F.lit(SMALL - 8)).cast("int")
    own = wide.filter(F.col("vertex") != F.col("pivot")).withColumn("chunk", F.pmod(F.xxhash64("vertex", group), chunks).cast("int"))
    pivots = sizes.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    pivots = pivots.select(group, F.col("pivot").alias("vertex"), "chunk", *[F.col(f"pivot_{c}").alias(c) for c in carried])
    both = own.select(group, "vertex", "chunk", *carried).unionByName(pivots)
    return both.select(group, "vertex", _chunk_key(group, F.col("chunk")).alias("chunk_key"), *carried)


def _cross_chunks(members: DataFrame, labels: DataFrame, sizes: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """What chunks leave apart: the vertices of each group that aren't with its pivot, and the groups that have such.

    ``labels`` gives (vertex, label); a vertex without one is alone.  Both results are dealt into chunks;
    every left chunk has to meet every right chunk of its group.
    """
    named = members.join(labels, "vertex", "left").withColumn("label", F.coalesce("label", "vertex"))
    pivot = sizes.select(group, "n", "pivot").join(labels.withColumnRenamed("vertex", "pivot"), "pivot", "left")
    named = _salted(named, pivot.select(group, "n", F.coalesce("label", "pivot").alias("main")), group)
    lone = named.filter("label <> main")
    rest = lone.groupBy(group).agg(F.count("*").alias("m"))
    dealt = lambda df, n, tag: df.select(
        group, "vertex", "label",
        F.pmod(F.xxhash64("vertex", F.lit(tag)), F.greatest(F.lit(1), F.ceil(F.col(n) / SMALL)).cast("int")).cast("int").alias("chunk"),
    )
    return dealt(_salted(lone, rest, group), "m", 1), dealt(_salted(named, rest.select(group), group, "left_semi"), "n", 2)


def _hashes_of(text_column, k: int) -> list[np.ndarray]:
    hashes, at = shingle_sets(*B.text_buffers(text_column), k)
    return [hashes[a:b] for a, b in zip(at, at[1:])]


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set on the left with every set on the right."""
    every = np.concatenate([*left, *right]) if left or right else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    start = np.append(True, every[1:] != every[:-1]) if len(every) else np.zeros(0, bool)
    group = np.cumsum(start) - 1
    many = np.bincount(group, minlength=1) > 1 if len(every) else np.zeros(1, bool)
    keep = many[group] if len(every) else np.zeros(0, bool)
    row = (np.cumsum(many) - 1)[group[keep]] if len(every) else np.zeros(0, np.int64)
    owner = owner[keep]
    out = np.zeros((len(left), len(right)))
    step = max(1, (1 << 21) // max(1, len(left) + len(right)))
    for a in range(0, int(row[-1]) + 1 if len(row) else 0, step):
        x, y = np.searchsorted(row, (a, a + step))
        table = np.zeros((step, len(left) + len(right)), np.float32)
        table[row[x:y] - a, owner[x:y]] = 1
        out += table[:, : len(left)].T @ table[:, len(left) :]
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    inter = intersections(left, right)
    union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - inter
    return (100 * inter >= percent * union) & (inter > 0)


def _confirm(k: int, percent: int):
    """Spanning forests of the confirmed links in each chunk (rows: chunk_key, vertex, text)."""

    def run(batches):
        for table in groups(batches, "chunk_key"):
            ids, sets = table.column("vertex").to_pylist(), []
            if len(ids) < 2:
                continue
            for piece in B.byte_slices(table.select(["text"]).combine_chunks()):
                sets += _hashes_of(piece.column("text"), k)
            yield _edges(spanning(len(ids), linked(sets, sets, percent)), ids)

    return run


def _pack_chunks(k: int):
    def run(batches):
        for table in groups(batches, "chunk_key"):
            sets = []
            for piece in B.byte_slices(table.select(["text"]).combine_chunks()):
                sets += _hashes_of(piece.column("text"), k)
            ids, label = table.column("vertex").to_numpy(), table.column("label").to_numpy()
            payload = B.pack(ids, label, np.array([len(s) for s in sets], np.int64), np.concatenate(sets))
            yield pa.record_batch([table.column("grp")[:1].combine_chunks(), pa.array([payload], pa.binary())], names=["grp", "payload"])

    return run


def _open_chunk(payload):
    ids, label, sizes, flat = B.unpack(payload.as_buffer().to_pybytes())
    return ids, label, np.split(flat, np.cumsum(sizes)[:-1])


def _confirm_pairs(percent: int):
    def run(batches):
        for batch in batches:
            for mine, theirs in zip(batch.column("left_payload"), batch.column("payload")):
                (ids, label, sets), (ids2, label2, sets2) = _open_chunk(mine), _open_chunk(theirs)
                good = linked(sets, sets2, percent) & (label[:, None] != label2[None, :])
                n = len(ids)
                square = np.zeros((n + len(ids2), n + len(ids2)), bool)
                square[:n, n:] = good
                square[n:, :n] = good.T
                yield _edges(spanning(len(square), square), np.concatenate([ids, ids2]))

    return run


def _compare_pairs(least: int):
    """Like :func:`_confirm_pairs`, on sketches."""

    def run(batches):
        for batch in batches:
            for mine, theirs in zip(batch.column("left_payload"), batch.column("payload")):
                a, x = B.unpack(mine.as_buffer().to_pybytes())
                b, y = B.unpack(theirs.as_buffer().to_pybytes())
                x, y = x.reshape(-1, TOKENS), y.reshape(-1, TOKENS)
                good = (x[:, None, :] == y[None, :, :]).sum(axis=2) >= least
                n = len(a)
                square = np.zeros((n + len(b), n + len(b)), bool)
                square[:n, n:] = good
                square[n:, :n] = good.T
                yield _edges(spanning(len(square), square), np.concatenate([a, b]))

    return run


def _pack_sketches(batches):
    for table in groups(batches, "chunk_key"):
        payload = B.pack(table.column("vertex").to_numpy(), np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8))
        yield pa.record_batch([table.column("grp")[:1].combine_chunks(), pa.array([payload], pa.binary())], names=["grp", "payload"])


def _meet_chunks(left: DataFrame, right: DataFrame, compare) -> DataFrame:
    """Every left chunk with every right chunk of its group; salted, as one group may hold most chunks."""
    left = left.withColumnRenamed("payload", "left_payload").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    right = right.withColumn("salt", F.pmod(F.xxhash64("payload"), F.lit(SALTS)).cast("int"))
    # a merge join keeps packing and comparing, both Python, in separate stages
    return left.join(right.hint("merge"), ["grp", "salt"]).select("left_payload", "payload").mapInArrow(compare, "u long, v long")


def _proposed(vertices: DataFrame, least: int) -> DataFrame:
    """Edges that connect every pair of vertices which share a node of some tree and whose sketches agree enough."""
    sketches = vertices.select("vertex", "sketch")
    placed = vertices.select("vertex", "tokens").mapInArrow(B.tidy(_plant), "node long, vertex long")
    # written, so that the join below has an exchange of its own, whose large partitions Spark can split
    sizes = cut(placed.groupBy("node").agg(F.count("*").alias("n"), F.min("vertex").alias("pivot")).filter("n > 1"))
    shared = cut(placed.join(sizes, "node").select("node", "vertex", "n", "pivot"))
    few = shared.filter(F.col("n") <= SMALL).select("node", "vertex").join(sketches, "vertex")
    edges = [_sorted_map(few.select("node", "vertex", "sketch"), ["node"], _forest(_compare_sketches(least)), "u long, v long")]
    many = shared.filter(F.col("n") > SMALL)
    if not many.isEmpty():
        sizes = many.select("node", "n", "pivot").distinct()
        chunks = _in_chunks(many, sizes, "node").join(sketches, "vertex")
        near = _sorted_map(chunks.select(F.col("chunk_key").alias("node"), "vertex", "sketch"), ["node"], _forest(_compare_sketches(least)), "u long, v long")
        near = cut(near)
        edges.append(near)
        labels = connected_components(near, contracted=True).select(F.col("node").alias("vertex"), F.col("component").alias("label"))
        left, right = _cross_chunks(many.select("node", "vertex"), labels, sizes, "node")
        left, right = (x.select(F.col("node").alias("grp"), _chunk_key("node", F.col("chunk")).alias("chunk_key"), "vertex") for x in (left, right))
        left, right = (_sorted_map(x.join(sketches, "vertex").select("grp", "chunk_key", "vertex", "sketch"), ["chunk_key", "vertex"], _pack_sketches, "grp long, payload binary") for x in (left, right))
        edges.append(_meet_chunks(left, right, _forest(_compare_pairs(least))))
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def near_duplicates(documents: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Rows are linked if 100 * |intersection| >= percent * |union| of their sets of distinct shingles (words
    ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased); component_id is the smallest doc_id that links reach, kept
    tells whether that is the row's own.  A text of fewer words than a shingle has its whole sequence as one;
    null, empty and blank texts have an empty set and link with nothing.  A row with a null id takes no part:
    its component_id is null and it isn't kept.  Repeated rows are equal sets: all of them share the
    component, and rows that also share the id are all kept.  Empty tables give no rows; other columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    base = cut(docs.mapInArrow(B.tidy(_sketches(shingle_words)), "doc_id long, text_key long, n_shingles long, key_a long, key_b long, tokens binary"))
    # a vertex is a distinct set (of one size and 128-bit hash), numbered, with the row that represents it
    linkable = base.filter("doc_id IS NOT NULL AND n_shingles > 0")
    same = ["key_a", "key_b", "n_shingles"]
    vertices = linkable.groupBy(*same).agg(F.min(F.struct("doc_id", "text_key")).alias("row"), F.first("tokens").alias("tokens"))
    vertices = vertices.select(F.monotonically_increasing_id().alias("vertex"), *same, "row.doc_id", "row.text_key", "tokens")
    vertices = cut(vertices.mapInArrow(B.tidy(_narrow), "vertex long, key_a long, key_b long, n_shingles long, doc_id long, text_key long, tokens binary, sketch binary"))
    candidates = connected_components(_proposed(vertices, least_agreement(percent / 100)), contracted=True)
    members = candidates.select(F.col("component").alias("grp"), F.col("node").alias("vertex"))
    members = cut(members.join(vertices.select("vertex", "doc_id", "text_key"), "vertex"))
    pivot = F.min(F.struct("vertex", "doc_id", "text_key"))
    sizes = members.groupBy("grp").agg(F.count("*").alias("n"), pivot.alias("p"))
    large_sizes = cut(sizes.filter(F.col("n") > SMALL).select("grp", "n", F.col("p.vertex").alias("pivot"), F.col("p.doc_id").alias("pivot_doc_id"), F.col("p.text_key").alias("pivot_text_key")))
    tagged = _salted(members, large_sizes.select("grp", "n", "pivot"), "grp", "left")
    small = tagged.filter("n IS NULL").select(F.xxhash64("grp").alias("chunk_key"), "vertex", "doc_id", "text_key")
    large = tagged.filter("n IS NOT NULL")
    chunked = _in_chunks(large, large_sizes, "grp", "doc_id", "text_key").drop("grp")
    texts = docs.join(small.unionByName(chunked), ["doc_id", "text_key"]).select("chunk_key", "vertex", "text")
    links = cut(_sorted_map(texts, ["chunk_key", "vertex"], _forest(_confirm(shingle_words, percent)), "u long, v long"))
    if not large_sizes.isEmpty():
        labels = connected_components(links, contracted=True).select(F.col("node").alias("vertex"), F.col("component").alias("label"))
        left, right = (_packed(x, docs, members, shingle_words) for x in _cross_chunks(large.select("grp", "vertex"), labels, large_sizes, "grp"))
        links = links.unionByName(_meet_chunks(left, right, _forest(_confirm_pairs(percent))))
    found = cut(connected_components(links, contracted=True).withColumnRenamed("node", "vertex").join(vertices.select("vertex", "doc_id"), "vertex"))
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = found.join(least, "component").select("vertex", "component_id")
    named = vertices.select("vertex", "doc_id", *same).join(named, "vertex", "left").select(*same, F.coalesce("component_id", "doc_id").alias("component_id"))
    out = base.select("doc_id", *same).join(named, same, "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _packed(chunks: DataFrame, docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """One row a chunk (grp, vertex, label, chunk) with its vertices, labels and full sets."""
    chunks = chunks.select("grp", _chunk_key("grp", F.col("chunk")).alias("chunk_key"), "vertex", "label")
    placed = chunks.join(members.select("vertex", "doc_id", "text_key"), "vertex")
    texts = docs.join(placed, ["doc_id", "text_key"]).select("grp", "chunk_key", "vertex", "label", "text")
    return _sorted_map(texts, ["chunk_key", "vertex"], _pack_chunks(k), "grp long, payload binary")


def _narrow(batches):
    """Adds the sketch: the lowest byte of every token."""
    for batch in batches:
        if batch.num_rows:
            sketch = [row.tobytes() for row in (_tokens(batch.column("tokens")) & 0xFF).astype(np.uint8)]
            yield pa.record_batch([*batch.columns, pa.array(sketch, pa.binary())], names=[*batch.schema.names, "sketch"])

"""Removal of long repeated byte strings by a common-prefix-aware distributed merge sort of sampled suffixes.

A byte goes if it lies in a string of LENGTH bytes that also starts anywhere else.  Sorting every suffix would move
each text many times over, so only sampled suffixes are sorted: those that begin at an anchor, the leftmost
smallest-hashed GRAM bytes of a window of LENGTH.  Equal windows have their anchor at the same offset, so windows
can only equal others whose anchors begin alike.

1. Blocks of documents ask, by the block exchange, which of their anchors' grams occur more than once at all.
2. Each block sorts the suffixes at those anchors, front-codes the sorted run (what a suffix shares with the one
   before isn't sent), with each one's left context, and sends every key range its part.
3. A range merges its runs with a loser tree that keeps, for each contender, the prefix known to be common
   with the last one out, and never compares those bytes again.  The merge yields the sorted suffixes with
   their common prefix lengths; left contexts are sorted likewise.  For each offset of the anchor in
   a window, windows are equal where both the right and the left classes at that offset are.
4. Blocks take the answers and cut.

Copies within a block are sent once, with how often they occur.  Grams that occur more than HOT times (a passage
in a large part of all documents) would gather in one range: their windows are counted by 128-bit hash instead,
each in its hash's range, so no range holds more of one passage than one entry a block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm import blocks as B

LENGTH, GRAM, HOT = 200, 50, 100_000
#: Text bytes whose anchors are found at a time, and of a block.
SLICE, BLOCK = 1 << 20, 6 << 20
_TABLE2 = np.random.default_rng(77001).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# --- anchors ---------------------------------------------------------------------------------------


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    n = len(keys) - width + 1
    rows = -(-len(keys) // width) + 1
    square = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    square[: len(keys)] = keys
    square = square.reshape(rows, width)
    onward = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], onward[width - 1 : width - 1 + n])


def anchors(body: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors of all windows of the texts in a row; their largest and least offset in a window; gram hashes."""
    none = np.zeros(0, np.int64)
    if len(body) < length:
        return none, none, none, np.zeros(0, np.uint64)
    starts = np.arange(len(body) - gram + 1)
    sums = B.prefix_hashes(body)
    # as range_hashes, for all places at once
    hashes = B.mix((sums[gram:] - sums[:-gram]) * B.powers(B._INVERSE, len(sums))[: len(starts)] + np.uint64(gram * B._MIX2 & (1 << 64) - 1))
    del sums
    bits = max(23, int(len(body)).bit_length())
    keys = hashes >> np.uint64(bits) << np.uint64(bits) | starts.astype(np.uint64)
    anchor = (_sliding_least(keys, length - gram + 1) & np.uint64((1 << bits) - 1)).astype(np.int64)
    # windows that leave their text
    good = np.ones(len(anchor), bool)
    ends = at[1:-1]
    cut = np.zeros(len(anchor) + 1, np.int64)
    low = np.maximum(ends - length + 1, 0)
    np.add.at(cut, np.minimum(low, len(anchor)), 1)
    np.add.at(cut, np.minimum(ends, len(anchor)), -1)
    good &= np.cumsum(cut[:-1]) == 0
    window = np.flatnonzero(good)
    if not len(window):
        return none, none, none, np.zeros(0, np.uint64)
    anchor = anchor[window]
    edge = np.append(True, (anchor[1:] != anchor[:-1]) | (np.diff(window) != 1))
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(anchor)) - 1
    place = anchor[first]
    # an anchor's hash is the least of many, so mix it once more before ranges are cut
    return place, place - window[first], place - window[last], B.mix(hashes[place] + np.uint64(B._MULT))


# --- merging ---------------------------------------------------------------------------------------


def _common(a: bytes, b: bytes, known: int) -> int:
    """How long a prefix is common, given that ``known`` bytes are."""
    most, step = min(len(a), len(b)), 16
    while known < most:
        if a[known : known + step] == b[known : known + step]:
            known = min(known + step, most)
            step = 64
            continue
        if step == 1:
            return known
        step = step // 4 or 1
    return most


class LoserTree:
    """Merges sorted runs of (strings, common prefix lengths); yields (string, common prefix with the last one, run, place)."""

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]):
        self.runs = runs

    def merge(self):
        runs = self.runs
        size = 1 << max(0, (len(runs) - 1).bit_length())
        current: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (size - len(runs))
        known, place = [0] * size, [0] * size
        loser = [0] * size
        winner = list(range(size)) if size == 1 else [0] * size + list(range(size))

        def game(a: int, b: int) -> tuple[int, int]:
            """Winner and loser; the loser's known prefix becomes what it shares with the winner."""
            x, y = current[a], current[b]
            if y is None:
                return a, b
            if x is None:
                return b, a
            if known[a] != known[b]:
                return (a, b) if known[a] > known[b] else (b, a)
            shared = _common(x, y, known[a])
            if shared == len(x) or (shared < len(y) and x[shared] < y[shared]):
                known[b] = shared
                return a, b
            known[a] = shared
            return b, a

        if size > 1:
            for node in range(size - 1, 0, -1):
                winner[node], loser[node] = game(winner[2 * node], winner[2 * node + 1])
        top = winner[1] if size > 1 else 0
        while (string := current[top]) is not None:
            yield string, known[top], top, place[top]
            strings, shared = runs[top]
            place[top] += 1
            if place[top] < len(strings):
                current[top], known[top] = strings[place[top]], shared[place[top]]
            else:
                current[top] = None
            node = (top + size) >> 1
            while node:
                top, loser[node] = game(top, loser[node])
                node >>= 1


def _square(body: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, back: bool = False) -> np.ndarray:
    """Strings as rows padded with zeros; ``back`` reads them from their ends."""
    out = np.zeros((len(start), width), np.uint8)
    step = np.arange(width, dtype=np.int32)[None, :]
    for at in range(0, len(start) if len(body) else 0, 4096):
        a, n = start[at : at + 4096, None].astype(np.int32), size[at : at + 4096, None].astype(np.int32)
        inside = step < n
        index = a + n - 1 - step if back else a + step
        out[at : at + 4096] = np.where(inside, body[np.where(inside, index, 0)], 0)
    return out


def _sort(square: np.ndarray, size: np.ndarray) -> np.ndarray:
    keys = np.ascontiguousarray(square).view(f"S{square.shape[1]}").ravel()
    return np.lexsort((size, keys))


def _prefixes(square: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What each row has in common with the one before."""
    out = np.zeros(len(square), np.int64)
    if len(square) > 1:
        differ = square[1:] != square[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), square.shape[1])
        out[1:] = np.minimum(first, np.minimum(size[1:], size[:-1]))
    return out


def repeated_windows(lcp_right: np.ndarray, left_class_order: np.ndarray, lcp_left: np.ndarray, most: np.ndarray, least: np.ndarray, times: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For suffixes in sorted order: at which offsets of the anchor their window occurs again (bits, a byte for eight)."""
    n, offsets = len(lcp_right), length - gram + 1
    out = np.zeros((n, -(-offsets // 8) * 8), bool)
    for offset in range(offsets):
        held = np.flatnonzero((least <= offset) & (offset <= most))
        if len(held) < 2 and not (times[held] > 1).any():
            continue
        right = np.cumsum(lcp_right < length - offset)
        left = np.empty(n, np.int64)
        left[left_class_order] = np.cumsum(lcp_left < offset)
        _, inverse = np.unique(right[held] * (n + 1) + left[held], return_inverse=True)
        out[held, offset] = np.bincount(inverse, weights=times[held])[inverse] > 1
    return np.packbits(out, axis=1)


# --- the exchange ----------------------------------------------------------------------------------


class Block:
    def __init__(self, payload: bytes, length: int, gram: int):
        self.doc, self.known, sizes, text, place, most, least, steps, self.extra = B.unpack(payload)
        self.known = self.known.astype(bool)
        self.body = np.frombuffer(text, np.uint8)
        self.at = np.append(0, np.cumsum(sizes, dtype=np.int64))
        self.place, self.most, self.least = B.undeltas(place.astype(np.int64)), most.astype(np.int64), least.astype(np.int64)
        self.length, self.gram = length, gram
        self.grams = steps

    def requests(self, n: int) -> list[bytes]:
        """First question: how often do the anchors' grams occur?"""
        hashes, counts = np.unique(self.grams, return_counts=True)
        edges = B.ranges_of(hashes, n)
        return [B.pack(B.deltas(hashes[a:b]), B.small(counts[a:b])) for a, b in zip(edges, edges[1:])]

    def take(self, replies: list[bytes], n: int) -> None:
        """Sort the suffixes that the first answers leave, range by range; windows of hot grams by hash."""
        hashes, inverse = np.unique(self.grams, return_inverse=True)
        code = np.concatenate([B.unpack(r)[0] for r in replies])[inverse] if len(hashes) else np.zeros(0, np.uint8)
        here = np.flatnonzero(code == 1)
        place, most, least = self.place[here], self.most[here], self.least[here]
        right_size = self.length - least
        right = _square(self.body, place, right_size, self.length)
        left = _square(self.body, place - most, most, self.length - self.gram, back=True)
        part = np.minimum((hashes[inverse[here]] >> np.uint64(32)) * np.uint64(n) >> np.uint64(32), np.uint64(n - 1)).astype(np.int64)
        keys = [np.ascontiguousarray(x).view(f"S{x.shape[1]}").ravel() for x in (right, left)]
        order = np.lexsort((most, keys[1], right_size, keys[0], part))
        new = np.ones(len(order), bool)
        if len(order) > 1:
            x, y = order[1:], order[:-1]
            new[1:] = (keys[0][x] != keys[0][y]) | (keys[1][x] != keys[1][y]) | (right_size[x] != right_size[y]) | (most[x] != most[y]) | (part[x] != part[y])
        row = np.cumsum(new) - 1
        self.here, self.row_of = here, np.empty(len(order), np.int64)
        self.row_of[order] = row
        first = order[new]
        self.rows = {"right": right[first], "right_size": right_size[first], "left": left[first], "most": most[first], "least": least[first], "times": np.bincount(row) if len(row) else np.zeros(0, np.int64), "part": part[first]}
        # hot grams: every window's hash
        hot = np.flatnonzero(code == 2)
        many = self.most[hot] - self.least[hot] + 1
        step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        self.hot_start = np.repeat(self.place[hot] - self.most[hot], many) + step
        if len(hot):
            one = B.range_hashes(B.prefix_hashes(self.body), self.hot_start, self.hot_start + self.length)
            sums = np.append(np.uint64(0), np.cumsum(_TABLE2[self.body] * B.powers(B._MULT, len(self.body)), dtype=np.uint64))
            two = B.range_hashes(sums, self.hot_start, self.hot_start + self.length)
        else:
            one = two = np.zeros(0, np.uint64)
        order = np.lexsort((two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        self.hot_of = np.empty(len(order), np.int64)
        self.hot_of[order] = np.cumsum(new) - 1
        self.hot = one[order][new], two[order][new], np.bincount(np.cumsum(new) - 1) if len(order) else np.zeros(0, np.int64)

    def runs(self, n: int) -> list[bytes]:
        """Second question: the front-coded sorted run for each range, and hot windows' hashes."""
        r, out = self.rows, []
        edges = np.searchsorted(r["part"], np.arange(n + 1))
        hot_edges = B.ranges_of(self.hot[0], n)
        for a, b, c, d in zip(edges, edges[1:], hot_edges, hot_edges[1:]):
            right, size, left, most = r["right"][a:b], r["right_size"][a:b], r["left"][a:b], r["most"][a:b]
            shared = _prefixes(right, size)
            step = np.arange(right.shape[1])[None, :]
            tails = right[(step >= shared[:, None]) & (step < size[:, None])].tobytes()
            lefts = left[np.arange(left.shape[1])[None, :] < most[:, None]].tobytes()
            out.append(B.pack(B.small(shared), B.small(size), tails, B.small(most), lefts, B.small(np.minimum(r["times"][a:b], 2)), B.deltas(self.hot[0][c:d]), self.hot[1][c:d], B.small(np.minimum(self.hot[2][c:d], 2))))
        return out

    def removed(self, replies: list[bytes]) -> np.ndarray:
        """Which bytes go."""
        opened = [B.unpack(r) for r in replies]
        width = -(-(self.length - self.gram + 1) // 8)
        bits = np.concatenate([o[0] for o in opened]).reshape(-1, width)
        repeats = np.zeros(len(self.body) + self.length, bool)  # whether the window that begins here does
        for at in range(0, len(self.here), 4096):
            own = self.here[at : at + 4096]
            row, offset = np.nonzero(np.unpackbits(bits[self.row_of[at : at + 4096]], axis=1))
            own = own[row]
            good = (offset >= self.least[own]) & (offset <= self.most[own])
            repeats[(self.place[own] - offset)[good]] = True
        if len(self.hot_start):
            repeats[self.hot_start[np.concatenate([o[1] for o in opened])[self.hot_of] > 0]] = True
        before = np.cumsum(repeats, dtype=np.int32)
        before[self.length :] -= before[: -self.length].copy()
        return before[: len(self.body)] > 0


def _how_often(hot: int):
    def answer(requests: list[bytes]) -> list[bytes]:
        opened = [B.unpack(r) for r in requests]
        keys = np.concatenate([B.undeltas(o[0]) for o in opened])
        _, inverse = np.unique(keys, return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([o[1] for o in opened]).astype(float))[inverse]
        code = np.where(total > hot, 2, np.where(total > 1, 1, 0)).astype(np.uint8)
        return [B.pack(c) for c in np.split(code, np.cumsum([len(o[0]) for o in opened])[:-1])]

    return answer


def _merged(length: int, gram: int):
    def answer(requests: list[bytes]) -> list[bytes]:
        opened = [B.unpack(r) for r in requests]
        runs = []
        for shared, size, tails, *_ in opened:
            strings, before, at = [], b"", 0
            for k, n in zip(shared.tolist(), size.tolist()):
                before = before[:k] + tails[at : at + n - k]
                at += n - k
                strings.append(before)
            runs.append((strings, shared.tolist()))
        merged = [(known, run, place) for _, known, run, place in LoserTree(runs).merge()]
        offset = np.append(0, np.cumsum([len(s) for s, _ in runs]))
        n = int(offset[-1])
        lcp = np.array([m[0] for m in merged], np.int64)
        source = np.array([offset[run] + place for _, run, place in merged], np.int64)
        most = np.concatenate([o[3] for o in opened]).astype(np.int64)[source] if n else np.zeros(0, np.int64)
        size = np.concatenate([o[1] for o in opened]).astype(np.int64)[source] if n else np.zeros(0, np.int64)
        times = np.concatenate([o[5] for o in opened]).astype(np.int64)[source] if n else np.zeros(0, np.int64)
        lefts = np.frombuffer(b"".join(o[4] for o in opened), np.uint8)
        widths = np.concatenate([o[3] for o in opened]).astype(np.int64)
        left_start = (np.cumsum(widths) - widths)[source] if n else np.zeros(0, np.int64)
        left = _square(lefts, left_start, most, length - gram) if n else np.zeros((0, length - gram), np.uint8)
        by_left = _sort(left, most) if n else np.zeros(0, np.int64)
        bits = repeated_windows(lcp, by_left, _prefixes(left[by_left], most[by_left]), most, length - size, times, length, gram)
        answers = np.zeros((n, bits.shape[1] if n else -(-(length - gram + 1) // 8)), np.uint8)
        if n:
            answers[source] = bits
        one, two = np.concatenate([B.undeltas(o[6]) for o in opened]), np.concatenate([o[7] for o in opened])
        again = np.zeros(len(one), np.uint8)
        if len(one):
            order = np.lexsort((two, one))
            group = np.empty(len(one), np.int64)
            group[order] = np.cumsum(np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))) - 1
            again = (np.bincount(group, weights=np.concatenate([o[8] for o in opened]).astype(float))[group] > 1).astype(np.uint8)
        hot_at = np.append(0, np.cumsum([len(o[6]) for o in opened]))
        return [B.pack(answers[a:b].ravel(), again[c:d]) for a, b, c, d in zip(offset, offset[1:], hot_at, hot_at[1:])]

    return answer


def _blocks(length: int, gram: int, extra: list[str], limit: int):
    def run(batches):
        ordinal, held, size = 0, [], 0

        def block():
            nonlocal ordinal
            docs = pa.concat_arrays([h[0] for h in held])
            base = np.cumsum([0] + [len(h[1]) for h in held])
            place = np.concatenate([h[3] + b for h, b in zip(held, base)])
            others = b""
            if extra:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, held[0][7].schema) as stream:
                    for h in held:
                        stream.write_batch(h[7])
                others = sink.getvalue().to_pybytes()
            payload = B.pack(docs.fill_null(0).to_numpy(), docs.is_valid().to_numpy(zero_copy_only=False), B.small(np.concatenate([np.diff(h[2]) for h in held])), b"".join(h[1].tobytes() for h in held), B.small(B.deltas(place)), *(B.small(np.concatenate([h[i] for h in held])) for i in (4, 5)), np.concatenate([h[6] for h in held]), others)
            ordinal += 1
            return pa.record_batch([pa.array([B.block_key(ordinal, payload)], pa.int64()), pa.array([payload], pa.binary())], names=["block", "payload"])

        for whole in batches:
            for batch in B.byte_slices(whole, limit=min(limit, SLICE)):
                body, at = B.text_buffers(batch.column("text"))
                others = batch.select(extra) if extra else None
                held.append((batch.column("doc_id").cast(pa.int64()), body, at, *anchors(body, at, length, gram), others))
                size += len(body) + 64 * batch.num_rows
                if size >= limit:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    return run


def _exchange(payloads: DataFrame, length: int, gram: int, hot: int, finish, schema: str, arrow: pa.Schema) -> DataFrame:
    """Two rounds of questions, then ``finish(block, removed)`` for each block."""
    n = B.partitions(payloads.sparkSession)
    held = payloads.repartition(n, "block")
    sent_schema = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("body", pa.binary())])
    back_schema = pa.schema([("block", pa.int64()), ("round", pa.int32()), ("range", pa.int32()), ("body", pa.binary())])
    sent, back = "range int, block long, body binary", "block long, round int, range int, body binary"

    def ask(batches):
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                yield B.rows(sent_schema, list(range(n)), [block] * n, Block(payload.as_buffer().to_pybytes(), length, gram).requests(n))

    def merged(number: int, answer):
        def merge(key, table):
            table = table.sort_by("block")
            found = answer(table.column("body").to_pylist())
            B.release()
            columns = [table.column("block").cast(pa.int64()), pa.array([number] * len(found), pa.int32()), table.column("range").cast(pa.int32()), pa.array(found, pa.binary())]
            return pa.table(columns, schema=back_schema)

        return merge

    def ask_again(key, left, right):
        replies, out = right.sort_by("range").column("body").to_pylist(), [sent_schema.empty_table()]
        for block, payload in zip(left.column("block").to_pylist(), left.column("payload")):
            own = Block(payload.as_buffer().to_pybytes(), length, gram)
            own.take(replies, n)
            out.append(pa.Table.from_batches([B.rows(sent_schema, list(range(n)), [block] * n, own.runs(n))]))
            del own
            B.release()
        return pa.concat_tables(out)

    def close(key, left, right):
        right = right.sort_by([("round", "ascending"), ("range", "ascending")])
        replies, out = right.column("body").to_pylist(), [arrow.empty_table()]
        for payload in left.column("payload"):
            own = Block(payload.as_buffer().to_pybytes(), length, gram)
            own.take(replies[:n], n)
            out.append(finish(own, own.removed(replies[n:])))
            del own
            B.release()
        return pa.concat_tables(out)

    first = held.mapInArrow(B.tidy(ask), sent).repartition(n, "range").groupBy("range").applyInArrow(merged(1, _how_often(hot)), back).repartition(n, "block")
    again = held.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(ask_again, sent)
    second = again.repartition(n, "range").groupBy("range").applyInArrow(merged(2, _merged(length, gram)), back).repartition(n, "block")
    return held.groupBy("block").cogroup(first.unionByName(second).groupBy("block")).applyInArrow(close, schema)


DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _digest(block: Block, gone: np.ndarray) -> pa.Table:
    rows = []
    for a, b in zip(block.at.tolist(), block.at[1:].tolist()):
        cut, text = gone[a:b], block.body[a:b]
        removed = int(cut.sum())
        spans = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum()) if removed else 0
        rows.append((b - a, removed, spans, hashlib.sha256((text[~cut] if removed else text).tobytes()).hexdigest()))
    columns = zip(*rows) if rows else ([], [], [], [])
    return pa.table([pa.array(block.doc, mask=~block.known), *(pa.array(c) for c in columns)], schema=_DIGESTS)


def removals(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every text, cut at byte exactness.

    Every byte covered by a string of ``length`` bytes that also starts elsewhere, in the same text or another,
    goes; matches don't cross texts and are judged on the input.  A null text is empty, texts shorter than ``length``
    are left whole, repeated rows are copies of each other and lose all that is long enough, a null id stays
    null, an empty table gives no rows, and columns other than doc_id and text are ignored.  ``block_bytes`` of text
    make a block of the exchange: it changes no result, only how many blocks there are and how much memory each takes.
    """
    payloads = documents.select("doc_id", "text").mapInArrow(B.tidy(_blocks(length, gram, [], block_bytes)), "block long, payload binary")
    return _exchange(payloads, length, gram, hot, _digest, DIGESTS, _DIGESTS)


def cut_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, block_bytes: int = BLOCK) -> DataFrame:
    """The documents with repeated strings cut out of ``text``, all other columns as they were.

    Like :func:`removals`, but a character goes only if all its bytes do, so texts stay valid; a null
    text becomes empty, and no row is dropped.
    """
    columns, arrow = documents.columns, to_arrow_schema(documents.schema)
    extra = [c for c in columns if c != "text"]

    def finish(block: Block, gone: np.ndarray) -> pa.Table:
        char = np.cumsum((block.body & 0xC0) != 0x80) - 1
        if len(char):
            gone = (np.bincount(char, weights=~gone) == 0)[char]
        texts = [block.body[a:b][~gone[a:b]].tobytes().decode("utf-8", "replace") for a, b in zip(block.at.tolist(), block.at[1:].tolist())]
        others = pa.ipc.open_stream(block.extra).read_all()
        return others.append_column("text", pa.array(texts, pa.string())).select(columns).cast(arrow)

    payloads = documents.mapInArrow(B.tidy(_blocks(length, gram, extra, block_bytes)), "block long, payload binary")
    return _exchange(payloads, length, gram, hot, finish, documents.schema, arrow)

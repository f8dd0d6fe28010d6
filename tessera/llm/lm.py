"""Language-model scoring with a weighted backoff automaton.

States are contexts (n-grams of at most order - 1 tokens that training has).  A state has an arc for each token seen
after it in training, weighted with the logarithm of its smoothed probability, and a failure arc to the state of the
next shorter context.  Smoothing is the hierarchical Dirichlet form

    p(w | h) = (c(hw) + K p(w | h')) / (c(h) + K),      p(w) = (c(w) + 1) / (N + V + 1)

with a K for each order, so a failure arc weighs K / (c(h) + K) and every state's distribution sums to one.  A text is
read once from left to right: the state is carried from token to token; where it has no arc for the token, failure arcs
are followed and their weights added until a state has one, which leads to the next state.

Counting covers every training text; counts of a block's n-grams come from the whole corpus by the block
exchange, so no task and no driver holds the model: a block holds the part that its own texts visit.  N-grams
are told apart by 64-bit hashes: of n distinct ones about n * n / 2 ** 65 pairs count as one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks as B

#: Tokens of an n-gram at most, and the weight of the shorter context, in tokens, at orders 2 and 3 (chosen on training rows).
ORDER, CONCENTRATION = 3, (1600.0, 5.0)
#: Texts that are read side by side; fewer are read one by one.
FEW = 24
END = B.mix(np.array([0x5F5E_3C2F_733E], dtype=np.uint64))[0]

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


class Grams:
    """The distinct n-grams of a block, order by order, each with its place in the token sequence."""

    def __init__(self, types: np.ndarray, ids: np.ndarray, lengths: np.ndarray, order: int):
        starts = np.cumsum(lengths) - lengths
        self.place = np.arange(len(ids)) - np.repeat(starts, lengths)
        self.starts, self.lengths = starts, lengths
        self.end = end = int(np.searchsorted(types, END))
        #: For each order: sorted hashes of the n-grams, and for each token the n-gram ending there (-1: none).
        self.hashes, self.at = [types], [ids.astype(np.int32)]
        before = np.empty(len(ids), np.int32)
        if len(ids):
            before[0], before[1:] = end, ids[:-1]
            before[starts] = end  # a text begins in the state after an end
        #: For each order above 1: for each token the n-gram of one order less that ends just before it.
        self.context = [None, before]
        for n in range(2, order + 1):
            if n > 2:
                before = np.concatenate((np.full(1, -1, np.int32), self.at[-1][:-1]))
                before[self.place < n - 2] = -1
                self.context.append(before)
            valid = before >= 0
            pairs, inverse = np.unique(before[valid].astype(np.int64) * len(types) + ids[valid], return_inverse=True)
            found = B.chain(self.hashes[-1][pairs // max(len(types), 1)], types[pairs % max(len(types), 1)]) if len(pairs) else np.zeros(0, np.uint64)
            by = np.argsort(found, kind="stable")
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            here = np.full(len(ids), -1, np.int32)
            here[valid] = rank[inverse]
            del pairs, inverse, rank, valid
            self.hashes.append(found[by])
            self.at.append(here)


def _blocks(train: str, limit: int):
    def run(batches):
        ordinal = 0
        held: list = []
        size = 0

        def block():
            nonlocal ordinal
            hashes = np.concatenate([h[2] for h in held])
            types, ids = np.unique(hashes, return_inverse=True)
            doc = pa.concat_arrays([h[0] for h in held])
            flags = np.concatenate([h[1] for h in held])
            lengths = np.concatenate([h[3] for h in held])
            known = doc.is_valid().to_numpy(zero_copy_only=False)
            payload = B.pack(doc.fill_null(0).to_numpy(), known, flags, B.small(lengths), B.deltas(types), B.small(ids))
            ordinal += 1
            return pa.record_batch({"block": pa.array([B.block_key(ordinal, payload)], pa.int64()), "payload": pa.array([payload], pa.binary())})

        for whole in batches:
            for batch in B.byte_slices(whole, limit=min(limit, B.SLICE_BYTES)):
                body, at = B.text_buffers(batch.column("text"))
                found, counts = B.words(body, at)
                ends = np.cumsum(counts)
                hashes = np.insert(found, ends, END)
                held.append((batch.column("doc_id").cast(pa.int64()), np.asarray(batch.column(train).fill_null(False).to_numpy(zero_copy_only=False), bool), hashes, counts + 1))
                size += len(body)
                if size >= limit:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    return run


def _open(payload: bytes):
    doc, known, train, lengths, types, ids = B.unpack(payload)
    return doc, known.astype(bool), train.astype(bool), lengths.astype(np.int64), B.undeltas(types), ids.astype(np.int32)


def _ask(order: int):
    def ask(payload: bytes, n: int) -> list[bytes]:
        _, _, train, lengths, types, ids = _open(payload)
        grams = Grams(types, ids, lengths, order)
        used = np.repeat(train, lengths)
        parts: list[list] = [[] for _ in range(n)]
        for hashes, at in zip(grams.hashes, grams.at):
            count = np.bincount(at[used & (at >= 0)], minlength=len(hashes))
            edges = B.ranges_of(hashes, n)
            for r in range(n):
                a, b = edges[r], edges[r + 1]
                parts[r] += [B.deltas(hashes[a:b]), B.small(count[a:b])]
        return [B.pack(*p) for p in parts]

    return ask


def _answer(order: int):
    def answer(requests: list[bytes]) -> list[bytes]:
        opened = [B.unpack(r) for r in requests]
        replies: list[list] = [[] for _ in requests]
        for n in range(order):
            sizes = [len(o[2 * n]) for o in opened]
            keys = np.concatenate([B.undeltas(o[2 * n]) for o in opened])
            _, inverse = np.unique(keys, return_inverse=True)
            total = np.bincount(inverse, weights=np.concatenate([o[2 * n + 1] for o in opened]).astype(np.float64)).astype(np.int64)
            for reply, here in zip(replies, np.split(total[inverse], np.cumsum(sizes)[:-1])):
                reply.append(B.small(here))
            if n == 0:
                stats = np.array([(total > 0).sum(), total.sum()], np.int64)
        return [B.pack(stats, *r) for r in replies]

    return answer


class BackoffAutomaton:
    """The states and arcs that a block's texts visit.

    An n-gram is the arc of its last token from the state of those before; one of fewer than ``order`` tokens is also a state.
    By order and n-gram: whether training has it, its arc's weight, its state's failure weight, and the n-gram
    without its first token (where a failure arc leads).
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], types: int, tokens: int, concentration: tuple[float, ...]):
        self.grams, self.order = grams, len(counts)
        self.seen = [c > 0 for c in counts]
        self.start = np.log10((counts[0] + 1) / (tokens + types + 1))
        self.arc, self.shorter = [self.start], [np.zeros(len(counts[0]), np.int64)]
        self.failure = [np.zeros(len(counts[0]))] * (self.order - 1)
        for n in range(1, self.order):
            k, here = concentration[n - 1], grams.at[n]
            at = np.flatnonzero(here >= 0)
            context, shorter = np.zeros(len(counts[n]), np.int32), np.zeros(len(counts[n]), np.int32)
            context[here[at]], shorter[here[at]] = grams.context[n][at], grams.at[n - 1][at]
            whole = counts[n - 1][context] + k if len(context) else np.zeros(0)
            self.arc.append(np.log10((counts[n] + k * 10.0 ** self.arc[n - 1][shorter]) / whole) if len(context) else whole)
            self.shorter.append(shorter)
            self.failure[n - 1] = np.log10(k / (counts[n - 1] + k))

    def _step(self, place, level, state):
        """From the states (``level`` tokens long) of some texts over the tokens at ``place``: weights, and the next states."""
        got, level, state = np.zeros(len(place)), level.copy(), state.copy()
        todo = np.arange(len(place))
        for n in range(self.order - 1, -1, -1):
            ready = level[todo] == n
            who, todo = todo[ready], todo[~ready]
            if not len(who):
                continue
            gram = self.grams.at[n][place[who]]
            has = gram >= 0
            has[has] = self.seen[n][gram[has]]
            if n:
                fails = who[~has]
                got[fails] += self.failure[n - 1][state[fails]]
                state[fails] = self.shorter[n - 1][state[fails]]
                level[fails] = n - 1
                todo = np.concatenate([todo, fails])
                who, gram = who[has], gram[has]
            got[who] += self.arc[n][gram]
            if n == self.order - 1 and n:
                level[who], state[who] = -n, self.shorter[n][gram]
            else:
                # done: written as a negative level until all are; an unknown token leads to the empty state
                known = has[has] if n else has
                level[who], state[who] = np.where(known & (self.order > 1), -n - 1, -self.order - 1), gram
        return got, np.where(level == -self.order - 1, 0, -level), state

    def _rest(self, first: int, end: int, level: int, state: int) -> float:
        """The same over the tokens of one text from ``first`` on."""
        rows = [a[first:end] for a in self.grams.at]
        seen = [np.where(r >= 0, s[r] if len(s) else False, False).tolist() for r, s in zip(rows, self.seen)]
        arcs = [np.where(r >= 0, a[r] if len(a) else 0.0, 0.0).tolist() for r, a in zip(rows, self.arc)]
        grams, top, total = [r.tolist() for r in rows], self.order - 1, 0.0
        for i in range(end - first):
            while level and not seen[level][i]:
                total += self.failure[level - 1][state]
                state = self.shorter[level - 1][state]
                level -= 1
            total += arcs[level][i]
            gram = grams[level][i]
            if level == top:
                state = self.shorter[level][gram]
            elif level or seen[0][i]:
                level, state = level + 1, gram
            else:
                state = 0
        return total

    def traverse(self) -> np.ndarray:
        """log10 probability of every text."""
        starts, lengths = self.grams.starts, self.grams.lengths
        by = np.argsort(-lengths, kind="stable")
        first, size, out = starts[by], lengths[by], np.zeros(len(lengths))
        end = int(self.grams.end)
        inside = self.order > 1 and end < len(self.seen[0]) and bool(self.seen[0][end])
        level, state = np.full(len(by), int(inside)), np.full(len(by), end if inside else 0)
        together = int(size[FEW - 1]) if len(size) >= FEW else 0
        for t in range(together):
            k = int(np.searchsorted(-size, -t, side="left"))
            got, level[:k], state[:k] = self._step(first[:k] + t, level[:k], state[:k])
            out[:k] += got
        for i in np.flatnonzero(size > together).tolist():
            out[i] += self._rest(int(first[i]) + together, int(first[i] + size[i]), int(level[i]), int(state[i]))
        back = np.empty(len(by))
        back[by] = out
        return back


def _finish(order: int, concentration: tuple[float, ...]):
    def finish(payload: bytes, replies: list[bytes]) -> pa.Table:
        doc, known, train, lengths, types, ids = _open(payload)
        grams = Grams(types, ids, lengths, order)
        opened = [B.unpack(r) for r in replies]
        n_types, n_tokens = (int(sum(o[0][i] for o in opened)) for i in (0, 1))
        counts = [np.concatenate([o[1 + n] for o in opened]).astype(np.int64) for n in range(order)]
        model = BackoffAutomaton(grams, counts, n_types, n_tokens, concentration)
        own = counts[0][ids]
        total = lambda x: np.add.reduceat(x, grams.starts) if len(x) else np.zeros(0)
        return pa.table([
            pa.array(doc, mask=~known), pa.array(~train), pa.array(lengths), pa.array(total((own > 0).astype(np.int64))),
            pa.array(np.full(len(doc), n_tokens)), pa.array(total(model.start[ids])), pa.array(model.traverse()),
        ], schema=_ARROW)

    return finish


def score(documents: DataFrame, train, order: int = ORDER, concentration: tuple[float, ...] = CONCENTRATION, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """Score every text with a model of the texts for which ``train`` (a boolean column) holds.

    A null text is empty (one end token), a null id stays null, repeated rows count and are scored each,
    an empty table gives no rows, columns other than doc_id and text are ignored, and a null ``train``
    leaves the row out of training.  Without training texts every token is equally likely.  ``concentration`` has
    K for orders 2, 3 and so on; its last one holds for all further orders.  ``block_bytes`` of text make a block of the
    exchange: it changes no result, only how many blocks there are and how much memory each takes.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    concentration = tuple(concentration[min(n, len(concentration) - 1)] for n in range(order - 1))
    docs = documents.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    payloads = docs.mapInArrow(B.tidy(_blocks("train", block_bytes)), "block long, payload binary")
    return B.block_exchange(payloads, _ask(order), _answer(order), _finish(order, concentration), SCORES, _ARROW)


def lm_scores(documents: DataFrame, folds: int = 7, fold: int = 2, **options) -> DataFrame:
    """Train on rows whose crc32(doc_id as text) mod ``folds`` is not ``fold``; score all rows, as :func:`score` does."""
    return score(documents, B.crc_of_id() % folds != fold, **options)

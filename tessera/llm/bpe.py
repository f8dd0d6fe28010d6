"""Byte-level BPE encoding with a hierarchical-bitmap rank queue, and decoding.

Each match of the pattern is encoded by itself.  Its bytes form a linked list; every adjacent pair that
has a rank waits in that rank's bucket, as the position of its left part.  Two levels of bitmaps say which
buckets hold something: find-first-set on each level gives the lowest rank at once, so a merge costs the
same however long the match is.  A position whose pair has changed since it was put down is stale and skipped.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache
from hashlib import sha256
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.blocks import tidy
from tessera.llm.token_counts import chunk_text, chunks_of

#: Encoded matches, and chunks of them, that a worker remembers at least (twice as many at most).
REMEMBERED = 250_000
#: Longer ones are encoded anew each time.
LONGEST = 200
IDS = "doc_id long, ids array<int>"
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


class RankQueue:
    """Buckets of positions (heaps: the leftmost first) by rank, under two levels of bitmaps.

    A bit of a word stands for a bucket, 256 to a word; a bit of the top word, which the encoder keeps,
    stands for a word.  Empty between two matches.
    """

    def __init__(self, ranks: int):
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.words = [0] * (ranks // 256 + 1)
        self.bit = [1 << i for i in range(max(256, len(self.words)))]


class Memory(dict):
    """Values of a function; those not asked for during the last REMEMBERED new ones are forgotten."""

    def __init__(self, function):
        super().__init__()
        self.function, self.older = function, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        if len(key) > LONGEST:
            return value
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value

    def shrink(self) -> None:
        """Forget the older half: the worker lives on after its task."""
        self.older = {}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.queue = RankQueue(len(self.bytes_of))
        self.matches = Memory(lambda m: array("I", self.merge(m.encode("utf-8"))).tobytes())
        self.chunks = Memory(lambda c: self._packed(chunk_text(c)))

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern.

        The queue's push and pop stand in line here: they run some dozen times for each word.
        """
        get, queue, n = self.ranks.get, self.queue, len(piece)
        if (whole := get(piece)) is not None:
            return [whole]
        buckets, words, bit, top = queue.buckets, queue.words, queue.bit, 0
        after, before = list(range(1, n + 1)), list(range(-1, n))
        waiting = [-1] * (n + 1)  # the rank under which a position waits now
        for at in range(n - 1):
            rank = get(piece[at : at + 2])
            if rank is not None:
                waiting[at] = rank
                if bucket := buckets[rank]:
                    bucket.append(at)  # positions come in order here
                else:
                    bucket.append(at)
                    words[rank >> 8] |= bit[rank & 255]
                    top |= bit[rank >> 8]
        while top:
            # the leftmost position of the lowest rank
            high = (top & -top).bit_length() - 1
            word = words[high]
            rank = high << 8 | ((word & -word).bit_length() - 1)
            bucket = buckets[rank]
            if len(bucket) > 1:
                at = heappop(bucket)
            else:
                at = bucket.pop()
                words[high] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            if waiting[at] != rank:
                continue  # stale
            gone = after[at]
            after[at] = end = after[gone]
            before[end] = at
            waiting[gone] = -1
            if end < n and (rank := get(piece[at : after[end]])) is not None:
                waiting[at] = rank
                if bucket := buckets[rank]:
                    heappush(bucket, at)
                else:
                    bucket.append(at)
                    words[rank >> 8] |= bit[rank & 255]
                    top |= bit[rank >> 8]
            else:
                waiting[at] = -1
            left = before[at]
            if left >= 0:
                rank = get(piece[left:end])
                if rank is None:
                    waiting[left] = -1
                elif waiting[left] != rank:
                    waiting[left] = rank
                    if bucket := buckets[rank]:
                        heappush(bucket, left)
                    else:
                        bucket.append(left)
                        words[rank >> 8] |= bit[rank & 255]
                        top |= bit[rank >> 8]
        out, at = [], 0
        while at < n:
            out.append(self.ranks[piece[at : after[at]]])
            at = after[at]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for m in self.find(text) for i in self.merge(m.encode("utf-8"))]

    def _packed(self, text: str) -> bytes:
        return b"".join([self.matches[m] for m in self.find(text)])

    def encode_packed(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers; chunks and matches met before are looked up."""
        found = chunks_of(text) if text else None
        if found is None:
            return self._packed(text)
        return b"".join(map(self.chunks.__getitem__, found))

    def decode(self, ids) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids])


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return Encoder(ranks, pattern)


def _encoded(batches, path: str, pattern: str):
    """(doc ids, packed ids of each row) of batches of (doc_id, text)."""
    own = encoder(path, pattern)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            some = batch.slice(at, 512)
            yield some.column("doc_id").cast(pa.int64()), [own.encode_packed(t.as_py() or "") for t in some.column("text")]


def _lists(packed: list[bytes]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed], dtype=np.int64)))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids of every text.

    A null text has no ids, a null id stays null, repeated rows are encoded each, an empty table gives
    no rows; columns other than doc_id and text are ignored.
    """

    def run(batches):
        for docs, packed in _encoded(batches, path, pattern):
            yield pa.record_batch([docs, _lists(packed)], schema=_IDS)

    return documents.select("doc_id", "text").mapInArrow(run, IDS)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes that its ids stand for; null ids give no bytes."""

    def run(batches):
        own = encoder(path, pattern)
        for batch in batches:
            out = [own.decode(ids.as_py() or []) for ids in batch.column("ids")]
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "body"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, body binary")


def round_trip(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every text, decode its ids, and return both digests, in one pass over the texts."""

    def run(batches):
        own = encoder(path, pattern)
        for docs, packed in _encoded(batches, path, pattern):
            counts = [len(p) // 4 for p in packed]
            shas = [sha256(p).hexdigest() for p in packed]
            back = [sha256(own.decode(np.frombuffer(p, "<u4").tolist())).hexdigest() for p in packed]
            yield pa.record_batch([docs, pa.array(counts, pa.int64()), pa.array(shas), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        own.chunks.shrink()
        own.matches.shrink()

    return documents.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

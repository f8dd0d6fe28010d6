"""Token counts without token ids.

Texts are cut into the tokenizer's own pre-tokens.  Each distinct pre-token of the corpus has its pieces
counted once (in the task that owns its key range); the count goes back to the blocks of documents in
which it occurs, is joined to each document's pre-token frequencies, and summed.  Ids are never kept.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import blocks as B

SCHEMA = "doc_id long, n_bytes long, n_tokens long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
#: White space for which a chunk between two spaces is not a run of whole pre-tokens by itself.
UNEVEN = re.compile(r"\s\s|\A\s|\s\Z|[^\S \n]")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    specials = [t.content for t in found.get_added_tokens_decoder().values()]
    return found, re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None


class Numbered(dict):
    """Keys numbered in order of appearance."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def chunks_of(text: str) -> list[str] | None:
    """A text's chunks, each a run of whole pre-tokens, or None if its white space is too uneven.

    A chunk is what stands between two single spaces (the space before it belongs to it but isn't
    written); one after a newline starts with it, and the text's first is marked by two spaces.
    """
    if UNEVEN.search(text):
        return None
    found = text.replace("\n", " \n").split(" ")
    found[0] = "  " + found[0]
    return found


def chunk_text(chunk: str) -> str:
    return chunk if chunk[0] == "\n" else chunk[2:] if chunk.startswith("  ") else " " + chunk


def _pre_tokens(splitter, text: str) -> list[str]:
    return [text[a:b] for _, (a, b) in splitter(text)]


def _encode_strings(strings: list[bytes] | list[str]) -> tuple[bytes, np.ndarray]:
    raw = [s.encode() for s in strings]
    return b"".join(raw), np.fromiter(map(len, raw), np.int64, len(raw))


def _blocks(path: str, limit: int):
    def run(batches):
        tokenizer, special = _tokenizer(path)
        splitter = tokenizer.pre_tokenizer.pre_tokenize_str
        ordinal = size = 0
        chunks, ids, lengths, docs, n_bytes, n_special, odd = Numbered(), [], [], [], [], [], []

        def block():
            nonlocal ordinal
            pre = Numbered()
            of_chunk = [[pre[p] for p in _pre_tokens(splitter, chunk_text(c))] for c in chunks]
            per = np.fromiter(map(len, of_chunk), np.int64, len(of_chunk))
            flat = np.fromiter((p for x in of_chunk for p in x), np.int64, int(per.sum()))
            del of_chunk
            seq = np.concatenate(ids) if ids else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(docs)), lengths)
            take, first = per[seq], (np.cumsum(per) - per)[seq]
            at = np.arange(int(take.sum())) - np.repeat(np.cumsum(take) - take, take) + np.repeat(first, take)
            keys = np.concatenate([np.repeat(owner, take) << 32 | flat[at], *(np.fromiter((d << 32 | pre[p] for p in c.elements()), np.int64) for d, c in odd)])
            del seq, owner, take, first, at
            # number the pre-tokens by hash
            body, widths = _encode_strings(list(pre))
            ends = np.cumsum(widths)
            hashes = np.concatenate([B.range_hashes(B.prefix_hashes(np.frombuffer(body, np.uint8)), ends - widths, ends), np.zeros(0, np.uint64)])
            by = np.argsort(hashes, kind="stable")
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            keys = (keys >> 32 << 32) | rank[keys & 0xFFFFFFFF]
            keys, freq = np.unique(keys, return_counts=True)
            names = list(pre)
            body, widths = _encode_strings([names[i] for i in by])
            doc = pa.array(docs, pa.int64())
            payload = B.pack(doc.fill_null(0).to_numpy(), doc.is_valid().to_numpy(zero_copy_only=False), B.small(np.array(n_bytes, np.int64)), B.small(np.array(n_special, np.int64)), B.deltas(keys), B.small(freq), B.deltas(hashes[by]), body, B.small(widths))
            ordinal += 1
            return pa.record_batch({"block": pa.array([B.block_key(ordinal, payload)], pa.int64()), "payload": pa.array([payload], pa.binary())})

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                segments = special.split(text) if special and special.search(text) else [text]
                row, own = len(docs), []
                for segment in segments:
                    if not segment:
                        continue
                    found = chunks_of(segment)
                    if found is None:
                        odd.append((row, Counter(_pre_tokens(splitter, segment))))
                    else:
                        own += map(chunks.__getitem__, found)
                docs.append(doc)
                n_bytes.append(len(text.encode()))
                n_special.append(len(segments) - 1)
                ids.append(np.array(own, np.int64))
                lengths.append(len(own))
                size += n_bytes[-1] + 64
                if size >= limit:
                    yield block()
                    chunks, ids, lengths, docs, n_bytes, n_special, odd, size = Numbered(), [], [], [], [], [], [], 0
        if docs:
            yield block()

    return run


def _ask(payload: bytes, n: int) -> list[bytes]:
    *_, hashes, body, widths = B.unpack(payload)
    edges, ends = B.ranges_of(B.undeltas(hashes), n), np.concatenate(([0], np.cumsum(widths, dtype=np.int64)))
    return [B.pack(body[ends[a] : ends[b]], widths[a:b]) for a, b in zip(edges, edges[1:])]


def _answer(path: str):
    def answer(requests: list[bytes]) -> list[bytes]:
        tokenizer, _ = _tokenizer(path)
        numbers, asked = Numbered(), []
        for request in requests:
            body, widths = B.unpack(request)
            ends = np.cumsum(widths, dtype=np.int64).tolist()
            asked.append([numbers[body[a:b]] for a, b in zip([0, *ends], ends)])
        distinct, pieces = [s.decode() for s in numbers], np.empty(len(numbers), np.int64)
        for at in range(0, len(distinct), 2048):
            some = tokenizer.encode_batch_fast(distinct[at : at + 2048], add_special_tokens=False)
            pieces[at : at + len(some)] = [len(x) for x in some]
        return [B.pack(B.small(pieces[np.array(x, np.int64)])) for x in asked]

    return answer


def _finish(payload: bytes, replies: list[bytes]) -> pa.Table:
    doc, known, n_bytes, n_special, keys, freq, *_ = B.unpack(payload)
    pieces = np.concatenate([B.unpack(r)[0] for r in replies]).astype(np.int64)
    keys = B.undeltas(keys)
    total = n_special.astype(np.int64)
    if len(keys):
        total = total + np.bincount(keys >> 32, weights=freq * pieces[keys & 0xFFFFFFFF], minlength=len(doc)).astype(np.int64)
    return pa.table([pa.array(doc, mask=~known.astype(bool)), pa.array(n_bytes.astype(np.int64)), pa.array(total)], schema=_ARROW)


def token_counts(documents: DataFrame, tokenizer_path: str, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every text, as the ``tokenizers`` file counts them.

    No begin, end or added tokens; special strings inside a text count one each, as is that library's
    default.  A null text is empty (0 and 0), a null id stays null, repeated rows are counted each, an
    empty table gives no rows, and columns other than doc_id and text are ignored.  ``block_bytes`` of text make a
    block of the exchange: it changes no result, only how many blocks there are and how much memory each takes.
    """
    payloads = documents.select("doc_id", "text").mapInArrow(B.tidy(_blocks(tokenizer_path, block_bytes)), "block long, payload binary")
    return B.block_exchange(payloads, _ask, _answer(tokenizer_path), _finish, SCHEMA, _ARROW)

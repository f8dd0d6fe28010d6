"""Indel similarities of strings (insertions and deletions only) as Arrow UDFs.

A longest common subsequence is found bit-parallel: a machine word, or a long integer, holds a column of the table.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for ch in b:
        hit = open_ & places.get(ch, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """0 to 100; two empty strings are alike."""
    total = len(a) + len(b)
    return 200.0 * common_subsequence(a, b) / total if total else 100.0


@lru_cache(maxsize=50_000)
def token_set_ratio(a: str, b: str) -> float:
    """0 to 100: likeness of the word sets, whatever their order and repeats.

    One set within the other counts 100; otherwise the best of comparing the common words with either
    side, and both sides with each other.
    """
    ours, theirs = set(a.split()), set(b.split())
    if not ours or not theirs:
        return 0.0
    both = " ".join(sorted(ours & theirs))
    x, y = " ".join(sorted(ours - theirs)), " ".join(sorted(theirs - ours))
    if both and (not x or not y):
        return 100.0
    gap = 1 if both else 0
    with_x, with_y = len(both) + gap + len(x), len(both) + gap + len(y)
    apart = len(x) + len(y) - 2 * common_subsequence(x, y)
    best = 100.0 - 100.0 * apart / (with_x + with_y)
    if both:
        for part, whole in ((x, with_x), (y, with_y)):
            best = max(best, 100.0 - 100.0 * (gap + len(part)) / (len(both) + whole))
    return best


@lru_cache(maxsize=50_000)
def partial_ratio(a: str, b: str) -> float:
    """0 to 100: the best likeness of the shorter string with any stretch of the longer one."""
    if not a or not b:
        return 100.0 if not a and not b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)

    def slide(short: str, long: str) -> float:
        n, m = len(short), len(long)
        edges = [long[:i] for i in range(1, n)] + [long[i:] for i in range(m - n + 1, m)]
        return max(indel_ratio(short, w) for w in {*(long[i : i + n] for i in range(m - n + 1)), *edges})

    best = slide(short, long)
    return max(best, slide(long, short)) if len(a) == len(b) and best < 100 else best


def _pairwise(function):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


def token_set_udf(a, b):
    """Column of :func:`token_set_ratio`; null if either is."""
    return F.pandas_udf(_pairwise(token_set_ratio), "double")(a, b)


def partial_udf(a, b):
    """Column of :func:`partial_ratio`; null if either is."""
    return F.pandas_udf(_pairwise(partial_ratio), "double")(a, b)

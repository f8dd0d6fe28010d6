"""Benchmark decontamination by template canonicalisation.

Words of benchmark items and documents become template tokens: numbers, names and units turn into typed
placeholders, other words stay, lower-cased and without the punctuation at their edges.  Windows of template
tokens (and, for copies in other capitals, of plain words) are a table, joined by hash with the windows of documents;
on each hit the alignment is stretched as far as tokens agree, and cut where a slot is inconsistent, i.e. where one
value of the item would stand for two of the document.  So a question whose numbers, names or units were changed
throughout is found as well as a verbatim copy.

Documents are read once, however large the benchmark.  A bitmap of the benchmark's window hashes, whose size is
fixed, keeps most windows of documents out of the join; which way the join goes is Spark's choice by size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks as B

#: Template tokens of a window, and of a reported match (or the whole item, if shorter).
WINDOW, MATCH = 8, 13
#: Tokens of a template match that must be words, not slots; exact matches need none.
LEAST_WORDS = 0.5
#: Items of fewer tokens are too common to look for as templates: they match exactly only.
SHORTEST = 4
#: Bits of a window's hash that the bitmap knows (16 MB).
BITS = 27
#: Items that a document meets at a time.
LOT = 256

# Words that are capitalised for their place only, number words, and units.
COMMON = """a about after all an and any are as at be before both but by can could did do does each every few find for
from given had has have he her his how i if in into is it its let many may more most much no not of on one or our over
she should since so some than that the their them then there these they this those to under until was we were what
when where which while who whose why will with would you your""".split()
NUMBERS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen
seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
dozen half quarter third twice""".split()
UNITS = """mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre
kilometres mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons ml l liter liters litre litres
gallon gallons cup cups second seconds minute minutes hour hours day days week weeks month months year years cent cents
dollar dollars euro euros usd eur mph kmh percent degree degrees celsius fahrenheit watt watts volt volts""".split()

_SPACE, _LOWER = B._SPACE, B._LOWER
_BYTE = np.arange(256)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_SOLID = _DIGIT | _UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_JOINT = np.zeros(256, bool)
_JOINT[[ord(c) for c in ".,:/-"]] = True
NUM, NAME, UNIT = (B.mix(np.array([seed], np.uint64))[0] for seed in (101, 102, 103))


def _listed(words: list[str]) -> np.ndarray:
    body = "".join(words).encode()
    ends = np.cumsum([len(w) for w in words])
    return np.sort(B.range_hashes(B.prefix_hashes(np.frombuffer(body, np.uint8)), ends - [len(w) for w in words], ends))


_COMMON, _NUMBERS, _UNITS = map(_listed, (COMMON, NUMBERS, UNITS))


def _among(found: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, found), len(ordered) - 1)] == found


def templates(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens and literal tokens (64-bit hashes) of the texts in a row, and where each text's begin."""
    n = len(body)
    solid = _SOLID[body]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    inside = ~_SPACE[body]
    before = np.append(True, ~inside[:-1])[:n]
    start = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.append(~inside[1:], True)[:n]
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    # to the first and past the last letter, digit or other byte of a word
    solids = np.flatnonzero(solid)
    first, last = np.searchsorted(solids, start), np.searchsorted(solids, end) - 1
    full = last >= first
    first, last = solids[first[full]], solids[last[full]]
    text_at = np.searchsorted(first, at)
    if not len(first):
        none = np.zeros(0, np.uint64)
        return none, none, text_at
    literal = B.range_hashes(B.prefix_hashes(_LOWER[body]), first, last + 1)
    count = lambda mask: (c := np.append(0, np.cumsum(mask)))[last + 1] - c[first]
    digits = count(_DIGIT[body])
    number = (_DIGIT[body[first]] & (digits + count(_JOINT[body]) == last + 1 - first)) | _among(literal, _NUMBERS)
    following = body[np.minimum(first + 1, n - 1)]
    capital = _UPPER[body[first]] | ((body[first] == 0xC3) & (following >= 0x80) & (following <= 0x9E))
    template = literal.copy()
    template[capital & ~_among(literal, _COMMON)] = NAME
    template[_among(literal, _UNITS)] = UNIT
    template[number] = NUM
    return template, literal, text_at


def window_hashes(template: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of ``width`` tokens, across texts; callers drop those that leave their text."""
    if len(template) < width:
        return np.zeros(0, np.uint64)
    out = template[: len(template) - width + 1]
    sums = np.append(np.uint64(0), np.cumsum(template * B.powers(B._MULT, len(template)), dtype=np.uint64))
    out = (sums[width:] - sums[:-width]) * B.powers(B._INVERSE, len(template))[: len(template) - width + 1]
    return B.mix(out + np.uint64(width))


def _runs(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Where runs of at least ``least`` true values begin and end."""
    cuts = np.flatnonzero(~same)
    return [(a, b) for a, b in zip((np.append(-1, cuts) + 1).tolist(), np.append(cuts, len(same)).tolist()) if b - a >= least]


def keyed(hashes: np.ndarray, width: int, plain: bool) -> np.ndarray:
    """Window hashes that tell widths and kinds apart."""
    return B.mix(hashes + np.uint64(2 * width + plain))


class Benchmark:
    """Some items' tokens and the places of their windows, by hash."""

    def __init__(self, ids: list[int], texts: list[str], window: int):
        self.ids = ids
        self.template, self.literal, self.at = templates(*B.text_buffers(pa.array(texts, pa.string())))
        self.slots = np.isin(self.template, np.array([NUM, NAME, UNIT]))
        lengths = np.diff(self.at)
        self.widths = sorted({min(window, int(n)) for n in lengths if n})
        #: By width, and whether windows are of literal tokens: sorted hashes, and their places.
        self.index: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}
        words = np.append(0, np.cumsum(~self.slots))
        for width, plain in ((w, p) for w in self.widths for p in (False, True)):
            hashes = window_hashes(self.literal if plain else self.template, width)
            item = np.repeat(np.arange(len(lengths)), lengths)[: len(hashes)]
            place = np.arange(len(hashes))
            good = (place + width <= self.at[item + 1]) & (np.minimum(window, lengths[item]) == width)
            if not plain:
                good &= (words[place + width] - words[place] >= LEAST_WORDS * width) & (lengths[item] >= SHORTEST)
            hashes, place = hashes[good], place[good]
            order = np.argsort(hashes, kind="stable")
            self.index[width, plain] = hashes[order], place[order]

    def hits(self, template: np.ndarray, literal: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among the documents' tokens and in the items of every window that both have."""
        there, here = [], []
        ends = np.repeat(text_at[1:], np.diff(text_at))
        for (width, plain), (hashes, place) in self.index.items():
            found = window_hashes(literal if plain else template, width)
            maybe = np.arange(len(found))
            maybe = maybe[maybe + width <= ends[: len(found)]]
            low, high = np.searchsorted(hashes, found[maybe], "left"), np.searchsorted(hashes, found[maybe], "right")
            many = high - low
            there.append(np.repeat(maybe, many))
            step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            here.append(place[np.repeat(low, many) + step])
        return (np.concatenate(there), np.concatenate(here)) if there else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def matches(self, template, literal, text_at, match: int):
        """(text, item, first token, end token, exact) of every consistent alignment that is long enough."""
        there, here = self.hits(template, literal, text_at)
        if not len(there):
            return
        text, item = np.searchsorted(text_at, there, side="right") - 1, np.searchsorted(self.at, here, side="right") - 1
        runs = np.unique(np.stack([text, item, there - here]), axis=1)
        for t, i, shift in runs.T.tolist():
            low = max(self.at[i], text_at[t] - shift)
            high = min(self.at[i + 1], text_at[t + 1] - shift)
            equal = self.literal[low:high] == literal[low + shift : high + shift]
            want, rows = min(match, int(self.at[i + 1] - self.at[i])), []
            if self.at[i + 1] - self.at[i] >= SHORTEST:
                for a, b in _runs(equal | (self.template[low:high] == template[low + shift : high + shift]), want):
                    rows += self._consistent(t, i, int(low + a), int(low + b), shift, text_at[t], literal, want)
            yield from rows
            for a, b in _runs(equal, want):  # what is equal counts by itself, unless it is part of a row
                first, end = int(low + a + shift - text_at[t]), int(low + b + shift - text_at[t])
                if not any(r[2] <= first and end <= r[3] for r in rows):
                    yield t, i, first, end, True

    def _consistent(self, t, i, low, high, shift, base, literal, want):
        ours, theirs, slots = self.literal[low:high].tolist(), literal[low + shift : high + shift].tolist(), self.slots[low:high]
        start, stand_for = 0, {}
        for k in range(high - low + 1):
            if k < high - low and (not slots[k] or stand_for.setdefault((ours[k]), theirs[k]) == theirs[k]):
                continue
            words = int((~slots[start:k]).sum())
            if k - start >= want and words >= LEAST_WORDS * (k - start):
                yield t, i, low + start + shift - int(base), low + k + shift - int(base), ours[start:k] == theirs[start:k]
            start, stand_for = k, {ours[k]: theirs[k]} if k < high - low and slots[k] else {}


FOUND = "doc_id long, item_id long, first_word long, end_word long, n_words long, exact boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("n_words", pa.int64()), ("exact", pa.bool_())])


_WINDOW = "hash long, kind int, item long"


def _windows(window: int):
    """The benchmark's windows: hash, kind (twice the width, one more for plain words), item."""

    def run(batches):
        for batch in batches:
            items = batch.column("item").to_numpy()
            part = Benchmark(items.tolist(), batch.column("text").to_pylist(), window)
            for (width, plain), (hashes, place) in part.index.items():
                item = items[np.searchsorted(part.at, place, side="right") - 1]
                kind = np.full(len(place), 2 * width + plain, np.int32)
                yield pa.record_batch([pa.array(keyed(hashes, width, plain).view(np.int64)), pa.array(kind), pa.array(item)], names=["hash", "kind", "item"])

    return run


def _bitmap(windows: DataFrame) -> np.ndarray:
    """The leading BITS bits of all window hashes, as bits; 2 ** BITS of them whatever the benchmark's size."""
    place = F.shiftrightunsigned("hash", 64 - BITS) + 1  # Spark counts buckets from 1
    lots = windows.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("lot")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros(1 << BITS >> 3, np.uint8)
    for row in lots.toLocalIterator():
        at = (row["lot"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def _sieve(kinds: list[int], held):
    """Documents with windows that the benchmark may have: doc_id, text, and those windows' hashes."""

    def run(batches):
        bits = held.value
        for whole in batches:
            for batch in B.byte_slices(whole):
                template, literal, text_at = templates(*B.text_buffers(batch.column("text")))
                ends = np.repeat(text_at[1:], np.diff(text_at))
                texts, hashes = [], []
                for kind in kinds:
                    width, plain = divmod(kind, 2)
                    found = keyed(window_hashes(literal if plain else template, width), width, bool(plain))
                    place = (found >> np.uint64(64 - BITS)).astype(np.int64)
                    maybe = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                    maybe = maybe[maybe + width <= ends[maybe]] if len(maybe) else maybe
                    texts.append(np.searchsorted(text_at, maybe, side="right") - 1)
                    hashes.append(found[maybe])
                text, found = np.concatenate(texts), np.concatenate(hashes)
                if len(text):
                    order = np.lexsort((found, text))
                    text, found = text[order], found[order]
                    new = np.append(True, (text[1:] != text[:-1]) | (found[1:] != found[:-1]))
                    text, found = text[new], found[new]
                    rows, first = np.unique(text, return_index=True)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(text)).astype(np.int32)), pa.array(found.view(np.int64)))
                    some = pa.array(rows)
                    yield pa.record_batch([batch.column("doc_id").cast(pa.int64()).take(some), batch.column("text").cast(pa.string()).take(some), lists], names=["doc_id", "text", "hashes"])

    return run


def _verify(match: int, window: int):
    """Matches of each document (doc_id, text) with the items that it shares windows with."""

    def run(batches):
        for whole in batches:
            for batch in B.byte_slices(whole):
                lists = batch.column("items").to_pylist()
                known = {i["item"]: i for items in lists for i in items}
                place = {item: at for at, item in enumerate(known)}
                part = Benchmark([i["item_id"] for i in known.values()], [i["text"] for i in known.values()], window)
                asked = [{place[i["item"]] for i in items} for items in lists]
                docs = batch.column("doc_id").to_pylist()
                rows = [r for r in part.matches(*templates(*B.text_buffers(batch.column("text"))), match) if r[1] in asked[r[0]]]
                if rows:
                    t, i, a, b, exact = zip(*rows)
                    yield pa.record_batch([pa.array([docs[x] for x in t], pa.int64()), pa.array([part.ids[x] for x in i], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.subtract(b, a), pa.int64()), pa.array(exact)], schema=_ARROW)

    return run


def contaminated(documents: DataFrame, benchmark: DataFrame, match: int = MATCH, window: int = WINDOW) -> DataFrame:
    """Where documents hold benchmark items: doc_id, item_id, first_word, end_word (words counted from 0), n_words, exact.

    A match is at least ``match`` aligned tokens, or the whole item if it is shorter: equal ones of any kind, or
    template tokens of which at least half are words; ``window`` of them (or the whole item) have to agree throughout
    as plain words, or as template tokens, for the alignment to be looked at.  Items of fewer than SHORTEST tokens have to be equal.
    Clean documents have no row.  Null and empty texts on either side match nothing, a null item or document id is
    reported as null, repeated items and rows are reported each, an empty table on either side gives no rows;
    other columns are ignored.
    """
    spark = documents.sparkSession
    items = benchmark.filter(F.length("text") > 0).select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    items = B.cut(items)
    windows = B.cut(items.select("item", "text").mapInArrow(_windows(window), _WINDOW))
    kinds = sorted(r["kind"] for r in windows.select("kind").distinct().collect())
    docs = documents.select("doc_id", "text")
    if not kinds:
        return docs.limit(0).mapInArrow(lambda batches: iter(()), FOUND)
    held = spark.sparkContext.broadcast(_bitmap(windows))
    sieved = docs.mapInArrow(B.tidy(_sieve(kinds, held)), "doc_id long, text string, hashes array<long>")
    sieved = B.cut(sieved.withColumn("row", F.monotonically_increasing_id()))
    hits = sieved.select("row", F.explode("hashes").alias("hash")).join(windows.select("hash", "item"), "hash").select("row", "item").distinct()
    # a document meets its items in lots of bounded size, so none has to hold all that share a window with it
    named = hits.join(items, "item").groupBy("row", F.pmod(F.xxhash64("item"), F.ceil(F.lit(items.count() / LOT)).cast("int")).alias("lot"))
    lists = named.agg(F.collect_list(F.struct("item", "item_id", "text")).alias("items"))
    return sieved.select("row", "doc_id", "text").join(lists, "row").select("doc_id", "text", "items").mapInArrow(B.tidy(_verify(match, window)), FOUND)


def clean_documents(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a match; rows with a null id are kept, as no match can name them."""
    bad = contaminated(documents, benchmark, **options).select("doc_id").distinct()
    return documents.join(bad, "doc_id", "left_anti")

"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Strings are a sentence's units: words reduced to their letters (punctuation between them drops out, letters
written apart join up, and two short pieces side by side are one more unit), longer ones as overlapping windows.  The kernel counts common subsequences of
four letters that span at most six, each weighted by DECAY for every letter it skips and divided by both strings' norms
(a string's kernel with itself is 1), so an insult with
gaps or inserted letters stays near the insult.  With landmarks l and the normalised kernel k, a string's
features are k(s, L) K_LL^(-1/2); a squared-hinge linear machine on them scores

    f(s) = sum over l of a_l k(s, l) + b,

and since k is an inner product of subsequence counts, the sum over landmarks folds into one weight for each
subsequence: scoring a string costs one look-up a subsequence.  Labels are per document, so training alternates:
the worst-scored units of toxic documents are the positive strings, units of clean ones (the worst-scored of
each, and others at random) the negative ones.  A document's score is a logistic function of its worst unit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks as B

LENGTH, SPAN, DECAY = 4, 6, 0.5
WINDOW, STEP = 16, 8
LANDMARKS = 256
#: At most so many labelled documents of either kind, of at most so many bytes, are learnt from.
TRAINING_ROWS, TRAINING_BYTES = 1500, 16_384
ROUNDS, COST = 5, 4.0
#: What the worst-scored units of clean texts weigh against others, and clean units in all against toxic ones.
HARD, CAUTION = 5.0, 4.0
#: Toxic texts that a positive string has to be in, by how many there are at least.
SUPPORT = ((3, 100), (2, 20))

_CODE = np.zeros(256, np.uint8)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_CODE[48:58] = np.arange(27, 37)
_CODE[128:192] = 37 + np.arange(64) % 27
#: Slots for subsequences: four 6-bit letters, hashed.
SLOTS = 1 << 21
_SHAPES = [(0, *rest) for rest in combinations(range(1, SPAN), LENGTH - 1)]


def units(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of the texts in a row; and each unit's start among them, its length, and its text."""
    code = _CODE[body]
    space = B._SPACE[body].astype(np.int64)
    space[at[:-1][at[:-1] < len(body)]] += 1
    word = np.cumsum(space)
    kept = np.flatnonzero(code)
    letters, word = code[kept], word[kept]
    if not len(kept):
        none = np.zeros(0, np.int64)
        return letters, none, none, none
    start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    text = np.searchsorted(at, kept[start], side="right") - 1
    size = np.diff(np.append(start, len(letters)))
    # letters written apart are one unit
    apart = (size[1:] == 1) & (size[:-1] == 1) & (text[1:] == text[:-1])
    first = np.append(True, ~apart)
    joined = np.add.reduceat(~first, np.flatnonzero(first)) > 0
    start, text = start[first], text[first]
    size = np.diff(np.append(start, len(letters)))
    # a word of one letter before or after joins too: with and without it
    for skip, drop in ((1, 1), (0, 1), (1, 2)):
        start, text, size = (np.concatenate(x) for x in ((start, start[: len(joined)][joined] + skip), (text, text[: len(joined)][joined]), (size, size[: len(joined)][joined] - drop)))
    # two short pieces side by side may be one word: both together are one more unit
    pair = np.flatnonzero((text[1 : len(joined)] == text[: len(joined) - 1]) & (np.maximum(size[1 : len(joined)], size[: len(joined) - 1]) < LENGTH))
    start, text, size = (np.concatenate(x) for x in ((start, start[pair]), (text, text[pair]), (size, size[pair] + size[pair + 1])))
    long = size > WINDOW
    if long.any():
        pieces = np.where(long, -(-(size - WINDOW) // STEP) + 1, 1)
        own = np.repeat(np.arange(len(size)), pieces)
        step = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        offset = np.minimum(step * STEP, np.maximum(size[own] - WINDOW, 0))
        start, size, text = start[own] + offset, np.minimum(size[own], WINDOW), text[own]
    good = size >= LENGTH
    return letters, start[good], size[good], text[good]


def subsequences(letters: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each shape of subsequence: the strings that have one, its code, and its weight."""
    own = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
    flat = letters[np.repeat(start, size) + place].astype(np.int32)
    left = size[own] - place
    for shape in _SHAPES:
        here = np.flatnonzero(left > shape[-1])
        code = flat[here]
        for offset in shape[1:]:
            code = code << 6 | flat[here + offset]
        code = ((code.astype(np.int64) * 0x9E3779B1) & 0xFFFFFFFF) >> 11
        yield own[here], code, DECAY ** (shape[-1] + 1 - LENGTH)


#: Strings whose subsequences are listed at a time.
STRINGS = 16_384


def _norms(parts: list[tuple[np.ndarray, np.ndarray, float]], n: int) -> np.ndarray:
    """Each string's norm: its own kernel with itself, equal subsequences added up first."""
    key = np.concatenate([own << 21 | code for own, code, _ in parts]) if parts else np.zeros(0, np.int64)
    weight = np.concatenate([np.full(len(own), w) for own, _, w in parts]) if parts else np.zeros(0)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    sums = np.add.reduceat(weight, first) if len(first) else weight
    return np.sqrt(np.maximum(np.bincount(key[first] >> 21, weights=sums * sums, minlength=n), 1e-9))


def scores(weights: np.ndarray, bias: float, letters, start, size) -> np.ndarray:
    out = np.zeros(len(size))
    for at in range(0, len(size), STRINGS):
        some = slice(at, at + STRINGS)
        parts = list(subsequences(letters, start[some], size[some]))
        for own, code, weight in parts:
            out[some] += weight * np.bincount(own, weights=weights[code], minlength=len(size[some]))
        out[some] /= _norms(parts, len(size[some]))
    return out + bias


class Strings:
    """Distinct strings with their sparse subsequence vectors."""

    def __init__(self, letters, start, size):
        self.letters, self.start, self.size = letters, start, size

    def __len__(self):
        return len(self.size)

    def norms(self) -> np.ndarray:
        parts = [_norms(list(subsequences(self.letters, self.start[at : at + STRINGS], self.size[at : at + STRINGS])), len(self.size[at : at + STRINGS])) for at in range(0, len(self), STRINGS)]
        return np.concatenate([np.zeros(0), *parts])

    def take(self, rows) -> Strings:
        return Strings(self.letters, self.start[rows], self.size[rows])

    def kernel(self, landmarks: Strings) -> np.ndarray:
        """The normalised kernel of every string with every landmark."""
        m = len(landmarks)
        codes = np.unique(np.concatenate([c for _, c, _ in subsequences(landmarks.letters, landmarks.start, landmarks.size)]))
        slot = np.full(SLOTS, -1, np.int32)
        slot[codes] = np.arange(len(codes))
        table = np.zeros((len(codes), m), np.float32)
        for own, code, weight in subsequences(landmarks.letters, landmarks.start, landmarks.size):
            np.add.at(table, (slot[code], own), weight)
        out = np.zeros((len(self), m), np.float32)
        for at in range(0, len(self), 4096):
            some = self.take(slice(at, at + 4096))
            part = np.zeros((len(some), m), np.float32)
            for own, code, weight in subsequences(some.letters, some.start, some.size):
                hit = slot[code] >= 0
                if hit.any():
                    rows, sums = own[hit], table[slot[code[hit]]] * np.float32(weight)
                    edge = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
                    part[rows[edge]] += np.add.reduceat(sums, edge, axis=0)
            out[at : at + len(some)] = part
        return out / self.norms()[:, None] / landmarks.norms()[None, :]


def _linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Squared-hinge weights (the last is the bias) by Newton steps on the violated rows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.ones(x.shape[1])
    ridge[-1] = 1e-3

    def loss(w):
        slack = np.maximum(0, 1 - y * (x @ w))
        return 0.5 * (ridge * w * w).sum() + COST * (weight * slack**2).sum()

    for _ in range(25):
        bad = y * (x @ w) < 1
        xs, c = x[bad], 2 * COST * weight[bad]
        gradient = ridge * w - xs.T @ (c * (y[bad] - xs @ w))
        step = np.linalg.solve(np.diag(ridge) + xs.T @ (xs * c[:, None]), gradient)
        size, before = 1.0, loss(w)
        while loss(w - size * step) > before and size > 1e-4:
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logistic(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Platt's sigmoid of a text's worst score: slope and offset, on smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.stack([z, np.ones(len(z))], axis=1), np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + 1e-3 * np.eye(2), x.T @ (p - goal) + 1e-3 * w)
        w = w - np.clip(step, -2, 2)
    return np.array([max(w[0], 1e-3), w[1]])


def _worst_scores(text: np.ndarray, found: np.ndarray, n: int, bias: float) -> np.ndarray:
    """The highest score of each of ``n`` texts; at least ``bias``, a string's score without any subsequence."""
    out = np.full(n, bias)
    np.maximum.at(out, text, found)
    return out


def _sigmoid(z: np.ndarray, slopes: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slopes[0] * z + slopes[1], -30, 30)))


class Model:
    """Weights of subsequences, the bias, and the sigmoid; ``constant`` is the score without a machine."""

    def __init__(self, codes, weights, bias, slopes, constant=None):
        self.codes, self.weights, self.bias, self.slopes, self.constant = codes, weights, bias, slopes, constant

    def table(self) -> np.ndarray:
        out = np.zeros(SLOTS)
        out[self.codes] = self.weights
        return out


def fit(texts: list[str], labels: list[int], seed: int = 8) -> Model:
    """Learn from texts labelled 0 or 1; with one kind only, every score is that kind's smoothed rate."""
    y = np.array(labels, int)
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.0) / (len(y) + 1) if len(y) else 0.0
        return Model(np.zeros(0, int), np.zeros(0), 0.0, np.array([1.0, 0.0]), float(rate))
    rng = np.random.default_rng(seed)
    letters, start, size, text = units(*B.text_buffers(pa.array(texts, pa.string())))
    hashes = B.range_hashes(B.prefix_hashes(letters), start, start + size)
    _, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    pool = Strings(letters, start[index], size[index])
    text_of, pairs = text, np.unique(text.astype(np.int64) << 32 | inverse)
    text, unit = pairs >> 32, pairs & 0xFFFFFFFF
    if not len(pool):
        return Model(np.zeros(0, int), np.zeros(0), 0.0, np.array([1.0, 0.0]), float(y.mean()))
    toxic_texts, clean_texts = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    # first suspicion: log odds of a subsequence in toxic against clean texts
    seen = np.zeros((2, SLOTS), np.float32)
    often = [np.bincount(unit[y[text] == kind], minlength=len(pool)).astype(np.float32) for kind in (0, 1)]
    for at in range(0, len(pool), STRINGS):
        for own, code, weight in subsequences(pool.letters, pool.start[at : at + STRINGS], pool.size[at : at + STRINGS]):
            for kind in (0, 1):
                np.add.at(seen[kind], code, np.float32(weight) * often[kind][at + own])
    odds = np.log((seen[1] + 1) / (seen[0] * np.float32(len(toxic_texts) / len(clean_texts)) + 1))
    del seen, often
    found = scores(odds, 0.0, pool.letters, pool.start, pool.size) / pool.norms()
    worst = lambda n: _worst(text, unit, found, n)
    frequent = np.bincount(unit, minlength=len(pool))
    support = next((k for k, n in SUPPORT if len(toxic_texts) >= n), 1)
    machine = None
    for turn in range(ROUNDS):
        top_text, top_unit = worst(3 if turn == 0 else 2)
        is_toxic = y[top_text] == 1
        lifted = is_toxic & (found[top_unit] >= (0 if turn == 0 else np.minimum(0.0, found[top_unit].max())))
        positive = np.unique(top_unit[lifted]) if lifted.any() else np.unique(top_unit[is_toxic])
        in_clean = np.zeros(len(pool), bool)
        in_clean[unit[y[text] == 0]] = True
        positive = positive[~in_clean[positive]] if (~in_clean[positive]).any() else positive
        # what only a text or two have says little about them: labels are wrong now and then
        often = frequent[positive] >= support
        positive = positive[often] if often.any() else positive
        clean = np.flatnonzero(in_clean)
        clean = clean[~np.isin(clean, positive)]
        hard = np.unique(top_unit[~is_toxic])
        hard = hard[~np.isin(hard, positive)]
        negative = np.union1d(hard, rng.choice(clean, min(len(clean), 3000), replace=False)) if len(clean) else hard
        positive = positive[np.argsort(-frequent[positive], kind="stable")][:3000]
        if not len(negative):
            negative = np.array([int(np.argmin(found))])
        marks = np.union1d(positive[: LANDMARKS // 2], rng.choice(negative, min(len(negative), LANDMARKS // 2), replace=False))
        landmarks, rows = pool.take(marks), np.concatenate([positive, negative])
        values, vectors = np.linalg.eigh(landmarks.kernel(landmarks).astype(float))
        keep = values > 1e-5 * values.max()
        whiten = vectors[:, keep] / np.sqrt(values[keep])
        often = np.minimum(frequent[rows], 50).astype(float)
        x = pool.take(rows).kernel(landmarks).astype(float) @ whiten
        sign = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        often[np.isin(rows, hard) & (sign < 0)] *= HARD
        for kind, share in ((1, 1.0), (-1, CAUTION)):
            often[sign == kind] *= share * len(sign) / 2 / often[sign == kind].sum()
        w = _linear_svm(x, sign, often)
        alpha, bias = whiten @ w[:-1], float(w[-1])
        table, norms = np.zeros(SLOTS), landmarks.norms()
        for own, code, weight in subsequences(landmarks.letters, landmarks.start, landmarks.size):
            np.add.at(table, code, weight * (alpha / norms)[own])
        machine = table, bias
        found = scores(table, bias, pool.letters, pool.start, pool.size)
    table, bias = machine
    z = _worst_scores(text_of, found[inverse], len(y), bias)
    codes = np.flatnonzero(table)
    return Model(codes, table[codes], bias, _logistic(z, y))


def _worst(text: np.ndarray, unit: np.ndarray, found: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ``n`` units of the highest score."""
    order = np.lexsort((-found[unit], text))
    text, unit = text[order], unit[order]
    first = np.searchsorted(text, text, side="left")
    top = np.arange(len(text)) - first < n
    return text[top], unit[top]


def _score(model: Model):
    def run(batches):
        table = model.table()
        known, values = np.zeros(0, np.uint64), np.zeros(0)
        for whole in batches:
            for batch in B.byte_slices(whole):
                body, at = B.text_buffers(batch.column("text"))
                z = np.full(batch.num_rows, model.bias)
                if model.constant is None:
                    letters, start, size, text = units(body, at)
                    if len(start):
                        hashes, index, inverse = np.unique(B.range_hashes(B.prefix_hashes(letters), start, start + size), return_index=True, return_inverse=True)
                        got = np.empty(len(hashes))
                        place = np.searchsorted(known, hashes)
                        have = np.zeros(len(hashes), bool)
                        if len(known):
                            have = known[np.minimum(place, len(known) - 1)] == hashes
                            got[have] = values[place[have]]
                        new = np.flatnonzero(~have)
                        got[new] = scores(table, model.bias, letters, start[index[new]], size[index[new]])
                        if len(known) > 2_000_000:
                            known, values = np.zeros(0, np.uint64), np.zeros(0)
                            place = np.zeros(len(hashes), np.int64)
                        known, values = np.insert(known, place[new], hashes[new]), np.insert(values, place[new], got[new])
                        z = _worst_scores(text, got[inverse], batch.num_rows, model.bias)
                    score = _sigmoid(z, model.slopes)
                else:
                    score = np.full(batch.num_rows, model.constant)
                yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(score)], names=["doc_id", "score"])

    return run


def training_rows(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, longest: int = TRAINING_BYTES) -> DataFrame:
    """The bounded sample: of each label the ``rows`` documents, of ``longest`` bytes at most, whose ids have the smallest hashes."""
    named = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fits = documents.filter(F.octet_length("text") <= longest).select("doc_id", "text")
    known = fits.select("doc_id").distinct().join(named, "doc_id")
    some = [known.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for kind in (0, 1)]
    found = fits.join(F.broadcast(some[0].unionByName(some[1])), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def toxicity(documents: DataFrame, labels: DataFrame, training_documents: DataFrame | None = None, rows: int = TRAINING_ROWS, longest: int = TRAINING_BYTES) -> DataFrame:
    """doc_id and score (0 to 1, higher: toxic likelier) of every text.

    The model is learnt from ``labels`` (doc_id, toxic) and their texts in ``training_documents`` (by default
    ``documents``): at most ``rows`` of either label, of ``longest`` bytes at most.  A document labelled twice counts as toxic if once so
    labelled; null labels, ids and texts aren't learnt from.  Null and empty texts are scored as texts without
    a suspicious unit, null ids stay null, repeated rows are scored each, an empty table gives no rows, other
    columns are ignored; with labels of one kind only, every score is the same.
    """
    sample = training_rows(documents if training_documents is None else training_documents, labels, rows, longest).toPandas()
    sample = sample.sort_values("doc_id")
    kinds = [sample[sample.toxic == kind].head(rows) for kind in (0, 1)]
    model = fit([t for k in kinds for t in k.text], [int(t) for k in kinds for t in k.toxic])
    del sample, kinds
    B.release()
    return documents.select("doc_id", "text").mapInArrow(B.tidy(_score(model)), "doc_id long, score double")

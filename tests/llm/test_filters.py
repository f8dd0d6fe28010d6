"""Decontamination, toxicity and WARC derivatives."""

import gzip
import math
import random
import re
from collections import Counter
from html.parser import HTMLParser
from itertools import combinations

import pyarrow as pa
import pytest
from helpers import documents

from tessera.llm import decontaminate, toxicity, warc

QUESTION = "Alice has 12 apples and buys 5 kg more from Bob at the market, then Alice sells all of them for 3 dollars each. How much money does she make?"


def found(spark, texts, items, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, bench, **options).collect()}


def test_reparameterised_questions(spark):
    changed = QUESTION.replace("Alice", "Carol").replace("Bob", "Dave").replace("12", "7").replace("dollars", "euros")
    inconsistent = QUESTION.replace("Alice has", "Carol has").replace("then Alice", "then Eve")
    texts = [f"before {QUESTION} after", f"x {changed}", inconsistent, QUESTION.upper(), QUESTION.lower(), "Alice has 12 apples and buys 5 kg more", None, "", QUESTION.replace("market", "shop")]
    got = found(spark, texts, [QUESTION, None, "", "two words", "a much shorter item of seven"])
    assert got[0, 0]["exact"] and (got[0, 0]["first_word"], got[0, 0]["n_words"]) == (1, 30)
    assert not got[1, 0]["exact"] and got[1, 0]["n_words"] == 30
    assert (3, 0) in got and (4, 0) in got and (5, 0) not in got and (6, 0) not in got
    # a slot that stands for two values cuts the match; what is left on either side counts by itself
    assert all(r["n_words"] < 30 for key, r in got.items() if key[0] == 2)
    assert {key for key in got if key[1] != 0} == set()


def test_short_items_parts_and_columns(spark):
    item = "a much shorter item of seven"
    got = found(spark, [f"see {item} here", "a much shorter item"], [item, QUESTION])
    assert set(got) == {(0, 0)}
    docs = documents(spark, extra=True)
    bench = spark.createDataFrame([(1, "the benchmark item that no document has at all, not even nearly")], "item_id long, text string")
    assert decontaminate.contaminated(docs, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.clean_documents(docs, bench).count() == docs.count()


def test_exact_copies_need_no_words(spark):
    table = "12 15 18 21 24 27 30 33 36 39 42 45 48 51 54 57"
    names = "Ada Berg, Carl Dorn, Eva Falk, Gert Holm, Ida Jung, Kurt Lind, Mona Nord, Olaf Prag"
    short, one = "SUM 7 9 16", "漢字漢字"
    other = table.replace("12", "13").replace("30", "31")  # fewer than 13 equal numbers in a row
    texts = [f"see {table} there", f"list {names} end", f"so {short} is", f"a {one} b", other, "Ada Berg, Carl Dorn", "SUM 8 9 16", f"x {table[6:]} y", "漢字"]
    got = found(spark, texts, [table, names, short, one])
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 3), (7, 0)} and all(r["exact"] for r in got.values())
    assert (got[0, 0]["first_word"], got[0, 0]["n_words"], got[7, 0]["n_words"], got[3, 3]["n_words"]) == (1, 16, 14, 1)
    # equal words count by themselves where a slot that stands for two values cuts the template match
    item = "5 cats 1 2 3 4 6 7 8 5 9 10 11 12 13 14 15 16"
    assert found(spark, [item.replace("5 cats", "4 cats")], [item])[0, 0]["n_words"] >= 13


def test_matches_agree_with_substrings(spark):
    rnd = random.Random(2)
    vocabulary = [f"{a}{b}" for a in "bcdfgh" for b in "aeiou"]
    items = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(14, 25))) for _ in range(15)]
    texts = []
    for i in range(80):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))]
        if i % 4 == 0:
            words[len(words) // 2 : len(words) // 2] = rnd.choice(items).split()
        texts.append(" ".join(words))
    got = {d for d, _ in found(spark, texts, items)}
    assert got == {i for i, t in enumerate(texts) if any(f" {x} " in f" {t} " for x in items)}


def slow_tokens(text):
    """(template, literal) of every word that has a letter or digit, by plain rules."""
    out = []
    for word in re.findall(r"[^\x20\x09-\x0D]+", text):
        core = re.search(r"[0-9A-Za-z\x80-\U0010ffff].*", word, re.S)
        if not core:
            continue
        core = re.search(r".*[0-9A-Za-z\x80-\U0010ffff]", core[0], re.S)[0]
        low = core.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        if re.fullmatch(r"[0-9][0-9.,:/-]*", core) or low in decontaminate.NUMBERS:
            kind = "#NUM"
        elif low in decontaminate.UNITS:
            kind = "#UNIT"
        elif re.match(r"[A-ZÀ-Þ]", core) and low not in decontaminate.COMMON:
            kind = "#NAME"
        else:
            kind = low
        out.append((kind, low))
    return out


def slow_pairs(texts, items, match=13, least=4):
    """(text, item) pairs with a run of equal words, or of consistent tokens, equal or of one template, at least half of which are words."""

    def good(run, want):
        start, seen = 0, {}
        for k in range(len(run) + 1):
            if k < len(run):
                (kind, ours), (_, theirs) = run[k]
                if kind[0] != "#" or seen.setdefault(ours, theirs) == theirs:
                    continue
            words = sum(kind[0] != "#" for (kind, _), _ in run[start:k])
            if k - start >= want and 2 * words >= k - start:
                return True
            start, seen = k, {}
            if k < len(run) and run[k][0][0][0] == "#":
                seen = {run[k][0][1]: run[k][1][1]}
        return False

    def runs(pairs, same):
        run = []
        for p in [*pairs, None]:
            if p is not None and same(p):
                run.append(p)
            else:
                yield run
                run = []

    out = set()
    tokens = [slow_tokens(t) for t in texts]
    for j, item in enumerate(map(slow_tokens, items)):
        want = min(match, len(item))
        for i, text in enumerate(tokens):
            for shift in range(-len(item), len(text)):
                pairs = [(item[k], text[k + shift]) for k in range(len(item)) if 0 <= k + shift < len(text)]
                width = min(8, len(item))
                seeds = [pairs[k : k + width] for k in range(len(pairs) - width + 1)]
                words = lambda run: 2 * sum(p[0][0][0] != "#" for p in run) >= len(run) and len(item) >= least  # noqa: B023, E731
                # a hit starts at a window that agrees in plain words, or in template tokens throughout
                if not any(all(a[1] == b[1] for a, b in w) or (all(a[0] == b[0] for a, b in w) and words(w)) for w in seeds):
                    continue
                if any(len(r) >= want > 0 for r in runs(pairs, lambda p: p[0][1] == p[1][1])):
                    out.add((i, j))
                elif len(item) >= least and any(good(r, want) for r in runs(pairs, lambda p: p[0][1] == p[1][1] or p[0][0] == p[1][0])):
                    out.add((i, j))
    return out


def test_matches_agree_with_all_alignments(spark):
    """Numbers, names, units, items of one to three words and of slots only, verbatim and with other values."""
    rnd = random.Random(6)
    words, names, units = "how many the of buy sell each if pay has does more than apple pear price total".split(), "Anna Bob Carl Dora Eve Émile".split(), "kg dollars euros miles hours".split()

    def sentence(n, shares):
        kinds = rnd.choices(["w", "n", "N", "u"], shares, k=n)
        return [rnd.choice(words) if k == "w" else str(rnd.randint(2, 99)) if k == "n" else rnd.choice(names) + rnd.choice(["", ",", "."]) if k == "N" else rnd.choice(units) for k in kinds]

    items = [sentence(rnd.randint(14, 24), (6, 2, 2, 1)) for _ in range(10)] + [sentence(rnd.randint(4, 12), (5, 2, 2, 1)) for _ in range(8)]
    items += [sentence(rnd.randint(13, 18), (0, 5, 5, 2)) for _ in range(4)] + [["42"], ["what", "is", "this"], ["Paris,", "Rome"], sentence(8, (0, 1, 0, 0))]
    texts = []
    for i in range(150):
        text, item = sentence(rnd.randint(0, 30), (6, 2, 2, 1)), list(rnd.choice(items))
        if i % 3:
            values = {}
            item = [values.setdefault(t, rnd.choice([t, str(rnd.randint(100, 999))]) if t.isdigit() else rnd.choice([t, rnd.choice(names)]) if t in names else rnd.choice([t, rnd.choice(units)]) if t in units else t) for t in item]
        if i % 7 == 1:
            item[rnd.randrange(len(item))] = "changed"
        if i % 5 == 2:
            item = item[rnd.randint(0, 6) :]
        if i % 11 == 3:
            item = [t.upper() for t in item]
        at = rnd.randint(0, len(text))
        texts.append(" ".join(text[:at] + item + text[at:]))
    items = [" ".join(i) for i in items]
    want = slow_pairs(texts, items)
    assert set(found(spark, texts, items)) == want and len(want) > 60


def test_repeated_items_and_rows_are_reported_each(spark):
    docs = spark.createDataFrame([(1, f"x {QUESTION}"), (1, f"x {QUESTION}"), (None, QUESTION)], "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame([(7, QUESTION), (7, QUESTION), (None, QUESTION)] + [(100 + i, f"{QUESTION} {i}") for i in range(300)], "item_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect())
    assert len(got) == 2 * 302 and got[1, 7] == 4 and got[1, None] == 2 and got[None, 7] == 2 and got[None, 250] == 1


INSULTS = ["idiot", "moron", "stupid", "worthless"]


def labelled(seed, n):
    rnd = random.Random(seed)
    syllables = ["th", "er", "on", "an", "in", "ti", "es", "re", "ou", "ble"]
    rows = []
    for i in range(n):
        words = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(3, 60))]
        toxic = i % 5 == 0
        for _ in range(rnd.randint(1, 3) if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(INSULTS))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = labelled(1, 500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 350], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    assert sum((got[i] >= 0.5) == bool(y) for i, _, y in rows if i >= 350) >= 146
    odd = ["an i.d.i.o.t indeed", "such a m o r o n there", "st-up-id thing", "worth*less", "the tion of an", "", None]
    some = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(some, labels, docs).collect()}
    assert all(scores[i] >= 0.5 for i in range(4)) and all(scores[i] < 0.5 for i in (4, 5, 6))


def test_toxicity_of_unpleasant_rows(spark):
    docs = documents(spark, extra=True)
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (None, 1), (2, None), (4, 7), (5, 0), (1, 0)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert len({r["score"] for r in toxicity.toxicity(docs, labels.filter("toxic = 0")).collect()}) == 1
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def slow_features(word):
    """Weights of a word's subsequences of four letters within six, by plain enumeration; the norm is theirs."""
    out = Counter()
    for places in combinations(range(len(word)), toxicity.LENGTH):
        if (span := places[-1] - places[0] + 1) <= toxicity.SPAN:
            out["".join(word[p] for p in places)] += toxicity.DECAY ** (span - toxicity.LENGTH)
    return out


def test_kernel_matches_plain_enumeration():
    import numpy as np
    from tessera.llm.blocks import text_buffers

    words = ["idiot", "idxiot", "moron", "thereof", "banana", "mississippi", "aaaaaaaa"]
    letters, start, size, _ = toxicity.units(*text_buffers(pa.array([" ".join(words)])))
    pool = toxicity.Strings(letters, start, size)
    gram, plain = pool.kernel(pool), [slow_features(w) for w in words]
    dot = lambda x, y: sum(v * y[k] for k, v in x.items())
    want = [[dot(x, y) / math.sqrt(dot(x, x) * dot(y, y)) for y in plain] for x in plain]
    assert np.allclose(gram, want, atol=1e-5) and np.allclose(np.diag(gram), 1.0, atol=1e-5)
    assert np.linalg.eigvalsh(gram.astype(float)).min() > -1e-5 and gram[0, 1] > gram[0, 2]
    # the sum over landmarks folds into one weight for each subsequence
    alpha, table, norms = np.array([1.0, -0.5, 0.25, 0.0, 2.0, 1.5, -1.0]), np.zeros(toxicity.SLOTS), pool.norms()
    for own, code, weight in toxicity.subsequences(letters, start, size):
        np.add.at(table, code, weight * (alpha / norms)[own])
    assert np.allclose(toxicity.scores(table, 0.0, letters, start, size), gram @ alpha, atol=1e-5)


def test_units():
    from tessera.llm.blocks import text_buffers

    def units(text):
        letters, start, size, _ = toxicity.units(*text_buffers(pa.array([text])))
        return sorted("".join(chr(96 + c) for c in letters[a : a + n]) for a, n in zip(start, size))

    assert units("You i.d.i.o.t") == ["idiot"] and units("id iot") == ["idiot"] and units("the clown") == ["clown"]
    assert units("a b c d e") == ["abcd", "abcde", "bcde"]  # written apart: one string, also without the first, the last


PAGE = '<!DOCTYPE html><html lang="fr"><head><title>A &amp; B</title><style>p{}</style></head><body><!-- x --><p>One<br>two &lt;3 <b>bold</b></p><script>var t="</p>";</script><a href="/x?a=1&amp;b=2">link</a><a href="/x?a=1&amp;b=2">again</a></body></html>'


def test_derivatives(spark, tmp_path):
    rows = [(1, "http://a/", PAGE), (2, None, None), (None, "http://b/", ""), (1, "http://a/", PAGE), (3, "http://c/", "plain < text & more\x00"), (4, "u", "<script>never closed"), (5, "u", "é" * 5000)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, date string, block int")
    out = warc.derivatives(pages.select("page_id", "url", "html", "block"))
    got = out.collect()
    assert len(got) == 14
    text = next(r for r in got if r["page_id"] == 1 and r["record_type"] == "conversion")
    about = next(r for r in got if r["page_id"] == 1 and r["record_type"] == "metadata")
    assert text["block"] == "One\ntwo <3 bold\nlinkagain" and about["block"] == "title: A & B\r\nlanguage: fr\r\noutlink: /x?a=1&b=2\r\n"
    assert text["refers_to"] == about["refers_to"] and text["record_id"] != about["record_id"] and text["source_payload_digest"] == warc.sha1(PAGE.encode())
    assert all(r["block_digest"] == warc.sha1(r["block"].encode()) and r["content_length"] == len(r["block"].encode()) for r in got)
    assert next(r for r in got if r["page_id"] == 4 and r["record_type"] == "conversion")["block"] == ""
    assert next(r for r in got if r["page_id"] == 3 and r["record_type"] == "conversion")["block"] == "plain < text & more"
    warc.write(out, str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w")).collect()
    assert len(back) == 14 and all(warc.sha1(bytes(r["block"])) == r["headers"]["WARC-Block-Digest"] for r in back)
    assert {r["headers"]["WARC-Refers-To"] for r in back} == {r["refers_to"] for r in got}
    assert warc.derivatives(pages.limit(0)).count() == 0


def test_late_head_is_no_text():
    assert warc.plain_text(" " * 5000 + "<html><head><title>T</title></head><body>" + "<p>x") == "x"


def test_own_headers_are_kept(spark):
    pages = spark.createDataFrame([(1, "u", "x", "2024-01-01T00:00:00Z", "<urn:uuid:1>", "HTTP/1.1 200 OK\r\nX: y", "sha1:ABC")], "page_id long, url string, html string, d string, rid string, h string, g string")
    row = warc.derivatives(pages, {"date": "d", "record_id": "rid", "headers": "h", "digest": "g"}).first()
    assert (row["warc_date"], row["refers_to"], row["source_headers"], row["source_payload_digest"]) == ("2024-01-01T00:00:00Z", "<urn:uuid:1>", "HTTP/1.1 200 OK\r\nX: y", "sha1:ABC")


@pytest.mark.parametrize("page", ["", "<", "<p", "&#xZZ;", "<!--", "<a href=", "\n\n"])
def test_broken_pages(page):
    assert isinstance(warc.plain_text(page), str) and isinstance(warc.describe(page), str)


class Reader(HTMLParser):
    """The text of a well-formed page, by the standard parser."""

    BLOCKS = set("article br div h1 h2 li p section table td tr ul".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("head", "script", "style")
        self.parts.append("\n" if tag in self.BLOCKS else "")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("head", "script", "style")
        self.parts.append("\n" if tag in self.BLOCKS or tag == "head" else " " if tag in ("script", "style") else "")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data.replace("\n", " "))

    def text(self):
        lines = (re.sub(r"[ \t\r\f\v\xa0]+", " ", line).strip(" ") for line in "".join(self.parts).split("\n"))
        return "\n".join(line for line in lines if line)


def test_plain_text_agrees_with_a_parser():
    rnd = random.Random(4)

    def piece(depth):
        if depth == 0 or rnd.random() < 0.3:
            return rnd.choice(["word", "a &amp; b", "x &lt; y", "two  blanks", "line\nend", "é漢", "&#233;&nbsp;z"]) + rnd.choice(["", " "])
        tag = rnd.choice("div p b i li section h1 span".split())
        return f"<{tag}>" + "".join(piece(depth - 1) for _ in range(rnd.randint(0, 3))) + f"</{tag}>" + rnd.choice(["", "<br>", "<script>if (a < b) { c() }</script>", "<style>p { x: y }</style>"])

    for n in range(300):
        head = " " * rnd.choice([0, 6000]) + "<head><title>T</title></head>" if n % 2 else ""
        page = f"<html>{head}<body>" + "".join(piece(4) for _ in range(3)) + "</body></html>"
        reader = Reader()
        reader.feed(page)
        assert warc.plain_text(page) == reader.text(), page


def test_from_files_to_files(spark, tmp_path):
    page = PAGE.replace("é", "e")

    def record(kind, uri, block, extra=""):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{uri[-1]}>\r\nWARC-Target-URI: {uri}\r\nWARC-Date: 2024-05-06T07:08:09Z\r\n{extra}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n" + page.encode() + b" caf\xe9 WARC/1.0 inside"
    parts = [record("warcinfo", "http://a/0", b"x: y"), record("response", "http://a/1", http, "WARC-Payload-Digest: sha1:ABC\r\n"), record("request", "http://a/2", b"GET /"), record("response", "http://a/3", b"")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc").write_bytes(b"".join(parts))
    (tmp_path / "in/b.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    assert len(list(warc.parse(b"".join(parts)))) == 4
    warc.derive_files(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    found = [(r["headers"], r["block"].decode()) for r in warc.read(spark, str(tmp_path / "out/part-*")).collect()]
    assert len(found) == 8  # two responses in each of two files, two derivatives of each
    first = [(h, b) for h, b in found if h["WARC-Refers-To"] == "<urn:uuid:1>" and h["WARC-Type"] == "conversion"]
    assert len(first) == 2 and all(b.endswith("café WARC/1.0 inside") for _, b in first)
    header = first[0][0]
    assert header["WARC-Source-Payload-Digest"] == "sha1:ABC" and header["WARC-Date"] == "2024-05-06T07:08:09Z" and "404 Not Found" in header["WARC-Source-HTTP-Headers"]
    assert all(int(h["Content-Length"]) == len(b.encode()) and h["WARC-Block-Digest"] == warc.sha1(b.encode()) for h, b in found)
    for broken in (b"".join(parts)[:-20], b"junk", b"WARC/1.1\r\nWARC-Type: response\r\n\r\nbody"):
        with pytest.raises(ValueError):
            list(warc.parse(broken))


def test_no_header_is_injected(spark):
    pages = spark.createDataFrame([(1, "http://a/\r\nX-Evil: 1\x00\n", "<p>x</p>")], "page_id long, url string, html string")
    for r in warc.serialise(warc.derivatives(pages)).collect():
        (headers, _), = warc.parse(r["value"].encode())
        assert "X-Evil" not in headers and headers["WARC-Target-URI"] == "http://a/%0D%0AX-Evil: 1%0A"

"""Small tables with everything unpleasant in them, and plain reference computations."""

import random
import re
import zlib

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside, as extra columns of an input.
CLASHING = "block long, payload string, range int, body string, vertex long, node long, component long, size long, shard int, score double, label int, text_key long, key_a long, train boolean, slot long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def texts(seed=1, n=60):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(80)] + ["The", "THE", "the,", "漢字", "🙂"]
    out = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 40))) for _ in range(n)]
    for _ in range(n // 3):  # near copies
        w = rnd.choice(out[:n]).split(" ")
        w[rnd.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    return out + ["", None, " \t\n", "x", "X", "x", "a b", "a  b\n", "\x00nul\x00 nul", out[0], out[0], "word " * 3000, "y" * 30_000, "<|endoftext|> tail"]


def documents(spark, seed=1, n=60, extra=False):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts(seed, n))]
    rows += [(3, rows[3][1], "en", "s", 0), (None, "null id", None, None, None), (None, None, None, None, None), (-7, "negative id", "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        for c in CLASHING.split(", "):
            df = df.withColumn(c.split()[0], F.lit(None).cast(c.split()[1]))
    return df


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=str)

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import lm, repeats, token_counts

OPERATORS = {
    "scores": lambda docs, n: lm.score(docs, F.col("doc_id") % 3 != 0, block_bytes=n),
    "counts": lambda docs, n: token_counts.token_counts(docs, token_counts.vocabulary_path("byte_bpe_50k.json"), block_bytes=n),
    "removals": lambda docs, n: repeats.removals(docs, block_bytes=n),
    "texts": lambda docs, n: repeats.cut_repeats(docs, block_bytes=n),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_block_size_changes_no_result(spark, name):
    rnd = random.Random(12)
    vocabulary = ["".join(rnd.choice("bcdfghlm") + rnd.choice("aeioué") for _ in range(3)) for _ in range(60)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage = text(50)
    rows = [(i, f"{text(20)} {passage} {text(9)}" if i % 4 == 0 else text(30)) for i in range(24)]
    rows += [(90, None), (91, ""), (None, text(10)), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    plain = lambda row: tuple(round(x, 9) if isinstance(x, float) else x for x in row)
    whole, some, each = (sorted(map(plain, OPERATORS[name](docs, n).collect()), key=str) for n in (14 << 20, 900, 1))
    assert len(whole) == len(rows) and whole == some == each
    if name == "removals":
        assert all(r[2] >= len(passage.encode()) for r in whole if r[0] is not None and r[0] < 24 and r[0] % 4 == 0)

"""A training-corpus pipeline over ``documents``: each stage is one operator of ``tessera.llm``.

Stages take (spark, docs, sf_dir).  All but the last return the columns of documents; each works on all that
the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import blocks, bpe, decontaminate, near_dup, queries, repeats, token_counts, toxicity

#: Words of a shingle, and percent of the union that near duplicates share.
SHINGLE_WORDS, PERCENT = 5, 80


def _numbered(docs: DataFrame) -> DataFrame:
    """Only rows with an id can be decided on by id; those without are kept by every filter."""
    return docs.filter("doc_id IS NOT NULL")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents scored 0.5 or more; rows of one id share the worst score's fate.

    The model learns from all labelled rows of ``labels`` whose texts are in ``docs``.  Null and empty texts, and
    rows with a null id, stay.
    """
    scores = toxicity.toxicity(_numbered(docs), queries.table(spark, sf_dir, "labels"))
    return docs.join(scores.filter("score >= 0.5").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group; texts without words and null ids stay.

    Of rows that repeat an id within a group, all stay.
    """
    found = near_dup.near_duplicates(docs.select("doc_id", "text"), SHINGLE_WORDS, PERCENT)
    gone = found.filter("doc_id IS NOT NULL AND NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 200 bytes and more that occur again; n_chars follows, no row goes."""
    out = repeats.cut_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item or 13 aligned words of one."""
    return decontaminate.clean_documents(docs, queries.table(spark, sf_dir, "benchmark")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, checked by decoding them: digests of both."""
    import public_tokenizers

    return bpe.round_trip(docs, token_counts.vocabulary_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL has no string-kernel machine, near-duplicate components of unbounded depth, or BPE merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as a table in the shared folder and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = blocks.cut(docs)
    return docs

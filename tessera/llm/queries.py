"""The registered queries of this subpackage: thin wrappers with production parameters.

Each reads its whole intended table and returns its operator's full result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, cover_tree, decontaminate, lm, near_dup, repeats, sharding, token_counts, toxicity, warc
from tessera.llm.blocks import crc_of_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_counts.vocabulary_path("byte_bpe_50k.json")
    return token_counts.token_counts(table(spark, sf_dir, "documents"), path).withColumn("over_limit", F.col("n_tokens") > 512)


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removals(table(spark, sf_dir, "documents"), length=200)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.pmod(crc_of_id(), F.lit(5)) == 0
    scored = toxicity.toxicity(documents, labels.filter(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(table(spark, sf_dir, "pages"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = token_counts.vocabulary_path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scores": op1_lm_scores,
    "op2_token_counts": op2_token_counts,
    "op3_top_k": op3_top_k,
    "op4_shards": op4_shards,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_decontaminate": op6_decontaminate,
    "op7_repeats": op7_repeats,
    "op8_toxicity": op8_toxicity,
    "op9_bpe": op9_bpe,
    "op10_warc": op10_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op3_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op4_shards": """
        WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS crc),
        d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        u AS (SELECT text, md5(text) AS m, CAST(octet_length(encode(text)) + 16 AS BIGINT) AS size,
            xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
              lambda c, b: xor(c // 256, crc[xor(c % 256, b) + 1]))) AS text_crc32 FROM (SELECT DISTINCT text FROM d), t),
        r AS (SELECT doc_id, size, text_crc32, CAST('0x' || substr(m, 1, 15) AS BIGINT) AS k FROM d JOIN u USING (text)),
        a AS (SELECT i, (SELECT sum(size) FROM r) * i / 40.0 AS target, (SELECT sum(size) FROM r) / 40.0 AS share FROM range(1, 40) x(i)),
        p AS (SELECT s, k >> s AS part, sum(size) AS bytes FROM r, (SELECT unnest([48, 36, 24, 12, 0]) AS s) GROUP BY 1, 2),
        c AS (SELECT *, sum(bytes) OVER (PARTITION BY s ORDER BY part) AS upto FROM p),
        b AS (SELECT i, s, target, share, arg_min(part, part) AS part, arg_min(target - (upto - bytes), part) AS low, arg_min(upto - target, part) AS high FROM a JOIN c ON upto >= target GROUP BY ALL),
        f AS (SELECT i, arg_max((CASE WHEN low <= high THEN part ELSE part + 1 END) << s, s) AS bound FROM b WHERE least(low, high) <= 0.001 * share OR s = 0 GROUP BY i),
        g AS (SELECT *, (SELECT count(*) FROM f WHERE f.bound <= r.k) AS shard FROM r)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY k, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM g""",
    "op5_near_duplicates": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
        n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
        x AS (SELECT doc_id, unnest(s) AS g FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
        e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
        t(n, m) AS (SELECT u, v FROM e UNION SELECT t.n, e.v FROM t JOIN e ON t.m = e.u),
        c AS (SELECT n AS doc_id, least(n, min(m)) AS m FROM t GROUP BY n)
        SELECT doc_id, n.n AS n_shingles, coalesce(m, doc_id) AS component_id, coalesce(m, doc_id) = doc_id AS kept FROM n LEFT JOIN c USING (doc_id)""",
    "op7_repeats": r"""
        WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
        k AS (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 400)) AS m FROM (SELECT doc_id, h, unnest(range(1, n - 198)) AS i FROM h)),
        d AS (SELECT doc_id, i FROM k WHERE m IN (SELECT m FROM k GROUP BY m HAVING count(*) > 1)),
        f AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS st FROM d),
        g AS (SELECT doc_id, i, sum(st) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f),
        r AS (SELECT doc_id, min(i) AS a, max(i) + 199 AS b FROM g GROUP BY doc_id, run),
        e AS (SELECT doc_id, a, b FROM r UNION ALL SELECT doc_id, n + 1, n + 1 FROM h),
        c AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a) + 1, 1) AS s FROM e),
        t AS (SELECT c.doc_id, string_agg(substr(h.h, 2 * s - 1, 2 * (a - s)), '' ORDER BY a) AS kept FROM c JOIN h ON h.doc_id = c.doc_id GROUP BY c.doc_id)
        SELECT h.doc_id, h.n AS n_bytes, CAST(coalesce((SELECT sum(b - a + 1) FROM r WHERE r.doc_id = h.doc_id), 0) AS BIGINT) AS n_removed,
          (SELECT count(*) FROM r WHERE r.doc_id = h.doc_id) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM h JOIN t ON t.doc_id = h.doc_id""",
}

"""The queries opN_<name>: each applies its operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclake.llm import bpe, lines, packing, pii, quality, secrets, simhash, substrings, topk, toxicity
from srclake.llm.common import documents


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.personal_data(documents(spark, sf_dir)))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = bpe.encode(documents(spark, sf_dir), vocabulary, decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and characters left of each document, and its kept text's digest."""
    docs = documents(spark, sf_dir)
    kept = lines.drop_recurring(docs.withColumn("n_chars", F.length("text").cast("long")))
    return kept.select("doc_id", "n_chars", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.find_secrets(documents(spark, sf_dir)))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_bpe": op2_bpe,
    "op3_simhash": op3_simhash,
    "op4_packing": op4_packing,
    "op5_topk": op5_topk,
    "op6_lines": op6_lines,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_secrets": op9_secrets,
    "op10_substrings": op10_substrings,
}

_WORD = r"[^\x20\x09-\x0D]+"

ORACLE_SQL: dict[str, str] = {
    "op7_quality": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
             g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS three FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
             c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS n FROM g),
             r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY doc_id),
             m AS (SELECT d.doc_id, t, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                          list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS x, coalesce(r.n, 0) AS n_repeat_words FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
             f AS (SELECT *, len(x) - len(list_distinct(x)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR 100 * n_symbols > 25 * n_words OR (len(x) >= 4 AND 2 * n_dup_lines > len(x)) OR word_chars > 20 * n_words OR word_chars < 2 * n_words
                    OR 10 * length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) > 4 * length(regexp_replace(t, '[^\p{{L}}]+', '', 'g'))) AS kept FROM f
    """,
    "op10_substrings": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
             g AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS fifty FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
             f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY fifty) AS first FROM g),
             r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM f WHERE first < doc_id),
             p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
             k AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.j) AS kept FROM p ANTI JOIN r ON r.doc_id = p.doc_id AND r.j = p.j GROUP BY p.doc_id),
             n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
    """,
    "op5_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(range(1, len(v.e) + 1), lambda i: q.e[i] * v.e[i])) AS BIGINT) AS score
                   FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
}

"""Files from tables of documents, so that every operator runs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclake.functions.scalar import content_ref, language, path_key, shard_prefix

#: Extensions by doc_id modulo 6.
EXTENSIONS = (".md", ".py", ".js", ".json", ".unknown", "")


def files_from_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, path, path_key, object, size, lang_hint, shard_id, text) of documents(doc_id, text, lang, source): each a
    file, with some white space and markers put in by doc_id so that all lint rules have something to find."""
    pick = lambda n, cases, column: F.element_at(F.array(*cases), (F.pmod(column, F.lit(n)) + 1).cast("int"))
    text, i = F.col("text"), F.col("doc_id")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), i.cast("string"), pick(6, [F.lit(e) for e in EXTENSIONS], i))
    changed = pick(5, [F.concat(text, F.lit("  \n")), F.concat(F.lit("\t"), text), F.concat(F.lit("todo: "), text), F.concat(text, F.lit("\n")), text], i)
    rows = docs.select(i, path.alias("path"), changed.alias("text"))
    rows = rows.withColumn("object", content_ref(F.col("text")))
    return rows.select("doc_id", "path", path_key(F.col("path")).alias("path_key"), "object", F.octet_length("text").cast("long").alias("size"), language(F.col("path")).alias("lang_hint"), shard_prefix(F.col("object")).alias("shard_id"), "text")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""The parse task: text statistics and token counts as column expressions; Python sources go through the node table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srclake.functions.scalar import content_ref, loc, occurrences, text_stats, token_counts
from srclake.operators.records import record, select_records, union_records

SCRIPTS = ("javascript", "typescript")
#: Bytes of a serialised tree from which it is stored in chunks.
CHUNK = 16 * 1024 * 1024


def token_info(files: DataFrame) -> DataFrame:
    """Script files with struct columns tokens and stats."""
    stats = F.struct((occurrences(F.col("text"), "\n") + 1).alias("lines"), F.length("text").cast("long").alias("characters"))
    return files.where(F.col("lang_hint").isin(*SCRIPTS) & F.col("text").isNotNull()).withColumns({"tokens": token_counts(F.col("text")), "stats": stats})


def text_info(files: DataFrame) -> DataFrame:
    """Files that are neither Python nor script, with a struct column stats."""
    other = F.col("lang_hint").isNull() | ~F.col("lang_hint").isin("python", *SCRIPTS)
    return files.where(other & F.col("text").isNotNull()).withColumn("stats", text_stats(F.col("text")))


def brace_diagnostics(files: DataFrame) -> DataFrame:
    """A warning for each script file whose braces do not balance."""
    rows = files.where(F.col("lang_hint").isin(*SCRIPTS) & F.col("text").isNotNull()).select("shard_id", "path", occurrences(F.col("text"), "{").alias("o"), occurrences(F.col("text"), "}").alias("c")).where("o <> c")
    return select_records(rows, kind="diagnostic", path=F.col("path"), severity="warning", code="W0001", message=F.format_string("Unbalanced braces: %d open, %d close", "o", "c"), line=1, col=1)


def trees(files: DataFrame) -> DataFrame:
    """(shard_id, path, tree): the JSON of token and text statistics of files that are not Python."""
    info = lambda kind, mode, *more: F.to_json(F.struct(F.lit(mode).alias("ast_mode"), *more, F.lit(kind).alias("type")))
    script = token_info(files).select("shard_id", "path", info("TokenInfo", "tokens", F.lit("regex-fallback").alias("parser"), F.col("stats"), F.col("tokens")).alias("tree"))
    return script.unionByName(text_info(files).select("shard_id", "path", info("TextInfo", "text_stats", F.col("stats")).alias("tree")))


def tree_records(parsed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The ast record of each row of parsed(shard_id, path, tree)."""
    large = F.octet_length("tree") > chunk
    return select_records(parsed, kind="ast", path=F.col("path"), object=content_ref(F.when(large, _manifest(chunk)).otherwise(F.col("tree"))), format=F.when(large, "json+chunks").otherwise("json"))


def _manifest(chunk: int):
    return F.to_json(F.struct(F.lit("json").alias("format"), chunks(F.col("tree").cast("binary"), chunk).alias("chunks"), F.lit("ast").alias("kind"), F.octet_length("tree").alias("total_bytes")))


def tree_objects(parsed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(object, content) of what tree_records refers to: trees, or manifests and the chunks that they list."""
    large, content = F.octet_length("tree") > chunk, F.col("tree").cast("binary")
    n = F.ceil(F.octet_length("tree") / chunk).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(content, i * chunk + 1, F.lit(chunk)))
    every = F.when(large, F.concat(F.array(_manifest(chunk).cast("binary")), parts)).otherwise(F.array(content))
    return parsed.select(F.explode(every).alias("content")).select(content_ref(F.col("content")).alias("object"), "content")


def chunks(content, size: int):
    """array<struct<object, size, index>> of binary content cut after every `size` bytes."""
    n = F.octet_length(content)
    at = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    part = lambda i: F.substring(content, i * size + 1, F.lit(size))
    return F.transform(at, lambda i: F.struct(content_ref(part(i)).alias("object"), F.octet_length(part(i)).cast("long").alias("size"), i.cast("long").alias("index")))


def basic_metrics(files: DataFrame) -> DataFrame:
    """bytes, loc (of text only) and lang of each file."""
    one = lambda metric, **v: record(kind="metric", path=F.col("path"), metric=metric, **v)
    all_of = F.array(one("bytes", value_num=F.col("size")), F.when(F.col("text").isNotNull(), one("loc", value_num=loc(F.col("text")))), one("lang", value_str=F.coalesce("lang_hint", F.lit("unknown"))))
    return files.select("shard_id", F.explode(F.array_compact(all_of)).alias("r")).select("shard_id", "r.*")


def script_symbols(files: DataFrame) -> DataFrame:
    """One module symbol for each script file with a keyword."""
    rows = token_info(files).where("tokens.keyword > 0")
    return select_records(rows, kind="symbol", path=F.col("path"), name="js_module", symbol_type="module", line=1, col=0, scope="file")


def lost_files(files: DataFrame, code: str) -> DataFrame:
    """An error for each file whose object is not stored."""
    return select_records(files.where("missing"), kind="diagnostic", path=F.col("path"), severity="error", code=code, message=F.concat(F.lit("Object cannot be read: "), "object"), line=1, col=1)


def parse_records(files: DataFrame, parsed: DataFrame, errors: DataFrame, emit_ast: bool = True, emit_diagnostics: bool = True, chunk: int = CHUNK) -> DataFrame:
    """All records of the parse task, of the trees parsed(shard_id, path, tree) and the errors of all files."""
    return union_records(tree_records(parsed, chunk).where(F.lit(emit_ast)), union_records(brace_diagnostics(files), errors).where(F.lit(emit_diagnostics)))

"""The engine's queries over the driver's tables, each with its SQL where SQL can say it.

documents become files (srclake.sources.corpus). Batch A has the files whose doc_id is no multiple of 13, batch B those whose
is no multiple of 11, with some severities changed, so that comparing them finds every sort of change.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclake.functions import scalar
from srclake.operators import diff, parse, python_facts, python_tasks, query
from srclake.operators import files as file_ops
from srclake.operators.lint_text import TextLint, text_diagnostics
from srclake.schemas import RECORD
from srclake.sources.corpus import EXTENSIONS, corpus
from srclake.streaming import events as event_streams

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIAGNOSTIC = ("path", "severity", "code", "message", "line", "col")


def _values(rows: list[tuple], columns: str) -> str:
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v} AS BIGINT)"
    body = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


_extension = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EXTENSIONS)) + " END"
_language = "CASE doc_id % 6 WHEN 0 THEN 'markdown' WHEN 1 THEN 'python' WHEN 2 THEN 'javascript' WHEN 3 THEN 'json' END"
_text = "CASE doc_id % 5 WHEN 0 THEN text || '  ' || chr(10) WHEN 1 THEN chr(9) || text WHEN 2 THEN 'todo: ' || text WHEN 3 THEN text || chr(10) ELSE text END"
FILES = f"""
    raw AS (SELECT doc_id, source || '/' || lang || '/doc_' || doc_id || {_extension} AS path, {_language} AS lang_hint, {_text} AS text FROM documents),
    files AS (SELECT doc_id, path, lower(path) AS path_key, 'sha256:' || sha256(text) AS object, CAST(strlen(text) AS BIGINT) AS size, lang_hint, substr(sha256(text), 1, 2) AS shard_id, text FROM raw)
"""
LINES = """
    lines AS (SELECT doc_id, path, shard_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM files)
"""
_marked = "upper(replace(line, 'ß', 'SS'))"
_first = "CASE " + " ".join(f"WHEN contains({_marked}, '{m}') THEN '{m}'" for m in ("TODO", "FIXME", "XXX", "HACK")) + " END"
RULES = {
    "l001": r"SELECT doc_id, path, shard_id, 'warning' AS severity, 'L001' AS code, 'Trailing whitespace' AS message, n AS line, CAST(length(regexp_replace(line, '\s+$', '')) + 1 AS BIGINT) AS col FROM lines WHERE regexp_matches(line, '\s$')",
    "l002": "SELECT doc_id, path, shard_id, 'warning' AS severity, 'L002' AS code, 'Line too long (' || length(line) || ' > 120)' AS message, n AS line, CAST(121 AS BIGINT) AS col FROM lines WHERE length(line) > 120",
    "l003": f"SELECT doc_id, path, shard_id, 'info' AS severity, 'L003' AS code, 'Found ' || {_first} || ' comment' AS message, n AS line, CAST(strpos({_marked}, {_first}) AS BIGINT) AS col FROM lines WHERE {_first} IS NOT NULL",
    "l004": "SELECT doc_id, path, shard_id, 'warning' AS severity, 'L004' AS code, 'Tab indentation (prefer spaces)' AS message, n AS line, CAST(1 AS BIGINT) AS col FROM lines WHERE starts_with(line, chr(9))",
    "l005": "SELECT doc_id, path, shard_id, 'warning' AS severity, 'L005' AS code, 'Missing newline at end of file' AS message, CAST(len(string_split(text, chr(10))) AS BIGINT) AS line, CAST(length(list_extract(string_split(text, chr(10)), -1)) + 1 AS BIGINT) AS col FROM files WHERE text <> '' AND NOT ends_with(text, chr(10))",
}
LINT = "lint AS (" + " UNION ALL ".join(RULES.values()) + ")"
_loc = r"CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S'))) AS BIGINT)"
METRICS = f"""
    metrics AS (SELECT doc_id, path, shard_id, 'bytes' AS metric, size AS value_num, CAST(NULL AS VARCHAR) AS value_str FROM files
        UNION ALL SELECT doc_id, path, shard_id, 'loc', {_loc}, NULL FROM files
        UNION ALL SELECT doc_id, path, shard_id, 'lang', NULL, coalesce(lang_hint, 'unknown') FROM files)
"""
_keywords = r"\b(function|const|let|var|if|else|for|while|return|class|import|export|async|await)\b"
TOKENS = {"keyword": _keywords, "number": r"\b\d+(?:\.\d+)?\b", "comment": r"//.*|/\*[\s\S]*?\*/", "identifier": r"\b[a-zA-Z_$][a-zA-Z0-9_$]*\b"}
_count = {k: f"CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT)" for k, p in TOKENS.items()}
RECORDS = f"""
    records AS (SELECT '04_lint' AS task_id, doc_id, shard_id, path, 'diagnostic' AS kind, severity, code, message, line, col, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS metric, CAST(NULL AS BIGINT) AS value_num, CAST(NULL AS VARCHAR) AS value_str FROM lint
        UNION ALL SELECT '02_analyze', doc_id, shard_id, path, 'metric', NULL, NULL, NULL, NULL, NULL, NULL, metric, value_num, value_str FROM metrics
        UNION ALL SELECT '03_symbols', doc_id, shard_id, path, 'symbol', NULL, NULL, NULL, 1, 0, 'js_module', NULL, NULL, NULL FROM files WHERE lang_hint = 'javascript' AND {_count["keyword"]} > 0)
"""
ALL = f"WITH {FILES}, {LINES}, {LINT}, {METRICS}, {RECORDS}"
_changed = "CASE WHEN code = 'L002' AND doc_id % 3 = 0 THEN 'error' WHEN code = 'L005' AND doc_id % 7 = 0 THEN 'hint' ELSE severity END"
BATCHES = f"""{ALL},
    a AS (SELECT * FROM records WHERE doc_id % 13 <> 0),
    b AS (SELECT * REPLACE ({_changed} AS severity) FROM records WHERE doc_id % 11 <> 0),
    da AS (SELECT * FROM a WHERE kind = 'diagnostic'), db AS (SELECT * FROM b WHERE kind = 'diagnostic'),
    joined AS (SELECT coalesce(da.path, db.path) AS path, coalesce(da.line, db.line) AS line, coalesce(da.col, db.col) AS col, coalesce(da.code, db.code) AS code,
        da.path IS NOT NULL AS in_a, db.path IS NOT NULL AS in_b, da.severity AS old_severity, db.severity AS new_severity, da.message AS old_message, db.message AS new_message
        FROM da FULL OUTER JOIN db ON da.path = db.path AND da.line = db.line AND da.col = db.col AND da.code = db.code),
    ranked AS (SELECT *, CASE old_severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 WHEN 'hint' THEN 3 END AS o, CASE new_severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 WHEN 'hint' THEN 3 END AS w FROM joined)
"""


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _doc_id(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.regexp_extract("path", r"doc_(\d+)", 1).cast("long"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of lint, metrics and script symbols with task_id, doc_id and an order."""
    files = corpus(spark, sf_dir)
    parts = {"04_lint": text_diagnostics(files), "02_analyze": parse.basic_metrics(files), "03_symbols": parse.script_symbols(files)}
    out = [df.withColumn("task_id", F.lit(t)) for t, df in parts.items()]
    return _doc_id(out[0].unionByName(out[1]).unionByName(out[2])).withColumn("seq", F.col("doc_id") * 1_000_000 + F.coalesce("line", F.lit(0)))


def batch_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).where("doc_id % 13 <> 0")


def batch_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when((F.col("code") == "L002") & (F.col("doc_id") % 3 == 0), "error").when((F.col("code") == "L005") & (F.col("doc_id") % 7 == 0), "hint").otherwise(F.col("severity"))
    return records(spark, sf_dir).where("doc_id % 11 <> 0").withColumn("severity", severity)


def _stored(df: DataFrame, what: str) -> DataFrame:
    """df written once to the folder that driver and executors share, and read back: for rows that a query uses several times,
    which Spark would otherwise make from the texts each time."""
    path = f"{event_streams.shared_dir(df.sparkSession).rstrip('/')}/srclake-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# files and objects


@add("files_index", f"WITH {FILES} SELECT path, path_key, object, size, lang_hint, shard_id FROM files")
def _files_index(spark, d):
    return corpus(spark, d).drop("doc_id", "text")


@add("cas_objects", f"WITH {FILES} SELECT DISTINCT object, size FROM files")
def _cas_objects(spark, d):
    incoming = corpus(spark, d).select("object", F.col("text").cast("binary").alias("content"))
    return file_ops.new_objects(incoming, spark.createDataFrame([], "object string")).select("object", F.octet_length("content").cast("long").alias("size"))


@add("cas_new_objects", f"WITH {FILES} SELECT DISTINCT object FROM files WHERE object NOT IN (SELECT object FROM files WHERE doc_id % 2 = 0)")
def _cas_new(spark, d):
    files = corpus(spark, d).select("doc_id", "object", F.col("text").cast("binary").alias("content"))
    return file_ops.new_objects(files, files.where("doc_id % 2 = 0")).select("object")


@add("shard_histogram", f"WITH {FILES} SELECT shard_id, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY shard_id")
def _histogram(spark, d):
    return file_ops.shard_histogram(corpus(spark, d))


@add("snapshot_totals", f"WITH {FILES} SELECT count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_bytes FROM files")
def _totals(spark, d):
    return file_ops.totals(corpus(spark, d))


@add("lang_hint", f"WITH {FILES} SELECT coalesce(lang_hint, 'unknown') AS lang, count(*) AS n FROM files GROUP BY 1")
def _lang(spark, d):
    return corpus(spark, d).groupBy(F.coalesce("lang_hint", F.lit("unknown")).alias("lang")).agg(F.count("*").alias("n"))


_cased = "CASE WHEN doc_id % 2 = 0 THEN upper('src/' || lang) ELSE 'src/' || lang END || '/' || doc_id // 3"


@add("case_collisions", f"WITH p AS (SELECT DISTINCT {_cased} AS path FROM documents) SELECT a.path AS first, b.path AS second FROM p a JOIN p b ON lower(a.path) = lower(b.path) AND a.path < b.path")
def _collisions(spark, d):
    """Of paths that three documents in a row share, but for their language and, by turns, their case."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    folder = F.concat(F.lit("src/"), "lang")
    path = F.concat(F.when(F.col("doc_id") % 2 == 0, F.upper(folder)).otherwise(folder), F.lit("/"), F.floor(F.col("doc_id") / 3).cast("string"))
    return file_ops.case_collisions(docs.select(path.alias("path"), F.lower(path).alias("path_key")))


#: path, canonical path, error
PATHS = [
    ("a/b.py", "a/b.py", None), ("a\\b.py", "a/b.py", None), ("./a//b/", "a/b", None), ("  a/b ", "a/b", None), ("a/../b", "b", None), ("/abs/x", "abs/x", None),
    ("a/../../b", None, "escape"), ("..", None, "escape"), ("", None, "invalid"), (".", None, "invalid"), ("a<b", None, "invalid"), ("a:b", None, "invalid"),
    ("con", None, "invalid"), ("src/NUL.txt", None, "invalid"), ("lpt9.tar.gz", None, "invalid"), ("com10", "com10", None), ("ünï/文.md", "ünï/文.md", None),
]


@add("canonicalize_path", _values(PATHS, "input, path, error"))
def _paths(spark, d):
    df = spark.createDataFrame([(p[0],) for p in PATHS], "input string").withColumn("c", scalar.canonical_path(F.col("input")))
    return df.select("input", "c.path", "c.error")


@add("object_refs", f"WITH {FILES} SELECT path, substr(object, 8) AS hex, shard_id AS prefix FROM files")
def _refs(spark, d):
    return corpus(spark, d).select("path", scalar.ref_hex(F.col("object")).alias("hex"), scalar.shard_prefix(F.col("object")).alias("prefix"))


_scaled = "SELECT path, f, size * f AS n FROM files, (VALUES (CAST(1 AS BIGINT)), (1000), (1000000), (1000000000)) AS v(f)"
_units = " ".join(f"WHEN n < {1024 ** (k + 1)} THEN printf('%.1f {u}', n / {1024**k}.0)" for k, u in enumerate(("KB", "MB", "GB"), 1))


@add("human_sizes", f"WITH {FILES}, s AS ({_scaled}) SELECT path, f AS factor, CASE WHEN n < 1024 THEN n || ' B' {_units} ELSE printf('%.1f TB', n / {1024**4}.0) END AS size_text FROM s")
def _human(spark, d):
    """Of sizes and their multiples, so that all units occur."""
    factors = F.array(*[F.lit(x).cast("long") for x in (1, 1000, 1_000_000, 1_000_000_000)])
    rows = corpus(spark, d).select("path", "size", F.explode(factors).alias("factor"))
    return rows.select("path", "factor", scalar.human_size(F.col("size") * F.col("factor")).alias("size_text"))


_part = "substr(h, i * 2000 + 1, 2000)"


@add("chunk_manifest", f"WITH {FILES}, c AS (SELECT path, hex(encode(text)) AS h, unnest(range(0, (greatest(size, 1) + 999) // 1000)) AS i FROM files) SELECT path, CAST(i AS BIGINT) AS index, 'sha256:' || sha256(unhex({_part})) AS object, CAST(length({_part}) // 2 AS BIGINT) AS size FROM c WHERE h <> ''")
def _chunks(spark, d):
    return corpus(spark, d).select("path", F.explode(parse.chunks(F.col("text").cast("binary"), 1000)).alias("c")).select("path", "c.index", "c.object", "c.size")


@add("tree_objects", f"""WITH {FILES}, t AS (SELECT DISTINCT '{{"ast_mode":"text_stats","stats":{{"lines":' || len(string_split(text, chr(10))) || ',"words":' || len(regexp_extract_all(text, '\\S+')) || ',"characters":' || length(text) || ',"non_empty_lines":' || len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) || '}},"type":"TextInfo"}}' AS tree FROM files WHERE coalesce(lang_hint, '') NOT IN ('python', 'javascript')) SELECT 'sha256:' || sha256(tree) AS object, CAST(strlen(tree) AS BIGINT) AS size FROM t""")
def _tree_objects(spark, d):
    """What the parse task stores for the trees of text files, once for each different tree."""
    files = corpus(spark, d)
    objects = parse.tree_objects(parse.trees(files.where("lang_hint is distinct from 'javascript'")))
    return file_ops.new_objects(objects, spark.createDataFrame([], "object string")).select("object", F.octet_length("content").cast("long").alias("size"))


# parse, analyze, lint


@add("text_stats", rf"WITH {FILES} SELECT path, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS words, CAST(length(text) AS BIGINT) AS characters, {_loc} AS non_empty_lines FROM files WHERE coalesce(lang_hint, '') NOT IN ('python', 'javascript')")
def _text_stats(spark, d):
    return parse.text_info(corpus(spark, d)).select("path", "stats.*")


@add("loc_metric", f"WITH {FILES} SELECT path, {_loc} AS loc FROM files")
def _loc_metric(spark, d):
    return corpus(spark, d).select("path", scalar.loc(F.col("text")).alias("loc"))


@add("basic_metrics", f"WITH {FILES}, {METRICS} SELECT path, metric, value_num, value_str FROM metrics")
def _basic(spark, d):
    return parse.basic_metrics(corpus(spark, d)).select("path", "metric", "value_num", "value_str")


@add("js_tokens")
def _tokens(spark, d):
    """The SQL engine's word boundaries are not Unicode ones; tests hold the counts against patterns in Python."""
    return parse.token_info(corpus(spark, d)).select("path", *[F.col(f"tokens.{k}").alias(k) for k in TOKENS])


_SCRIPTS = [("a.js", "const a = 'x\\'y' + \"z\"; // {", 2), ("b.js", "let b = {};", 0), ("c.ts", "f('', \"it's\", '')", 3)]


@add("js_strings", _values([(p, n) for p, _, n in _SCRIPTS], "path, strings"))
def _strings(spark, d):
    return spark.createDataFrame([(p, t) for p, t, _ in _SCRIPTS], "path string, text string").select("path", scalar.token_counts(F.col("text"))["string"].alias("strings"))


@add("brace_balance", f"WITH {FILES}, f AS (SELECT path, CASE WHEN doc_id % 4 = 0 THEN text || '{{{{' ELSE text || '{{}}' END AS text FROM files WHERE lang_hint = 'javascript') SELECT path, 'Unbalanced braces: ' || (length(text) - length(replace(text, '{{', ''))) || ' open, ' || (length(text) - length(replace(text, '}}', ''))) || ' close' AS message FROM f WHERE length(replace(text, '{{', '')) <> length(replace(text, '}}', ''))")
def _braces(spark, d):
    files = corpus(spark, d).withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("{{"))).otherwise(F.concat("text", F.lit("{}"))))
    return parse.brace_diagnostics(files).select("path", "message")


@add("script_symbols", f"WITH {FILES} SELECT path, 'js_module' AS name, 'module' AS symbol_type FROM files WHERE lang_hint = 'javascript' AND {_count['keyword']} > 0")
def _script_symbols(spark, d):
    return parse.script_symbols(corpus(spark, d)).select("path", "name", "symbol_type")


def _lint_query(code: str) -> None:
    on = {"l001": "check_trailing_whitespace", "l002": "check_line_length", "l003": "check_todo", "l004": "check_tab_indentation", "l005": "check_final_newline"}
    config = TextLint(**{f: f == on[code] for f in on.values()})
    add(f"lint_{code}", f"WITH {FILES}, {LINES} SELECT {', '.join(DIAGNOSTIC)} FROM ({RULES[code]})")(lambda spark, d: text_diagnostics(corpus(spark, d), config).select(*DIAGNOSTIC))


for _code in RULES:
    _lint_query(_code)


@add("lint_all", f"WITH {FILES}, {LINES}, {LINT} SELECT {', '.join(DIAGNOSTIC)} FROM lint")
def _lint_all(spark, d):
    return text_diagnostics(corpus(spark, d)).select(*DIAGNOSTIC)


# counts and filters


def _stats_query(group: str, missing: str) -> None:
    value = "coalesce(f.lang_hint, 'unknown')" if group == "lang" else f"coalesce(r.{group}, '{missing}')"
    sql = f"{ALL} SELECT {value} AS value, count(*) AS n FROM records r LEFT JOIN files f ON f.path = r.path GROUP BY 1"
    add(f"stats_{group}", sql)(lambda spark, d: query.stats(records(spark, d), group, corpus(spark, d)))


for _group, _missing in (("kind", "unknown"), ("severity", "none"), ("code", "none"), ("lang", "unknown"), ("metric", "unknown")):
    _stats_query(_group, _missing)

_sets = " UNION ALL ".join(f"SELECT task_id, '{g}' AS \"group\", {v} AS value, count(*) AS n FROM j GROUP BY ALL" for g, v in (("kind", "kind"), ("lang", "lang"), ("severity", "coalesce(severity, 'none')"), ("code", "coalesce(code, 'none')")))


@add("stats_grouping_sets", f"{ALL}, j AS (SELECT r.*, coalesce(f.lang_hint, 'unknown') AS lang FROM records r LEFT JOIN files f ON f.path = r.path) {_sets}")
def _grouping_sets(spark, d):
    return query.stats_all(records(spark, d), corpus(spark, d))


@add("diagnostics_filtered", f"{ALL} SELECT {', '.join(DIAGNOSTIC)} FROM records WHERE kind = 'diagnostic' AND severity = 'warning' AND code = 'L002' AND contains(lower(path), 'src1/')")
def _filtered(spark, d):
    return query.diagnostics(records(spark, d), "warning", "L002", "SRC1/").select(*DIAGNOSTIC)


@add("outputs_by_path", f"{ALL} SELECT path, kind, code, metric, line FROM records WHERE contains(lower(path), 'doc_7')")
def _by_path(spark, d):
    return query.outputs(records(spark, d), path_pattern="doc_7").select("path", "kind", "code", "metric", "line")


@add("failed_files", f"{BATCHES} SELECT DISTINCT path FROM b WHERE kind = 'diagnostic' AND severity = 'error'")
def _failed(spark, d):
    return query.failed_files(batch_b(spark, d))


@add("files_with_kind", f"{ALL} SELECT DISTINCT path FROM records WHERE kind = 'symbol'")
def _with_kind(spark, d):
    return query.files_with_kind(records(spark, d), "symbol")


@add("files_without_symbols", f"{ALL} SELECT path FROM files WHERE path NOT IN (SELECT path FROM records WHERE kind = 'symbol')")
def _without(spark, d):
    return query.files_without(corpus(spark, d), records(spark, d), "symbol").select("path")


@add("errors_limit", f"{BATCHES} SELECT path, code, line, severity FROM b WHERE severity = 'error' ORDER BY shard_id, path, line LIMIT 50")
def _errors(spark, d):
    return query.errors(batch_b(spark, d), ["01_parse", "02_analyze", "03_symbols", "04_lint"]).select("path", "code", "line", "severity")


@add("inspect_file", f"{ALL} SELECT task_id, kind, severity, code, line, metric FROM records WHERE doc_id = 7")
def _inspect(spark, d):
    path = F.regexp_extract("path", r"doc_(\d+)", 1) == "7"
    name = corpus(spark, d).where(path).select("path").first()
    return query.inspect(records(spark, d), "./" + (name[0] if name else "none")).select("task_id", "kind", "severity", "code", "line", "metric")


@add("files_page", f"WITH {FILES} SELECT path, size FROM files ORDER BY path_key, path LIMIT 50 OFFSET 100")
def _page(spark, d):
    return query.page(corpus(spark, d).orderBy("path_key", "path"), 2).select("path", "size")


@add("files_first", f"WITH {FILES} SELECT path, size FROM files ORDER BY path_key, path LIMIT 100")
def _first_files(spark, d):
    return query.files(corpus(spark, d)).select("path", "size")


_counts = "count(*) AS outputs, count(*) FILTER (kind = 'diagnostic') AS diagnostics, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings"


@add("task_summary", f"{BATCHES} SELECT task_id, {_counts}, count(DISTINCT path) AS files, count(DISTINCT path) FILTER (severity = 'error') AS failed_files FROM b GROUP BY task_id")
def _task_summary(spark, d):
    return query.task_summary(batch_b(spark, d))


@add("batch_summary", f"{BATCHES} SELECT task_id, {_counts} FROM b GROUP BY ROLLUP (task_id)")
def _batch_summary(spark, d):
    return query.batch_summary(batch_b(spark, d))


@add("top_k", f"{ALL} SELECT coalesce(code, 'none') AS value, count(*) AS n FROM records GROUP BY 1 ORDER BY n DESC, value LIMIT 3")
def _top(spark, d):
    return query.top(records(spark, d), "code", 3)


@add("numbered_records", f"{ALL} SELECT path, code, line, CAST(row_number() OVER (PARTITION BY path ORDER BY doc_id * 1000000 + line) - 1 AS BIGINT) AS n FROM records WHERE code = 'L002'")
def _numbered(spark, d):
    return diff.numbered(records(spark, d).where("code = 'L002'")).select("path", "code", "line", "n")


# comparison


@add("diff_full", f"{BATCHES} SELECT path, line, col, code, CASE WHEN NOT in_a THEN 'added' WHEN NOT in_b THEN 'removed' ELSE 'changed' END AS change, old_severity, new_severity FROM joined WHERE NOT in_a OR NOT in_b OR old_severity <> new_severity OR old_message <> new_message")
def _diff(spark, d):
    found = diff.diff(batch_a(spark, d), batch_b(spark, d), kind="diagnostic")
    return found.select("key.path", "key.line", "key.col", F.col("key.name").alias("code"), "change", F.col("old.severity").alias("old_severity"), F.col("new.severity").alias("new_severity"))


@add("diff_metrics", f"{BATCHES} SELECT coalesce(x.path, y.path) AS path, coalesce(x.metric, y.metric) AS metric, CASE WHEN x.path IS NULL THEN 'added' ELSE 'removed' END AS change FROM (SELECT * FROM a WHERE kind = 'metric') x FULL OUTER JOIN (SELECT * FROM b WHERE kind = 'metric') y ON x.path = y.path AND x.metric = y.metric WHERE x.path IS NULL OR y.path IS NULL")
def _diff_metrics(spark, d):
    return diff.diff(batch_a(spark, d), batch_b(spark, d), kind="metric").select("key.path", F.col("key.name").alias("metric"), "change")


@add("diff_summary", f"{BATCHES}, k AS (SELECT CASE WHEN NOT in_a THEN 'added' WHEN NOT in_b THEN 'removed' ELSE 'changed' END AS change FROM joined WHERE NOT in_a OR NOT in_b OR old_severity <> new_severity) SELECT change, count(*) AS n FROM k GROUP BY change")
def _diff_summary(spark, d):
    return diff.diff_summary(diff.diff(batch_a(spark, d), batch_b(spark, d), kind="diagnostic"))


@add("regressions", f"{BATCHES} SELECT path, line, col, code, new_severity AS severity FROM ranked WHERE NOT in_a OR in_b AND w < o")
def _regressions(spark, d):
    return diff.regressions(batch_a(spark, d), batch_b(spark, d)).select("path", "line", "col", "code", "severity")


@add("improvements", f"{BATCHES} SELECT path, line, col, code, old_severity AS severity FROM ranked WHERE NOT in_b OR in_a AND w > o")
def _improvements(spark, d):
    return diff.improvements(batch_a(spark, d), batch_b(spark, d)).select("path", "line", "col", "code", "severity")


@add("unchanged", f"{BATCHES} SELECT path, line, col, code FROM ranked WHERE in_a AND in_b AND w = o AND line % 2 = 0")
def _unchanged(spark, d):
    b = batch_b(spark, d).withColumn("message", F.when(F.col("line") % 2 == 0, F.concat("message", F.lit("!"))).otherwise(F.col("message")))
    return diff.diagnostic_changes(batch_a(spark, d), b).where("verdict = 'unchanged'").select("key.path", "key.line", "key.col", F.col("key.name").alias("code"))


@add("last_wins", f"{ALL} SELECT path, max(line) AS line, count(*) AS n FROM records WHERE code = 'L002' GROUP BY path")
def _last(spark, d):
    rows = _stored(records(spark, d).where("code = 'L002'"), "long-lines")
    last = diff.last_of_key(rows, ["path"]).select("record.path", "record.line")
    return last.join(rows.groupBy("path").agg(F.count("*").alias("n")), "path")


@add("cache_equivalence", f"{ALL} SELECT 0 AS differs, count(*) AS n FROM records")
def _equivalence(spark, d):
    """Counts from grouping sets against counts of each group: none differ."""
    rows, files = _stored(records(spark, d).select("task_id", "path", "kind", "severity", "code"), "records"), corpus(spark, d)
    cached = query.stats_all(rows, files).groupBy("group", "value").agg(F.sum("n").alias("n"))
    scans = [query.stats(rows, g, files).select(F.lit(g).alias("group"), "value", "n") for g in ("kind", "lang", "severity", "code")]
    scan = scans[0].unionAll(scans[1]).unionAll(scans[2]).unionAll(scans[3])
    gone = diff.differing(scan, cached).select(F.col("differs").cast("int"))
    return gone.join(rows.agg(F.count("*").alias("n")), F.lit(True))


@add("fingerprint")
def _fingerprint(spark, d):
    return file_ops.fingerprint(records(spark, d), ("task_id", "shard_id", *RECORD))


# states

_STATES = f"""WITH {FILES},
    tasks AS (SELECT * FROM (VALUES ('01_parse', 0), ('02_analyze', 1), ('04_lint', 2)) AS t(task_id, position)),
    shards AS (SELECT lower(printf('%02x', i)) AS shard_id, i FROM range(256) AS r(i)),
    states AS (SELECT task_id, shard_id, CASE WHEN task_id = '01_parse' THEN CASE WHEN i % 10 = 3 THEN 'failed' WHEN i % 10 = 4 THEN 'ready' ELSE 'done' END WHEN task_id = '02_analyze' AND i % 3 = 0 THEN 'done' ELSE 'ready' END AS status FROM tasks, shards),
    used AS (SELECT DISTINCT shard_id FROM files),
    open AS (SELECT s.task_id, s.shard_id FROM states s JOIN states p ON s.task_id <> '01_parse' AND p.task_id = '01_parse' AND p.shard_id = s.shard_id AND p.status <> 'done')
"""


def _tasks(spark: SparkSession) -> DataFrame:
    rows = [("b", "01_parse", 0, []), ("b", "02_analyze", 1, ["01_parse"]), ("b", "04_lint", 2, ["01_parse"])]
    return spark.createDataFrame(rows, "batch_id string, task_id string, position int, depends_on array<string>")


def _states(spark: SparkSession) -> DataFrame:
    i = F.conv("shard_id", 16, 10).cast("int")
    first = F.when(i % 10 == 3, "failed").when(i % 10 == 4, "ready").otherwise("done")
    status = F.when(F.col("task_id") == "01_parse", first).when((F.col("task_id") == "02_analyze") & (i % 3 == 0), "done").otherwise("ready")
    return file_ops.initial_states(_tasks(spark)).withColumn("status", status)


@add("initial_states", f"{_STATES} SELECT task_id, shard_id, 'ready' AS status FROM states")
def _initial(spark, d):
    return file_ops.initial_states(_tasks(spark)).select("task_id", "shard_id", "status")


@add("eligible_shards", f"{_STATES} SELECT task_id, shard_id FROM states WHERE status <> 'done' AND shard_id IN (SELECT shard_id FROM used) AND (task_id, shard_id) NOT IN (SELECT task_id, shard_id FROM open)")
def _eligible(spark, d):
    return file_ops.eligible_shards(_tasks(spark), _states(spark), corpus(spark, d))


@add("deps_incomplete", f"{_STATES} SELECT task_id, shard_id, '01_parse' AS dependency FROM open")
def _open(spark, d):
    return file_ops.open_dependencies(_tasks(spark), _states(spark))


_status_counts = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("done", "failed", "running", "ready"))


@add("status_rollup", f"{_STATES}, c AS (SELECT task_id, count(*) AS shards, {_status_counts} FROM states WHERE shard_id IN (SELECT shard_id FROM used) GROUP BY task_id) SELECT *, CASE WHEN failed > 0 THEN 'failed' WHEN done = shards THEN 'done' WHEN running > 0 OR done > 0 THEN 'running' ELSE 'pending' END AS status FROM c")
def _rollup(spark, d):
    return file_ops.task_status(_states(spark), corpus(spark, d))


@add("plan_order", _values([("02_analyze", "04_lint")], "task_id, dependency"))
def _plan_order(spark, d):
    rows = [("01_parse", 0, []), ("02_analyze", 1, ["04_lint", "01_parse"]), ("04_lint", 2, ["01_parse"])]
    return file_ops.out_of_order(spark.createDataFrame(rows, "task_id string, position int, depends_on array<string>"))


# Python sources

SOURCES = [
    ("a.py", 'import os, sys as system\nfrom a.b import c as d\nx = 1\ndef f(a, self, b: int = 2):\n    x = a\n    if a and b or d:\n        for i in range(3):\n            pass\n    def g(a):\n        return [q for q in a]\n    return g\nclass K(Base, m.N):\n    y: int = 3\n    def m(self, x):\n        x += 1\ntry:\n    import json\nexcept E as e:\n    pass\n'),
    ("b.py", "def h(:\n"),
    ("c.py", "_u = 1\nv = 2\nprint(v)\nasync def w():\n    while True:\n        assert v\n"),
]


def _sources(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(SOURCES, "path string, text string").withColumns({"object": scalar.content_ref(F.col("text")), "lang_hint": scalar.language(F.col("path"))})
    return rows.withColumn("shard_id", scalar.shard_prefix(F.col("object")))


def _with_facts(make: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, d: make(python_facts.python_facts(_sources(spark)), _sources(spark))


_symbols = [
    ("a.py", "system", "import_alias", 1, 0, "module"), ("a.py", "d", "import_alias", 2, 0, "module"), ("a.py", "x", "variable", 3, 0, "module"), ("a.py", "f", "function", 4, 0, "module"),
    ("a.py", "a", "parameter", 4, 0, "f"), ("a.py", "b", "parameter", 4, 0, "f"), ("a.py", "x", "variable", 5, 4, "f"), ("a.py", "g", "function", 9, 4, "f"), ("a.py", "a", "parameter", 9, 4, "g"),
    ("a.py", "K", "class", 12, 0, "module"), ("a.py", "y", "variable", 13, 4, "K"), ("a.py", "m", "function", 14, 4, "K"), ("a.py", "x", "parameter", 14, 4, "m"), ("a.py", "e", "variable", 18, 0, "module"),
    ("c.py", "_u", "variable", 1, 0, "module"), ("c.py", "v", "variable", 2, 0, "module"), ("c.py", "w", "function", 4, 0, "module"),
]
add("py_symbols", _values(_symbols, "path, name, symbol_type, line, col, scope"))(_with_facts(lambda facts, files: python_tasks.symbol_records(facts, files).where("kind = 'symbol'").select("path", "name", "symbol_type", "line", "col", "scope")))
_edges = [("a.py", "imports", "os", 1), ("a.py", "imports", "sys", 1), ("a.py", "imports", "a.b.c", 2), ("a.py", "inherits", "Base", 12), ("a.py", "inherits", "N", 12), ("a.py", "imports", "json", 17)]
add("py_edges", _values(_edges, "path, edge_type, target, line"))(_with_facts(lambda facts, files: python_tasks.symbol_records(facts, files).where("kind = 'edge'").select("path", "edge_type", "target", "line")))
# f: itself, if, two of the boolean operators, for, and the comprehension in g; g: itself and the comprehension; m: itself
_complexity = [("a.py", 9, 6, 3, 1, 3), ("c.py", 3, 3, 1, 0, 0)]
add("py_complexity", _values(_complexity, "path, complexity, max_complexity, function_count, class_count, import_count"))(_with_facts(lambda facts, files: files.select("path", "object").join(python_tasks.complexity(facts), "object").drop("object")))


def _lint_python(code: str, rows: list[tuple]) -> None:
    add(f"lint_{code.lower()}", _values(rows, "path, severity, message, line"))(_with_facts(lambda facts, files: python_tasks.lint_records(facts, files).where(F.col("code") == code).select("path", "severity", "message", "line")))


_lint_python("L101", [("a.py", "warning", "Unused import 'os'", 1), ("a.py", "warning", "Unused import 'system'", 1), ("a.py", "warning", "Unused import 'json'", 17)])
_lint_python("L102", [("a.py", "warning", "Unused variable 'i'", 7), ("a.py", "warning", "Unused variable 'y'", 13), ("a.py", "warning", "Unused variable 'e'", 18)])
_lint_python("L103", [("a.py", "info", "Variable 'x' shadows variable from outer scope", 5), ("a.py", "info", "Parameter 'a' shadows variable from outer scope", 9), ("a.py", "info", "Parameter 'x' shadows variable from outer scope", 14)])
add("py_syntax_error", _values([("b.py", "error", "E0001", 1, 7)], "path, severity, code, line, col"))(_with_facts(lambda facts, files: python_tasks.error_records(facts, files).select("path", "severity", "code", "line", "col")))


@add("parse_corpus")
def _parse_corpus(spark, d):
    """The whole parse task over the corpus, Python files included: records by kind, code and format."""
    files = corpus(spark, d)
    facts = python_facts.python_facts(files)
    trees = parse.trees(files).unionByName(python_tasks.trees(facts, files))
    return parse.parse_records(files, trees, python_tasks.error_records(facts, files)).groupBy("kind", "code", "format").agg(F.count("*").alias("n"))


# streams


@add("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _windows(spark, d):
    """The stream over events, run to its end."""
    return _streamed(spark, d, "windows", lambda e: event_streams.windowed(e, "ts", "event_type"))


def _streamed(spark: SparkSession, d: str, name: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    events = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    return event_streams.finished(make(events), f"{event_streams.shared_dir(spark)}/srclake-stream-{name}-{uuid.uuid4().hex}")

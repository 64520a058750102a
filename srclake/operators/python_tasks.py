"""What the tasks make of Python facts: records of parse, analyze, symbols and lint, by filters, joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srclake.operators.python_facts import of_files
from srclake.operators.records import record, select_records, union_records

METRICS = ("complexity", "max_complexity", "function_count", "class_count", "import_count")


def trees(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(shard_id, path, tree)."""
    return of_files(facts, files, "module").select("shard_id", "path", F.col("label").alias("tree"))


def error_records(facts: DataFrame, files: DataFrame) -> DataFrame:
    return select_records(of_files(facts, files, "error"), kind="diagnostic", path=F.col("path"), severity="error", code=F.col("label"), message=F.col("name"), line=F.col("line"), col=F.col("col"))


def lost_trees(facts: DataFrame, files: DataFrame) -> DataFrame:
    """A warning for each Python file with text whose parse left neither a tree nor an error."""
    parsed = facts.where(F.col("fact").isin("module", "error")).select("object")
    rows = files.where("lang_hint = 'python' and text is not null").join(parsed, "object", "left_anti")
    return select_records(rows, kind="diagnostic", path=F.col("path"), severity="warning", code="L998", message="Syntax tree cannot be read", line=1, col=1)


def complexity(facts: DataFrame) -> DataFrame:
    """(object, *METRICS) of each object that parses. A function's is one and its decisions, those of functions in it
    included; an object's is the sum over its functions."""
    decisions = facts.where("fact = 'decision'").select("object", F.explode("ids").alias("function"), "n").groupBy("object", "function").agg(F.sum("n").alias("n"))
    functions = facts.where("fact = 'function'").select("object", F.col("n").alias("function"))
    each = functions.join(decisions, ["object", "function"], "left").select("object", (1 + F.coalesce("n", F.lit(0))).alias("n"))
    by_function = each.groupBy("object").agg(F.sum("n").alias("complexity"), F.max("n").alias("max_complexity"), F.count("*").alias("function_count"))
    count = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")))
    counts = facts.where("fact = 'count'").groupBy("object").agg(count("class").alias("class_count"), count("import").alias("import_count"))
    every = facts.where("fact = 'module'").select("object")
    return every.join(by_function, "object", "left").join(counts, "object", "left").select("object", *[F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in METRICS])


def complexity_records(facts: DataFrame, files: DataFrame) -> DataFrame:
    rows = files.where("lang_hint = 'python'").select("shard_id", "path", "object").join(complexity(facts), "object")
    return rows.select("shard_id", F.explode(F.array(*[record(kind="metric", path=F.col("path"), metric=m, value_num=F.col(m)) for m in METRICS])).alias("r")).select("shard_id", "r.*")


def symbol_records(facts: DataFrame, files: DataFrame) -> DataFrame:
    symbols = select_records(of_files(facts, files, "symbol"), kind="symbol", path=F.col("path"), name=F.col("name"), symbol_type=F.col("label"), line=F.col("line"), col=F.col("col"), scope=F.col("scope"))
    edges = select_records(of_files(facts, files, "edge"), kind="edge", path=F.col("path"), edge_type=F.col("label"), target=F.col("name"), line=F.col("line"))
    return symbols.unionByName(edges)


def _last(rows: DataFrame) -> DataFrame:
    """The last row for each object and name."""
    order = Window.partitionBy("object", "name").orderBy(F.desc("seq"))
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def unused_imports(facts: DataFrame) -> DataFrame:
    """(object, name, line)."""
    used = facts.where("fact = 'use'").select("object", "name")
    return _last(facts.where("fact = 'import'")).join(used, ["object", "name"], "left_anti").select("object", "name", "line")


def unused_variables(facts: DataFrame) -> DataFrame:
    """(object, name, line) of names last bound as variables."""
    used = facts.where("fact = 'use'").select("object", "name")
    last = _last(facts.where("fact = 'definition'")).where(F.col("label") == "variable").where(~F.col("name").startswith("_"))
    return last.join(used, ["object", "name"], "left_anti").select("object", "name", "line")


def shadowing(facts: DataFrame) -> DataFrame:
    """(object, name, label, line) of sites whose name an enclosing scope has bound before."""
    sites = facts.where("fact = 'site'").select("object", "name", "label", "line", "seq", F.explode("ids").alias("scope"))
    bound = facts.where("fact = 'binding'").groupBy("object", "name", F.col("ids")[0].alias("scope")).agg(F.min("seq").alias("since"))
    hit = sites.join(bound, ["object", "name", "scope"]).where("since < seq")
    return hit.select("object", "name", "label", "line", "seq").distinct().drop("seq")


def lint_records(facts: DataFrame, files: DataFrame, imports: bool = True, variables: bool = True, shadows: bool = True) -> DataFrame:
    found = lambda df, code, severity, message: df.select("object", F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"), "line")
    name = F.col("name")
    rules = [
        found(unused_imports(facts), "L101", "warning", F.concat(F.lit("Unused import '"), name, F.lit("'"))).where(F.lit(imports)),
        found(unused_variables(facts), "L102", "warning", F.concat(F.lit("Unused variable '"), name, F.lit("'"))).where(F.lit(variables)),
        found(shadowing(facts), "L103", "info", F.concat("label", F.lit(" '"), name, F.lit("' shadows variable from outer scope"))).where(F.lit(shadows)),
    ]
    rows = files.where("lang_hint = 'python'").select("shard_id", "path", "object").join(union_records(*rules), "object")
    return select_records(rows, kind="diagnostic", path=F.col("path"), severity=F.col("severity"), code=F.col("code"), message=F.col("message"), line=F.col("line"), col=1)

"""Queries over output records. Each takes and returns DataFrames, so a stored batch and a computed one answer alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclake.functions.scalar import display_path

#: What a missing value is counted as, by field; other fields count as unknown.
MISSING = {"severity": "none", "code": "none"}
LIMITS = {"errors": 50, "files": 100, "top": 10}


def _where(df: DataFrame, **equal: str | None) -> DataFrame:
    """Equality filters; None and the empty string mean no filter."""
    for column, value in equal.items():
        if value:
            df = df.where(F.col(column) == value)
    return df


def _path_contains(df: DataFrame, pattern: str | None) -> DataFrame:
    return df.where(F.contains(F.lower("path"), F.lit(pattern.lower()))) if pattern else df


def outputs(records: DataFrame, kind: str | None = None, path_pattern: str | None = None) -> DataFrame:
    return _path_contains(_where(records, kind=kind), path_pattern)


def diagnostics(records: DataFrame, severity: str | None = None, code: str | None = None, path_pattern: str | None = None) -> DataFrame:
    return _path_contains(_where(records, kind="diagnostic", severity=severity, code=code), path_pattern)


def files_with_kind(records: DataFrame, kind: str) -> DataFrame:
    return _where(records, kind=kind).select("path").distinct()


def failed_files(records: DataFrame) -> DataFrame:
    return diagnostics(records, severity="error").select("path").distinct()


def errors(records: DataFrame, tasks: list[str], limit: int = LIMITS["errors"]) -> DataFrame:
    """Errors of all tasks in the plan's order, the first `limit` of them."""
    place = F.array_position(F.array(*map(F.lit, tasks)), F.col("task_id"))
    return diagnostics(records, severity="error").where(F.col("task_id").isin(tasks)).orderBy(place, "shard_id", "path", "seq").limit(limit)


def inspect(records: DataFrame, path: str, kinds: list[str] | None = None) -> DataFrame:
    """All records of one file."""
    found = records.where(display_path(F.col("path")) == display_path(F.lit(path)))
    found = found.where(F.col("kind").isin(kinds)) if kinds else found
    return found.orderBy("task_id", "kind", F.coalesce("severity", F.lit("")), F.coalesce("code", F.lit("")), F.coalesce("line", F.lit(0)), "seq")


def files(index: DataFrame, limit: int = LIMITS["files"]) -> DataFrame:
    return index.orderBy("path_key", "path").limit(limit)


def with_language(records: DataFrame, index: DataFrame) -> DataFrame:
    """records with lang of their file. The index is one row a path; Spark broadcasts it where it is small enough."""
    return records.join(index.select("path", F.col("lang_hint").alias("lang")), "path", "left")


def group_value(field: str) -> Column:
    return F.coalesce(F.col(field).cast("string"), F.lit(MISSING.get(field, "unknown")))


def stats(records: DataFrame, group_by: str, index: DataFrame | None = None) -> DataFrame:
    """(value, n) by kind, severity, code, lang or any field of a record."""
    rows = with_language(records, index) if group_by == "lang" else records
    return rows.groupBy(group_value(group_by).alias("value")).agg(F.count("*").alias("n"))


def stats_all(records: DataFrame, index: DataFrame, groups: tuple[str, ...] = ("kind", "lang", "severity", "code")) -> DataFrame:
    """(task_id, group, value, n) for all groups at once: one aggregation over grouping sets."""
    rows = with_language(records, index).select("task_id", *[group_value(g).alias(g) for g in groups])
    sets = rows.groupingSets([["task_id", F.col(g)] for g in groups], "task_id", *groups).agg(F.count("*").alias("n"), *[F.grouping(g).alias(f"g_{g}") for g in groups])
    name, value = F, F
    for g in groups:
        name, value = name.when(F.col(f"g_{g}") == 0, F.lit(g)), value.when(F.col(f"g_{g}") == 0, F.col(g))
    return sets.select("task_id", name.alias("group"), value.alias("value"), "n")


def top(records: DataFrame, group_by: str, limit: int = LIMITS["top"], index: DataFrame | None = None) -> DataFrame:
    return stats(records, group_by, index).orderBy(F.desc("n"), "value").limit(limit)


def task_summary(records: DataFrame) -> DataFrame:
    """(task_id, outputs, diagnostics, errors, warnings, files, failed_files) of each task."""
    is_diagnostic = F.col("kind") == "diagnostic"
    of = lambda s: F.count_if(is_diagnostic & (F.col("severity") == s))
    bad = F.when(is_diagnostic & (F.col("severity") == "error"), F.col("path"))
    return records.groupBy("task_id").agg(F.count("*").alias("outputs"), F.count_if(is_diagnostic).alias("diagnostics"), of("error").alias("errors"), of("warning").alias("warnings"), F.count_distinct("path").alias("files"), F.count_distinct(bad).alias("failed_files"))


def batch_summary(records: DataFrame) -> DataFrame:
    """outputs, diagnostics, errors and warnings by task, and of all tasks where task_id is null."""
    is_diagnostic = F.col("kind") == "diagnostic"
    of = lambda s: F.count_if(is_diagnostic & (F.col("severity") == s))
    return records.rollup("task_id").agg(F.count("*").alias("outputs"), F.count_if(is_diagnostic).alias("diagnostics"), of("error").alias("errors"), of("warning").alias("warnings"))


def page(df: DataFrame, number: int, size: int = 50) -> DataFrame:
    """A page of an ordered DataFrame; pages are numbered from 0."""
    return df.offset(number * size).limit(size)


def files_without(index: DataFrame, records: DataFrame, kind: str) -> DataFrame:
    return index.join(_where(records, kind=kind).select("path"), "path", "left_anti")


def files_with(index: DataFrame, records: DataFrame, kind: str) -> DataFrame:
    return index.join(_where(records, kind=kind).select("path"), "path", "left_semi")

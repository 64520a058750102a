"""Comparing two batches: one aggregation of both by the records' keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srclake.functions.scalar import severity_rank
from srclake.schemas import RECORD

#: Fields in which records of two batches differ anyway, and are not compared.
VOLATILE = ("ts", "timestamp", "run_id", "shard_id", "batch_id", "snapshot_id", "seq", "schema_version")


def normalised(records: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    return records.drop(*VOLATILE, *ignore)


def record_key(fields: Sequence[str] | None = None) -> Column:
    """What makes a record the same in both batches: a struct by kind, or of the given fields."""
    if fields:
        return F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields])
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    number = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    is_kind = lambda *k: F.col("kind").isin(*k)
    name = F.when(is_kind("metric"), text("metric")).when(is_kind("symbol"), text("name")).when(is_kind("diagnostic"), text("code")).when(is_kind("ast"), text("object")).otherwise("")
    line = F.when(is_kind("diagnostic", "symbol"), number("line")).otherwise(F.lit(0).cast("long"))
    col = F.when(is_kind("diagnostic"), number("col")).otherwise(F.lit(0).cast("long"))
    return F.struct(text("kind").alias("kind"), text("path").alias("path"), line.alias("line"), col.alias("col"), name.alias("name"))


def _order(tasks: Sequence[str]) -> Column:
    """The place of a record among those with its key."""
    place = F.array_position(F.array(*map(F.lit, tasks)), F.col("task_id")) if tasks else F.col("task_id")
    return F.struct(place.alias("task"), "shard_id", "path", "seq")


def last_of_key(records: DataFrame, fields: Sequence[str] | None = None, tasks: Sequence[str] = ()) -> DataFrame:
    """The last record of each key, by the tasks' order in the plan, shard, path and seq; as columns key and record."""
    kept = [c for c in RECORD if c in records.columns]
    return records.groupBy(record_key(fields).alias("key")).agg(F.max_by(F.struct(*kept), _order(tasks)).alias("record"))


def diff(a: DataFrame, b: DataFrame, fields: Sequence[str] | None = None, tasks: Sequence[str] = (), kind: str | None = None) -> DataFrame:
    """(key, change, old, new): change is added, removed or changed. Equal records are in no row.

    Both batches go into one aggregation, so they are shuffled once and not joined; maxima by key are partially aggregated,
    so a key with many records doesn't gather them in one task."""
    a, b = (x.where(F.col("kind") == kind) if kind else x for x in (a, b))
    kept = [c for c in RECORD if c in a.columns]
    rows = lambda df, old: df.select(record_key(fields).alias("key"), F.lit(old).alias("before"), F.struct(*kept).alias("record"), _order(tasks).alias("at"))
    last = lambda before: F.max_by(F.when(F.col("before") == before, F.col("record")), F.when(F.col("before") == before, F.col("at")))
    both = rows(a, True).unionAll(rows(b, False)).groupBy("key").agg(last(True).alias("old"), last(False).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.withColumn("change", change).where("change is not null").select("key", "change", "old", "new")


def diff_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count("*").alias("n"))


def diagnostic_changes(a: DataFrame, b: DataFrame, tasks: Sequence[str] = ()) -> DataFrame:
    """diff of diagnostics with column verdict: regression (new, or of higher severity), improvement (gone, or of lower
    severity), or unchanged (differs in something else)."""
    changes = diff(a, b, tasks=tasks, kind="diagnostic")
    before, after = severity_rank(F.col("old.severity")), severity_rank(F.col("new.severity"))
    worse = (F.col("change") == "added") | (F.col("change") == "changed") & (after < before)
    better = (F.col("change") == "removed") | (F.col("change") == "changed") & (after > before)
    return changes.withColumn("verdict", F.when(worse, "regression").when(better, "improvement").otherwise("unchanged"))


def regressions(a: DataFrame, b: DataFrame) -> DataFrame:
    """The new records."""
    return diagnostic_changes(a, b).where("verdict = 'regression'").select("new.*")


def improvements(a: DataFrame, b: DataFrame) -> DataFrame:
    """The old records."""
    return diagnostic_changes(a, b).where("verdict = 'improvement'").select("old.*")


def numbered(records: DataFrame) -> DataFrame:
    """records with n, their place among the records of their kind and path, from 0."""
    order = Window.partitionBy("kind", "path").orderBy("task_id", "shard_id", "seq")
    return records.withColumn("n", F.row_number().over(order).cast("long") - 1)


def not_in(a: DataFrame, b: DataFrame, columns: Sequence[str] = tuple(RECORD)) -> DataFrame:
    """Records of a that b lacks, counting repeated ones, in all columns."""
    return a.select(*columns).exceptAll(b.select(*columns))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(differs long): how many rows only one of a and b has, counting repeated ones. Each is computed once."""
    sides = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(-1)))
    net = sides.groupBy(*a.columns).agg(F.abs(F.sum("side")).alias("rows"))
    return net.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("differs"))


def equivalent(a: DataFrame, b: DataFrame, columns: Sequence[str] = tuple(RECORD)) -> bool:
    return not_in(a, b, columns).isEmpty() and not_in(b, a, columns).isEmpty()

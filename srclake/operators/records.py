"""Building, reading and writing output records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srclake.schemas import RECORD, RUN, SCHEMA_VERSION


def record(**fields: Column | str | int) -> Column:
    """A struct with all fields of a record; those not given are null."""
    value = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(*[(value(fields[k]) if k in fields else F.lit(None)).cast(t).alias(k) for k, t in RECORD.items()])


def explode_records(df: DataFrame, records: Column, keep: tuple[str, ...] = ("shard_id",)) -> DataFrame:
    """A row for each record of an array of records."""
    return df.select(*keep, F.explode(records).alias("r")).select(*keep, "r.*")


def select_records(df: DataFrame, keep: tuple[str, ...] = ("shard_id",), **fields: Column | str | int) -> DataFrame:
    return df.select(*keep, record(**fields).alias("r")).select(*keep, "r.*")


def union_records(first: DataFrame, *more: DataFrame) -> DataFrame:
    for df in more:
        first = first.unionByName(df)
    return first


def enrich(records: DataFrame, snapshot_id: str, batch_id: str, task_id: str, ts: Column | None = None) -> DataFrame:
    """Adds the run's identity. seq orders a file's records of a task by their content: by kind, line and column."""
    key = F.xxhash64(*RECORD)  # of equal records, either order is the same
    run = {"schema_version": F.lit(SCHEMA_VERSION), "snapshot_id": F.lit(snapshot_id), "batch_id": F.lit(batch_id), "task_id": F.lit(task_id), "shard_id": F.col("shard_id"), "ts": ts if ts is not None else F.current_timestamp()}
    out = records.withColumns({k: v.cast(RUN[k]) for k, v in run.items() if k != "shard_id"})
    order = Window.partitionBy("shard_id", "path").orderBy("kind", F.coalesce("line", F.lit(0)), F.coalesce("col", F.lit(0)), F.coalesce("code", "metric", "name", "target", F.lit("")), key)
    out = out.withColumn("seq", F.row_number().over(order).cast("bigint") - 1)
    return out.select(*RUN, *RECORD, F.lit(None).cast("string").alias("extra"))

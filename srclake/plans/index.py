"""A materialised aggregate of a batch that answers counts without reading its records, as long as it fits them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srclake.operators import query
from srclake.operators.files import fingerprint
from srclake.plans.store import Store, _path
from srclake.schemas import RECORD, RUN

SCHEMA_VERSION = 1
GROUPS = ("kind", "lang", "severity", "code")


def _folder(store: Store, batch_id: str) -> str:
    return f"{store.root}/indexes/{batch_id}"


def source_fingerprint(store: Store, batch_id: str) -> str:
    """Of the batch's records and its snapshot's index, in any order."""
    records = fingerprint(store.outputs(batch_id), ("task_id", "shard_id", *RECORD)).first()[0]
    index = fingerprint(store.files(store.load_batch(batch_id)["snapshot_id"]), ("path", "object", "lang_hint")).first()[0]
    return f"{records}:{index}"


def build(store: Store, batch_id: str, verify: bool = False) -> dict:
    """Writes the counts of all groups; verify: also compare each with a scan."""
    snapshot = store.load_batch(batch_id)["snapshot_id"]
    stats = query.stats_all(store.outputs(batch_id), store.files(snapshot), GROUPS)
    stats.coalesce(1).write.mode("overwrite").parquet(f"{_folder(store, batch_id)}/stats")
    tasks = sorted(r["task_id"] for r in store.tasks(batch_id).collect())
    # Records by task, kind and severity: what filters on those reads is a folder.
    rows = store.outputs(batch_id).withColumn("severity_folder", F.coalesce("severity", F.lit("none")))
    rows.drop("batch_id").repartition("task_id", "kind", "severity_folder", F.pmod(F.xxhash64("path"), F.lit(store._parts()))).sortWithinPartitions("path", "seq").write.mode("overwrite").partitionBy("task_id", "kind", "severity_folder").parquet(f"{_folder(store, batch_id)}/records")
    meta = (SCHEMA_VERSION, snapshot, batch_id, tasks, source_fingerprint(store, batch_id))
    frame = store.spark.createDataFrame([meta], "cache_schema_version int, snapshot_id string, batch_id string, tasks array<string>, fingerprint string")
    frame.withColumn("built_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{_folder(store, batch_id)}/meta")
    bad = [g for g in GROUPS if verify and not _same(store, batch_id, g)]
    return {"batch_id": batch_id, "groups": list(GROUPS), "fingerprint": meta[-1], "differs": bad}


def _same(store: Store, batch_id: str, group: str) -> bool:
    scan, cached = stats(store, batch_id, group, use_index=False), _cached(store, batch_id, group)
    return scan.exceptAll(cached).isEmpty() and cached.exceptAll(scan).isEmpty()


def is_valid(store: Store, batch_id: str) -> bool:
    if not store._exists(f"{_folder(store, batch_id)}/meta"):
        return False
    meta = store.spark.read.parquet(f"{_folder(store, batch_id)}/meta").first()
    batch = store.load_batch(batch_id)
    tasks = sorted(r["task_id"] for r in store.tasks(batch_id).collect())
    return (meta["cache_schema_version"], meta["snapshot_id"], meta["batch_id"], meta["tasks"]) == (SCHEMA_VERSION, batch["snapshot_id"], batch_id, tasks) and meta["fingerprint"] == source_fingerprint(store, batch_id)


def delete(store: Store, batch_id: str) -> None:
    path = _path(store.spark, _folder(store, batch_id))
    path.getFileSystem(store.spark._jsc.hadoopConfiguration()).delete(path, True)


def _cached(store: Store, batch_id: str, group: str, task_id: str | None = None) -> DataFrame:
    df = store.spark.read.parquet(f"{_folder(store, batch_id)}/stats").where(F.col("group") == group)
    df = df.where(F.col("task_id") == task_id) if task_id else df
    return df.groupBy("value").agg(F.sum("n").alias("n"))


def stats(store: Store, batch_id: str, group: str, task_id: str | None = None, use_index: bool | None = None) -> DataFrame:
    """query.stats of a stored batch: from the index if it is valid (or use_index says so), else from the records."""
    if use_index is None:
        use_index = group in GROUPS and is_valid(store, batch_id)
    if use_index:
        return _cached(store, batch_id, group, task_id)
    return query.stats(store.outputs(batch_id, task_id), group, store.files(store.load_batch(batch_id)["snapshot_id"]))


def _records(store: Store, batch_id: str) -> DataFrame:
    return store.spark.read.schema(", ".join(f"{k} {t}" for k, t in (RUN | RECORD).items() if k != "batch_id") + ", extra string, severity_folder string").parquet(f"{_folder(store, batch_id)}/records")


def outputs_by_kind(store: Store, batch_id: str, task_id: str, kind: str | None = None) -> DataFrame:
    """(path, kind, object, format, seq) of a task's records: from the index if it is valid, else from the records."""
    rows = _records(store, batch_id) if is_valid(store, batch_id) else store.outputs(batch_id)
    rows = rows.where(F.col("task_id") == task_id)
    return (rows.where(F.col("kind") == kind) if kind else rows).select("path", "kind", "object", "format", "seq")


def diagnostics_by_severity(store: Store, batch_id: str, task_id: str, severity: str | None = None) -> DataFrame:
    """(path, severity, code, message, line, col, seq) of a task's diagnostics, likewise."""
    valid = is_valid(store, batch_id)
    rows = (_records(store, batch_id) if valid else store.outputs(batch_id)).where((F.col("task_id") == task_id) & (F.col("kind") == "diagnostic"))
    folder = F.col("severity_folder" if valid else "severity")
    return (rows.where(folder == severity) if severity else rows).select("path", "severity", "code", "message", "line", "col", "seq")


def stat(store: Store, batch_id: str, group: str, value: str) -> int:
    row = stats(store, batch_id, group).where(F.col("value") == value).first()
    return row["n"] if row else 0

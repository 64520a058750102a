"""Operators on file indexes and shard states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclake.schemas import SHARDS_IN_ALL


def new_objects(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Of incoming(object, content) one row for each object that is not stored."""
    return incoming.join(stored.select("object"), "object", "left_anti").dropDuplicates(["object"])


def missing_objects(records: DataFrame, stored: DataFrame) -> DataFrame:
    return records.where("object is not null").select("object").distinct().join(stored.select("object"), "object", "left_anti")


def shard_histogram(index: DataFrame) -> DataFrame:
    return index.groupBy("shard_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def totals(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))


def case_collisions(index: DataFrame) -> DataFrame:
    """(first, second): paths that differ in case alone. Only keys with two paths or more are joined with themselves."""
    paths = index.select("path_key", "path").distinct()
    shared = paths.groupBy("path_key").agg(F.count("*").alias("n")).where("n > 1").select("path_key")
    some = paths.join(shared, "path_key", "left_semi")
    return some.alias("a").join(some.alias("b"), (F.col("a.path_key") == F.col("b.path_key")) & (F.col("a.path") < F.col("b.path"))).select(F.col("a.path").alias("first"), F.col("b.path").alias("second"))


def all_shards(spark: SparkSession) -> DataFrame:
    return spark.range(SHARDS_IN_ALL).select(F.lower(F.lpad(F.hex("id"), 2, "0")).alias("shard_id"))


def initial_states(tasks: DataFrame) -> DataFrame:
    """A ready state for each task and shard: 256 rows a task, made by explode."""
    shards = F.transform(F.sequence(F.lit(0), F.lit(SHARDS_IN_ALL - 1)), lambda i: F.lower(F.lpad(F.hex(i), 2, "0")))
    return tasks.select("batch_id", "task_id", F.explode(shards).alias("shard_id")).withColumns({"status": F.lit("ready"), "attempt": F.lit(0)})


def open_dependencies(tasks: DataFrame, states: DataFrame) -> DataFrame:
    """(task_id, shard_id, dependency): dependencies whose shard is not done; a state that is missing is not done."""
    wanted = tasks.select("task_id", F.explode("depends_on").alias("dependency"))
    own = states.select("task_id", "shard_id").distinct()
    done = states.where("status = 'done'").select(F.col("task_id").alias("dependency"), "shard_id")
    return own.join(wanted, "task_id").join(done, ["dependency", "shard_id"], "left_anti").select("task_id", "shard_id", "dependency")


def eligible_shards(tasks: DataFrame, states: DataFrame, index: DataFrame) -> DataFrame:
    """(task_id, shard_id) to run: with files, not done, and no dependency open."""
    rows = states.where("status is distinct from 'done'").select("task_id", "shard_id")
    rows = rows.join(index.select("shard_id").distinct(), "shard_id", "left_semi")
    return rows.join(open_dependencies(tasks, states).select("task_id", "shard_id"), ["task_id", "shard_id"], "left_anti")


def task_status(states: DataFrame, index: DataFrame) -> DataFrame:
    """(task_id, shards, done, failed, running, ready, status) over the shards with files. A task without any is done."""
    used = states.join(index.select("shard_id").distinct(), "shard_id", "left_semi")
    count = lambda s: F.count_if(F.col("status") == s)
    n = used.groupBy("task_id").agg(F.count("*").alias("shards"), count("done").alias("done"), count("failed").alias("failed"), count("running").alias("running"), count("ready").alias("ready"))
    every = states.select("task_id").distinct().join(n, "task_id", "left").fillna(0)
    status = F.when(F.col("failed") > 0, "failed").when(F.col("done") == F.col("shards"), "done").when((F.col("running") > 0) | (F.col("done") > 0), "running").otherwise("pending")
    return every.withColumn("status", status)


def out_of_order(tasks: DataFrame) -> DataFrame:
    """(task_id, dependency): dependencies that the plan does not have before the task."""
    place = tasks.select(F.col("task_id").alias("dependency"), F.col("position").alias("at"))
    wanted = tasks.select("task_id", "position", F.explode("depends_on").alias("dependency"))
    return wanted.join(place, "dependency", "left").where("at is null or at >= position").select("task_id", "dependency")


def fingerprint(records: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row: a digest of all rows in any order. Sums of two hashes and the count add up partition by partition."""
    row = [F.col(c) for c in columns]
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), *row).cast("decimal(38,0)"))
    return records.agg(F.sha2(F.concat_ws(":", F.count("*"), F.coalesce(part(1), F.lit(0)), F.coalesce(part(2), F.lit(0))), 256).alias("fingerprint"))

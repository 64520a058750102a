"""The event log as a stream: windowed counts, sessions of users, and shard states kept up to date."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema: str, files_at_a_time: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_a_time).parquet(folder)


def windowed(events: DataFrame, ts: str, key: str, length: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, key, n) of tumbling or sliding windows; events later than `late` after the newest are left out."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    counts = events.withWatermark(ts, late).groupBy(window, key).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of sessions that a gap ends."""
    counts = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return counts.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def latest_states(events: DataFrame) -> DataFrame:
    """(batch_id, task_id, shard_id, event, attempt): the last event of each shard."""
    order = F.struct("ts", "attempt")
    return events.where("shard_id is not null").groupBy("batch_id", "task_id", "shard_id").agg(F.max_by("event", order).alias("event"), F.max("attempt").alias("attempt"))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which the driver and all executors share; elsewhere a stream's state and result would be lost."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and spark.sparkContext.master.startswith("local"):
        path = "file://" + tempfile.mkdtemp(prefix="srclake-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return path.rstrip("/")


def run_available(result: DataFrame, folder: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Processes what there is and ends. In append mode a window is written when the watermark has passed it, to Parquet files
    under folder/result; each: gets every micro-batch instead. The state is under folder/state."""
    w = result.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    (w.foreachBatch(each) if each else w.format("parquet").option("path", f"{folder}/result")).start().awaitTermination()


def finished(result: DataFrame, folder: str) -> DataFrame:
    """The whole result of counts over a source that has ended: each micro-batch's updates are appended as Parquet with their
    number, and of a group's updates the last counts, so that no window waits for a watermark that never comes."""
    keys = [c for c in result.columns if c != "n"]
    run_available(result, folder, "update", lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{folder}/result/update={k}"))
    spark = result.sparkSession
    updates = spark.read.schema(f"{', '.join(f'`{n}` {t}' for n, t in result.dtypes)}, batch long").parquet(f"{folder}/result")
    return updates.groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))

"""A store: Parquet tables under one root that all executors see.

Outputs are partitioned by batch, task and shard; a commit overwrites the partitions it has and no others, so it replaces
whole shards. States and events are small; of a shard's states the one with the highest attempt and latest time counts.
"""

from __future__ import annotations

import json
import os
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srclake import schemas
from srclake.functions.scalar import canonical_path, content_ref, is_text, language, path_key, shard_prefix
from srclake.operators.files import initial_states, new_objects
from srclake.operators.python_facts import FACTS
from srclake.plans.errors import EngineError
from srclake.plans.pipelines import PIPELINES, topological
from srclake.sources.dirsnap import DirectorySource

TABLES = {"files": schemas.FILES, "objects": schemas.OBJECTS, "snapshots": schemas.SNAPSHOTS, "batches": schemas.BATCHES, "tasks": schemas.TASKS, "states": schemas.SHARDS + ", at timestamp", "events": schemas.EVENTS, "outputs": schemas.OUTPUTS, "facts": "batch_id string, shard_id string, " + FACTS}
PARTITIONS = {"files": ["snapshot_id", "shard_id"], "objects": ["prefix"], "outputs": ["batch_id", "task_id", "shard_id"], "facts": ["batch_id", "shard_id"], "tasks": ["batch_id"], "states": ["batch_id"], "events": ["batch_id"]}
PRODUCER = {"name": "srclake", "version": "1.0"}


def new_id(prefix: str) -> str:
    return f"{prefix}-{datetime.now(UTC):%Y%m%d-%H%M%S}-{uuid.uuid4().hex[:8]}"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        if not self._exists(f"{self.root}/store.json"):
            raise EngineError("STORE_NOT_FOUND", path=root)

    @classmethod
    def init(cls, spark: SparkSession, root: str, allow_reinit: bool = False) -> Store:
        """A new store; a folder that has other things in it, or a store already, is refused unless allow_reinit."""
        path = _path(spark, root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path) and len(fs.listStatus(path)) and not allow_reinit:
            raise EngineError("STORE_EXISTS", path=root)
        fs.mkdirs(path)
        text = json.dumps({"schema_name": "srclake.store", "schema_version": schemas.SCHEMA_VERSION, "producer": PRODUCER, "created_at": f"{datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}"}, sort_keys=True)
        out = fs.create(_path(spark, f"{root.rstrip('/')}/store.json"), True)
        out.write(bytearray(text.encode()))
        out.close()
        return cls(spark, root)

    @classmethod
    def ensure(cls, spark: SparkSession, root: str) -> Store:
        try:
            return cls(spark, root)
        except EngineError:
            return cls.init(spark, root)

    def _exists(self, path: str) -> bool:
        p = _path(self.spark, path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def metadata(self) -> dict:
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.root}/store.json").collect()))

    def has(self, table: str) -> bool:
        return self._exists(f"{self.root}/{table}")

    def read(self, table: str) -> DataFrame:
        schema = TABLES[table]
        if not self.has(table):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}").select(*[c.split()[0] for c in _columns(schema)])

    def _write(self, df: DataFrame, table: str, mode: str = "append") -> None:
        w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
        w.partitionBy(*PARTITIONS.get(table, [])).parquet(f"{self.root}/{table}")

    # snapshots

    def snapshot(self, source: str, snapshot_id: str | None = None, include_hidden: bool = False, metadata: dict[str, str] | None = None) -> str:
        """Freezes a directory: its files' bytes as objects, its files as an index, and warnings of what was left out."""
        self.spark.dataSource.register(DirectorySource)
        found = self.spark.read.format("dirsnap").option("include_hidden", str(include_hidden).lower()).load(source)
        return self.snapshot_frame(found, snapshot_id, {"type": "directory", "path": os.path.abspath(source)}, include_hidden, metadata)

    def snapshot_frame(self, found: DataFrame, snapshot_id: str | None = None, source: dict[str, str] | None = None, include_hidden: bool = False, metadata: dict[str, str] | None = None) -> str:
        """The same of a DataFrame(path, content, ...)."""
        snapshot_id = snapshot_id or new_id("snap")
        if not self.read("snapshots").where(F.col("snapshot_id") == snapshot_id).isEmpty():
            raise EngineError("SNAPSHOT_INVALID", snapshot_id=snapshot_id)
        # Staged, so that the source is read and hashed once and the objects, the index and the warnings are of one moment.
        staging = f"{self.root}/indexes/staging-{uuid.uuid4().hex}"
        rows = found.select(canonical_path(F.col("path")).alias("p"), "path", "content", content_ref(F.col("content")).alias("object"))
        rows.write.parquet(staging)
        rows = self.spark.read.schema(rows.schema).parquet(staging)
        good = rows.where("p.error is null and content is not null")
        self.put(good.select("object", "content"))
        index = good.select(F.lit(snapshot_id).alias("snapshot_id"), F.lit(schemas.SCHEMA_VERSION).alias("schema_version"), F.col("p.path").alias("path"), path_key(F.col("p.path")).alias("path_key"), "object", F.octet_length("content").cast("long").alias("size"), language(F.col("p.path")).alias("lang_hint"), shard_prefix(F.col("object")).alias("shard_id"))
        self._write(self._dealt(index, "shard_id").sortWithinPartitions("shard_id", "path_key", "path"), "files")
        own = self.files(snapshot_id)
        warn = lambda kind, path, message: F.struct(F.lit(kind).alias("type"), path.alias("path"), message.alias("message"))
        bad = rows.where("p.error is not null").select(warn("invalid_path", F.col("path"), F.col("p.reason")).alias("w"))
        lost = rows.where("p.error is null and content is null").select(warn("unreadable", F.col("path"), F.lit("cannot be read")).alias("w"))
        shared = own.groupBy("path_key").agg(F.count("*").alias("n")).where("n > 1").select(warn("case_collision", F.col("path_key"), F.format_string("%d paths", "n")).alias("w"))
        warnings = bad.unionAll(lost).unionAll(shared).agg(F.array_sort(F.collect_list("w")).alias("warnings"))
        total = own.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))
        where = source or {"type": "table", "path": ""}
        head = F.struct(F.lit(where["type"]).alias("type"), F.lit(where["path"]).alias("path"))
        one = total.join(warnings, F.lit(True)).select(F.lit(snapshot_id).alias("snapshot_id"), F.lit(schemas.SCHEMA_VERSION).alias("schema_version"), F.current_timestamp().alias("created_at"), head.alias("source"), "file_count", "total_bytes", F.lit(include_hidden).alias("include_hidden"), _map(metadata).alias("metadata"), "warnings")
        self._write(one, "snapshots")
        path = _path(self.spark, staging)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return snapshot_id

    def put(self, objects: DataFrame) -> None:
        """Stores objects(object, content) that are not there yet."""
        rows = objects.select("object", "content", F.octet_length("content").cast("long").alias("size"), shard_prefix(F.col("object")).alias("prefix"))
        self._write(new_objects(rows, self.read("objects").select("object")).repartition("prefix", F.pmod(F.xxhash64("object"), F.lit(self._parts()))), "objects")

    def _parts(self) -> int:
        """Tasks, and files, that a shard's rows are dealt to: 256 shards alone are few for a large cluster."""
        return max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 256)

    def _dealt(self, df: DataFrame, *columns: str) -> DataFrame:
        return df.repartition(*columns, F.pmod(F.xxhash64("path"), F.lit(self._parts())))

    def snapshots(self) -> DataFrame:
        return self.read("snapshots").orderBy("snapshot_id")

    def load_snapshot(self, snapshot_id: str) -> DataFrame:
        found = self.read("snapshots").where(F.col("snapshot_id") == snapshot_id)
        if found.isEmpty():
            raise EngineError("SNAPSHOT_NOT_FOUND", snapshot_id=snapshot_id)
        return found

    def files(self, snapshot_id: str) -> DataFrame:
        return self.read("files").where(F.col("snapshot_id") == snapshot_id)

    def get_file(self, snapshot_id: str, path: str) -> DataFrame:
        return self.files(snapshot_id).where(F.col("path") == path)

    def files_with_text(self, snapshot_id: str) -> DataFrame:
        """(path, object, size, lang_hint, shard_id, text, missing): text is null for what is not valid UTF-8 and for what is
        missing from the objects."""
        content = self.read("objects").select("object", "content", "prefix")
        index = self.files(snapshot_id)
        rows = index.join(content, (index["object"] == content["object"]) & (index["shard_id"] == content["prefix"]), "left").drop(content["object"])
        text = F.when(is_text(F.col("content")), F.col("content").cast("string"))
        return rows.select("path", "object", "size", "lang_hint", "shard_id", text.alias("text"), F.col("content").isNull().alias("missing"))

    def save_facts(self, batch_id: str, facts: DataFrame) -> None:
        """What parsing found, once for each object, for the tasks that follow."""
        rows = facts.withColumns({"batch_id": F.lit(batch_id), "shard_id": shard_prefix(F.col("object"))})
        self._write(rows.repartition("shard_id", F.pmod(F.xxhash64("object"), F.lit(self._parts()))).sortWithinPartitions("shard_id", "fact", "object", "seq"), "facts", "overwrite")

    def facts(self, batch_id: str, shards: list[str]) -> DataFrame:
        return self.read("facts").where((F.col("batch_id") == batch_id) & F.col("shard_id").isin(shards)).drop("batch_id", "shard_id")

    def object_bytes(self, ref: str) -> bytes:
        row = self.read("objects").where(F.col("object") == ref).select("content").first()
        if row is None:
            raise EngineError("FILE_NOT_FOUND", path=ref)
        return bytes(row[0])

    # batches

    def init_batch(self, snapshot_id: str, pipeline: str = "full", batch_id: str | None = None, metadata: dict[str, str] | None = None) -> str:
        """A batch with its tasks and a ready state for each of their shards."""
        if pipeline not in PIPELINES:
            raise EngineError("PIPELINE_NOT_FOUND", pipeline=pipeline)
        self.load_snapshot(snapshot_id)
        batch_id = batch_id or new_id("batch")
        if not self.read("batches").where(F.col("batch_id") == batch_id).isEmpty():
            raise EngineError("BATCH_INVALID", batch_id=batch_id)
        tasks = [(batch_id, t["task_id"], i, t["type"], t["depends_on"], {k: json.dumps(v) for k, v in t["config"].items()}) for i, t in enumerate(topological(PIPELINES[pipeline]["tasks"]))]
        frame = self.spark.createDataFrame(tasks, schemas.TASKS)
        self._write(frame, "tasks")
        self._write_states(initial_states(frame))
        self._write(self.spark.range(1).select(F.lit(batch_id).alias("batch_id"), F.lit(snapshot_id).alias("snapshot_id"), F.lit(schemas.SCHEMA_VERSION).alias("schema_version"), F.current_timestamp().alias("created_at"), F.lit(pipeline).alias("pipeline"), _map(metadata).alias("metadata")), "batches")
        self.log(batch_id, "batch_created")
        return batch_id

    def batches(self) -> DataFrame:
        return self.read("batches").orderBy("batch_id")

    def load_batch(self, batch_id: str):
        row = self.read("batches").where(F.col("batch_id") == batch_id).first()
        if row is None:
            raise EngineError("BATCH_NOT_FOUND", batch_id=batch_id)
        return row

    def tasks(self, batch_id: str) -> DataFrame:
        self.load_batch(batch_id)
        return self.read("tasks").where(F.col("batch_id") == batch_id).orderBy("position")

    def states(self, batch_id: str) -> DataFrame:
        """The current state of each task's shards."""
        latest = Window.partitionBy("task_id", "shard_id").orderBy(F.desc("attempt"), F.desc("at"))
        return self.read("states").where(F.col("batch_id") == batch_id).withColumn("r", F.row_number().over(latest)).where("r = 1").drop("r", "at")

    def _write_states(self, states: DataFrame) -> None:
        full = self.spark.createDataFrame([], TABLES["states"]).unionByName(states, allowMissingColumns=True)
        self._write(full.withColumn("at", F.current_timestamp()).coalesce(1), "states")  # 256 rows a task

    def set_states(self, states: DataFrame) -> None:
        self._write_states(states)

    def outputs(self, batch_id: str, task_id: str | None = None, shard_id: str | None = None, kind: str | None = None) -> DataFrame:
        """The stored records; batch, task and shard select folders, kind is pushed to the files."""
        self.load_batch(batch_id)
        df = self.read("outputs").where(F.col("batch_id") == batch_id)
        for column, value in (("task_id", task_id), ("shard_id", shard_id), ("kind", kind)):
            df = df.where(F.col(column) == value) if value else df
        return df

    def commit(self, records: DataFrame) -> None:
        """Replaces the shards that have a record here. Shards without one stay: clear them with clear_shards first."""
        self._write(self._dealt(records, "task_id", "shard_id").sortWithinPartitions("task_id", "shard_id", "kind", "path", "seq"), "outputs", "overwrite")

    def clear_shards(self, batch_id: str, task_id: str, shards: list[str]) -> None:
        for s in shards:  # 256 at most
            path = _path(self.spark, f"{self.root}/outputs/batch_id={batch_id}/task_id={task_id}/shard_id={s}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    # events

    def log(self, batch_id: str, event: str, rows: DataFrame | None = None) -> None:
        base = (self.spark.range(1) if rows is None else rows).withColumns({"ts": F.current_timestamp(), "event": F.lit(event), "batch_id": F.lit(batch_id)})
        named = base.select(*[F.col(c) for c in base.columns if c in [x.split()[0] for x in _columns(schemas.EVENTS)]])
        self._write(self.spark.createDataFrame([], schemas.EVENTS).unionByName(named, allowMissingColumns=True).coalesce(1), "events")

    def events(self, batch_id: str) -> DataFrame:
        return self.read("events").where(F.col("batch_id") == batch_id).orderBy("ts")

    def usage(self) -> DataFrame:
        """(table, bytes, files) on disk."""
        fs = _path(self.spark, self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        rows = []
        for t in TABLES:
            if self.has(t):
                s = fs.getContentSummary(_path(self.spark, f"{self.root}/{t}"))
                rows.append((t, s.getLength(), s.getFileCount()))
        return self.spark.createDataFrame(rows, "table string, bytes long, files long")


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _columns(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]


def _map(values: dict[str, str] | None) -> Column:
    if not values:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])

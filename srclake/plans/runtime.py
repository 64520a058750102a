"""Running a batch: one Spark job for each task over all its eligible shards; Spark's partitions are the parallelism."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srclake.operators import files as file_ops
from srclake.operators import parse, python_facts, python_tasks, query
from srclake.operators.lint_text import TextLint, text_diagnostics
from srclake.operators.records import enrich, union_records
from srclake.plans.errors import EngineError
from srclake.plans.store import Store


#: Each gets files(path, object, lang_hint, shard_id, text, missing), the stored facts of their Python objects and the task's
#: configuration, and gives records.
Executor = Callable[[DataFrame, DataFrame, dict], DataFrame]


def trees(files: DataFrame, facts: DataFrame) -> DataFrame:
    return parse.trees(files).unionByName(python_tasks.trees(facts, files))


def parse_task(files: DataFrame, facts: DataFrame, config: dict) -> DataFrame:
    errors = union_records(python_tasks.error_records(facts, files), parse.lost_files(files, "E9999"))
    return parse.parse_records(files, trees(files, facts), errors, config.get("emit_ast", True), config.get("emit_diagnostics", True), config.get("chunk_threshold", parse.CHUNK))


def analyze_task(files: DataFrame, facts: DataFrame, config: dict) -> DataFrame:
    return union_records(parse.basic_metrics(files), python_tasks.complexity_records(facts, files))


def symbols_task(files: DataFrame, facts: DataFrame, config: dict) -> DataFrame:
    return union_records(python_tasks.symbol_records(facts, files), parse.script_symbols(files))


def lint_task(files: DataFrame, facts: DataFrame, config: dict) -> DataFrame:
    text = {k: config[k] for k in TextLint.__dataclass_fields__ if k in config}
    on = [config.get(k, True) for k in ("check_unused_imports", "check_unused_variables", "check_variable_shadowing")]
    lost = union_records(parse.lost_files(files, "L999"), python_tasks.lost_trees(facts, files))
    return union_records(text_diagnostics(files, TextLint(**text)), python_tasks.lint_records(facts, files, *on), lost)


EXECUTORS: dict[str, Executor] = {"parse": parse_task, "analyze": analyze_task, "symbols": symbols_task, "lint": lint_task}


def run(store: Store, batch_id: str, tasks: list[str] | None = None, on_task: Callable[[str, int, str], None] | None = None, on_shard: Callable[[str, str, str], None] | None = None) -> dict[str, str]:
    """Runs what is eligible, task by task in the plan's order; shards that are done are left alone, failed ones run again.

    A task's shards share a job; if it fails, halves of them run again by themselves, so that only those shards fail that
    cannot be done, and what was stored of them stays. on_task gets the task, the number of its shards and how it ended;
    on_shard the task, the shard and how that ended. Returns task -> done, failed (one shard or more) or skipped (nothing
    eligible)."""
    batch = store.load_batch(batch_id)
    index = store.files(batch["snapshot_id"])
    out = {}
    for task in store.tasks(batch_id).collect():  # a handful
        name = task["task_id"]
        if tasks and name not in tasks:
            continue
        all_tasks, states = store.tasks(batch_id), store.states(batch_id)
        shards = sorted(r["shard_id"] for r in file_ops.eligible_shards(all_tasks, states, index).where(F.col("task_id") == name).collect())  # 256 at most
        if not shards:
            out[name] = "skipped"
            continue
        out[name] = run_shards(store, batch_id, name, shards, on_shard)
        if on_task:
            on_task(name, len(shards), out[name])
    return out


resume = run


def run_shards(store: Store, batch_id: str, task_id: str, shards: list[str], on_shard: Callable[[str, str, str], None] | None = None) -> str:
    """Runs the given shards of one task and commits them; returns done, or failed if any of them did."""
    batch = store.load_batch(batch_id)
    task = store.tasks(batch_id).where(F.col("task_id") == task_id).first()
    if task is None:
        raise EngineError("TASK_NOT_FOUND", task_id=task_id)
    states = store.states(batch_id)
    blocked = file_ops.open_dependencies(store.tasks(batch_id), states).where((F.col("task_id") == task_id) & F.col("shard_id").isin(shards)).first()
    if blocked:
        raise EngineError("COMMAND_ERROR", reason=f"{task_id} needs {blocked['dependency']} of shard {blocked['shard_id']}")
    # 256 rows at most, and fixed: what follows adds to the table that they come from.
    now = states.where((F.col("task_id") == task_id) & F.col("shard_id").isin(shards)).select("batch_id", "task_id", "shard_id", (F.col("attempt") + 1).alias("attempt"))
    own = store.spark.createDataFrame(now.collect(), now.schema)
    store.set_states(own.withColumns({"status": F.lit("running"), "started_at": F.current_timestamp()}))
    store.log(batch_id, "shard_started", own.drop("batch_id"))
    failed = _settle(store, batch, task, own, shards)
    for s in shards if on_shard else ():
        on_shard(task_id, s, "failed" if s in failed else "done")
    return "failed" if failed else "done"


def _config(task) -> dict:
    return {k: json.loads(v) for k, v in (task["config"] or {}).items()}


def records(store: Store, batch_id: str, task, shards: list[str]) -> DataFrame:
    """The records of a task over shards that are parsed, from the stored facts; nothing is stored."""
    snapshot_id = store.load_batch(batch_id)["snapshot_id"]
    files = store.files_with_text(snapshot_id).where(F.col("shard_id").isin(shards))
    return enrich(EXECUTORS[task["type"]](files, store.facts(batch_id, shards), _config(task)), snapshot_id, batch_id, task["task_id"])


def _settle(store: Store, batch, task, own: DataFrame, shards: list[str]) -> set[str]:
    """Runs the shards in one job, or, where that fails, in halves; returns those that failed."""
    batch_id, task_id, began = batch["batch_id"], task["task_id"], time.time()
    now = own.where(F.col("shard_id").isin(shards))
    took = lambda: F.lit(int(1000 * (time.time() - began)))
    try:
        files = store.files_with_text(batch["snapshot_id"]).where(F.col("shard_id").isin(shards))
        config = _config(task)
        if task["type"] == "parse":
            store.save_facts(batch_id, python_facts.python_facts(files, config.get("full_ast", False)))
        facts = store.facts(batch_id, shards)
        store.commit(records(store, batch_id, task, shards))
        if task["type"] == "parse" and config.get("emit_ast", True):
            store.put(parse.tree_objects(trees(files, facts), config.get("chunk_threshold", parse.CHUNK)))
        written = store.outputs(batch_id, task_id).where(F.col("shard_id").isin(shards)).where(F.col("ts") >= F.timestamp_seconds(F.lit(int(began)))).groupBy("shard_id").agg(F.count("*").alias("outputs_written"))
        store.clear_shards(batch_id, task_id, sorted(set(shards) - {r["shard_id"] for r in written.collect()}))
        seen = store.files(batch["snapshot_id"]).groupBy("shard_id").agg(F.count("*").alias("files_processed"))
        done = now.join(written, "shard_id", "left").join(seen, "shard_id", "left").fillna(0, ["outputs_written", "files_processed"])
        store.set_states(done.withColumns({"status": F.lit("done"), "completed_at": F.current_timestamp()}))
        store.log(batch_id, "shard_completed", now.drop("batch_id").withColumn("duration_ms", took()))
        return set()
    except Exception as e:  # a failure of user data must not end the batch; it is kept in the state
        if len(shards) > 1:
            half = len(shards) // 2
            return _settle(store, batch, task, own, shards[:half]) | _settle(store, batch, task, own, shards[half:])
        error = F.struct(F.lit(type(e).__name__).alias("code"), F.lit(str(e)[:2000]).alias("message"))
        store.set_states(now.withColumns({"status": F.lit("failed"), "completed_at": F.current_timestamp(), "error": error}))
        store.log(batch_id, "shard_failed", now.drop("batch_id").withColumns({"error": error, "duration_ms": took()}))
        return set(shards)


def reset(store: Store, batch_id: str, task_id: str, shard_id: str) -> None:
    """Makes a failed shard ready; its attempts are kept."""
    state = store.states(batch_id).where((F.col("task_id") == task_id) & (F.col("shard_id") == shard_id))
    row = state.first()
    if row is None:
        raise EngineError("SHARD_NOT_FOUND", shard_id=shard_id)
    if row["status"] != "failed":
        raise EngineError("INVALID_ARGUMENT", argument=f"shard {shard_id} is {row['status']}")
    store.set_states(store.spark.createDataFrame([(batch_id, task_id, shard_id, "ready", row["attempt"])], "batch_id string, task_id string, shard_id string, status string, attempt int"))
    store.log(batch_id, "shard_retrying")


def status(store: Store, batch_id: str) -> DataFrame:
    index = store.files(store.load_batch(batch_id)["snapshot_id"])
    return file_ops.task_status(store.states(batch_id), index)


def batch_status(store: Store, batch_id: str) -> str:
    """failed before done before running before pending."""
    found = {r["status"] for r in status(store, batch_id).collect()}
    if "failed" in found:
        return "failed"
    return "done" if found == {"done"} else "running" if found & {"done", "running"} else "pending"


def shards(store: Store, batch_id: str, task_id: str, only: str | None = None) -> DataFrame:
    found = store.states(batch_id).where(F.col("task_id") == task_id)
    return (found.where(F.col("status") == only) if only else found).orderBy("shard_id")


def summary(store: Store, batch_id: str) -> DataFrame:
    return query.batch_summary(store.outputs(batch_id))

"""Invariants of a store as executable checks. A check returns what is wrong; nothing wrong is a pass."""

from __future__ import annotations

import difflib
import functools
import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import functions as F

from srclake.operators import diff, query
from srclake.operators import files as file_ops
from srclake.plans import index, registry, runtime
from srclake.plans.errors import EngineError
from srclake.plans.store import TABLES, Store

Check = Callable[[Store, str | None], list[str]]


@dataclass
class Gate:
    gate_id: str
    title: str
    phase: str
    enforced: bool
    tags: tuple[str, ...]
    needs_batch: bool
    check: Check = field(repr=False)
    aliases: tuple[str, ...] = ()


@dataclass
class Result:
    gate_id: str
    enforced: bool
    status: str
    duration_ms: int
    failures: list[str]

    @property
    def passed(self) -> bool:
        return self.status == "passed"


GATES: dict[str, Gate] = {}
#: Other names of gates.
ALIASES = {
    "P1-G1": ("store-schema",),
    "P2-G1": ("pipeline-exec",),
    "P2-G6": ("truth-guard",),
    "P2-G7": ("deps-check",),
    "P3-A1": ("A1", "cache-equiv"),
    "P3-A2": ("A2", "cache-fallback"),
    "P3-A3": ("A3", "cache-rebuild"),
    "P3-A4": ("A4", "cache-guard"),
    "P5-G1": ("workflow-equiv",),
    "P5-G2": ("no-new-truth",),
    "P5-G3": ("resume-equiv",),
    "P5-G4": ("discover",),
    "P5-G5": ("ux-smoke",),
}


def gate(gate_id: str, title: str, *tags: str, enforced: bool = True, needs_batch: bool = True) -> Callable[[Check], Check]:
    """Registers a check; its phase is the number in its id."""

    def add(check: Check) -> Check:
        GATES[gate_id] = Gate(gate_id, title, f"phase{gate_id[1]}", enforced, (f"phase{gate_id[1]}", *tags), needs_batch, check, ALIASES.get(gate_id, ()))
        return check

    return add


@gate("P1-G1", "Store schema validation", "schema", "validation", needs_batch=False)
def _schema(store: Store, _: str | None) -> list[str]:
    missing = [k for k in ("schema_name", "schema_version", "producer", "created_at") if k not in store.metadata()]
    wrong = [t for t in TABLES if store.has(t) and store.spark.read.parquet(f"{store.root}/{t}").columns and set(store.read(t).columns) - set(store.spark.read.parquet(f"{store.root}/{t}").columns)]
    return [f"store.json lacks {k}" for k in missing] + [f"table {t} lacks columns" for t in wrong]


@gate("P2-G1", "Full pipeline execution", "pipeline", "execution")
def _complete(store: Store, batch: str) -> list[str]:
    return [f"{r['task_id']} is {r['status']}" for r in runtime.status(store, batch).collect() if r["status"] != "done"]


@gate("P2-G6", "Truth-store guard", "security", "truth-store", needs_batch=False)
def _known(store: Store, _: str | None) -> list[str]:
    from srclake.plans.store import _path

    path = _path(store.spark, store.root)
    names = {s.getPath().getName() for s in path.getFileSystem(store.spark._jsc.hadoopConfiguration()).listStatus(path)}
    return [f"unexpected entry {n}" for n in sorted(names - {"store.json", "indexes", *TABLES})]


@gate("P2-G7", "Dependency enforcement", "deps", "ordering", enforced=False)
def _ordered(store: Store, batch: str) -> list[str]:
    return [f"{r['task_id']} comes before {r['dependency']}" for r in file_ops.out_of_order(store.tasks(batch)).collect()]


@gate("P3-A1", "Cache equivalence", "cache", "equivalence")
def _equal(store: Store, batch: str) -> list[str]:
    if not index.is_valid(store, batch):
        index.build(store, batch)
    return [f"counts by {g} differ" for g in index.GROUPS if not index._same(store, batch, g)]


@gate("P3-A2", "Cache deletion fallback", "cache", "fallback")
def _fallback(store: Store, batch: str) -> list[str]:
    there = index.is_valid(store, batch)
    before = {tuple(r) for r in index.stats(store, batch, "kind").collect()}
    index.delete(store, batch)
    after = {tuple(r) for r in index.stats(store, batch, "kind").collect()}
    if there:
        index.build(store, batch)  # as it was
    return [] if after == before else ["counts by kind change without the index"]


@gate("P3-A3", "Deterministic rebuild", "cache", "determinism")
def _rebuild(store: Store, batch: str) -> list[str]:
    return [] if index.build(store, batch) == index.build(store, batch) else ["two builds differ"]


@gate("P3-A4", "Cache truth-store guard", "cache", "security")
def _no_side_effect(store: Store, batch: str) -> list[str]:
    before = index.source_fingerprint(store, batch)
    index.build(store, batch)
    return [] if index.source_fingerprint(store, batch) == before else ["building the index changed the records"]


@gate("P5-G1", "No semantic changes", "semantics", "equivalence")
def _same_counts(store: Store, batch: str) -> list[str]:
    """Counts of all groups at once, as the index has them, against a count of each group."""
    records, files = store.outputs(batch), store.files(store.load_batch(batch)["snapshot_id"])
    at_once = query.stats_all(records, files, index.GROUPS).groupBy("group", "value").agg(F.sum("n").alias("n"))
    each = [query.stats(records, g, files).select(F.lit(g).alias("group"), "value", "n") for g in index.GROUPS]
    wrong = functools.reduce(lambda a, b: a.unionAll(b), each).exceptAll(at_once).select("group").distinct().collect()
    return [f"counts by {r['group']} differ" for r in wrong]


@gate("P5-G2", "No new truth stores", "truth", "filesystem", needs_batch=False)
def _no_new(store: Store, _: str | None) -> list[str]:
    """Records, facts, states and events are of batches that are known, and batches of snapshots that are."""
    batches = store.read("batches").select("batch_id")
    tables = [t for t in ("tasks", "states", "events", "outputs", "facts") if store.has(t)]
    stray = [f"{t} has batch {r[0]}, which is not known" for t in tables for r in store.read(t).select("batch_id").distinct().join(batches, "batch_id", "left_anti").limit(5).collect()]
    lost = store.read("batches").join(store.read("snapshots").select("snapshot_id"), "snapshot_id", "left_anti").limit(5)
    return stray + [f"batch {r['batch_id']} has no snapshot" for r in lost.collect()]


@gate("P5-G3", "Determinism preserved", "determinism", "resume", enforced=False)
def _again(store: Store, batch: str) -> list[str]:
    """The records of all shards that are done, made again, are those that are stored. Nothing is written."""
    wrong = []
    for task in store.tasks(batch).collect():
        done = sorted(r["shard_id"] for r in store.states(batch).where((F.col("task_id") == task["task_id"]) & (F.col("status") == "done")).collect())
        again = runtime.records(store, batch, task, done)
        if not diff.equivalent(again, store.outputs(batch, task["task_id"]).where(F.col("shard_id").isin(done))):
            wrong.append(f"{task['task_id']} gives other records")
    return wrong


@gate("P5-G4", "Discoverability coverage", "discoverability", "cli", needs_batch=False)
def _commands(store: Store, _: str | None) -> list[str]:
    from srclake.plans.cli import parser_commands

    return [f"command {n} is in one place only" for n in sorted(set(parser_commands()) ^ {c["name"] for c in registry.commands()})]


@gate("P5-G5", "UX smoke test", "ux", "smoke", enforced=False)
def _smoke(store: Store, batch: str) -> list[str]:
    return [] if runtime.summary(store, batch).where("task_id is null").count() == 1 else ["the summary has no totals"]


def listed(status: str | None = None, tag: str | None = None, phase: str | None = None) -> list[Gate]:
    found = [g for g in GATES.values() if (not tag or tag in g.tags) and (not phase or g.phase == phase)]
    return [g for g in found if not status or g.enforced == (status == "enforced")]


def find(gate_id: str) -> Gate:
    """By id or alias, whatever its case and separators; an unknown one is an error that names similar ones."""
    plain = {n.replace("-", "").lower(): g for g, x in GATES.items() for n in (g, *x.aliases)}
    key = gate_id.replace("-", "").replace("_", "").lower()
    if key in plain:
        return GATES[plain[key]]
    raise EngineError("GATE_NOT_FOUND", hints=[f"Did you mean {plain[m]}?" for m in difflib.get_close_matches(key, plain, 3)], gate_id=gate_id)


def run(store: Store, gate_id: str, batch_id: str | None = None) -> Result:
    g, began = find(gate_id), time.time()
    if g.needs_batch and batch_id is None:
        status, failures = "skipped", ["needs a batch"]
    else:
        try:
            failures = g.check(store, batch_id)
            status = "failed" if failures else "passed"
        except Exception as e:  # a check that breaks off is a failure of its own
            status, failures = "failed", [f"{type(e).__name__}: {e}"]
    return Result(g.gate_id, g.enforced, status, int(1000 * (time.time() - began)), failures)


def run_bundle(store: Store, bundle: str, batch_id: str | None = None, fail_fast: bool = False) -> dict:
    """bundle: phaseN, release (enforced ones) or all. It passes if no enforced gate failed."""
    chosen = [g for g in GATES.values() if bundle == "all" or bundle == "release" and g.enforced or g.phase == bundle]
    if not chosen:
        raise EngineError("GATE_NOT_FOUND", gate_id=bundle)
    results = []
    for g in chosen:
        results.append(run(store, g.gate_id, batch_id))
        if fail_fast and g.enforced and results[-1].status == "failed":
            break
    count = lambda s: sum(r.status == s for r in results)
    return {"bundle": bundle, "passed": count("passed"), "failed": count("failed"), "skipped": count("skipped"), "ok": not any(r.enforced and r.status == "failed" for r in results), "results": [asdict(r) for r in results]}


def write_artifact(store: Store, result: Result, run_id: str) -> str:
    path = f"{store.root}/indexes/gate_artifacts/{result.gate_id}/{run_id}"
    store.spark.createDataFrame([(json.dumps(asdict(result), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def table(store: Store, results: list[Result]):
    return store.spark.createDataFrame([(r.gate_id, r.enforced, r.status, r.duration_ms, r.failures) for r in results], "gate_id string, enforced boolean, status string, duration_ms long, failures array<string>").orderBy(F.col("gate_id"))

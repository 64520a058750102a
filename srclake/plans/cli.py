"""The command line: python -m srclake.plans.cli COMMAND --store PATH ..."""

from __future__ import annotations

import argparse
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclake.operators import diff, query
from srclake.plans import gates, index, registry, render, runtime
from srclake.plans.errors import EngineError
from srclake.plans.pipelines import PIPELINES, details
from srclake.plans.store import Store

#: Arguments by command, besides --store and --json. '*' marks those that need not be given.
ARGUMENTS = {
    "init": ("allow_reinit*",),
    "snapshot": ("source", "id*", "include_hidden*"),
    "snapshot-show": ("snapshot",),
    "batch-init": ("snapshot", "pipeline*", "id*"),
    **dict.fromkeys(("batch-show", "run", "resume", "status", "summary", "tasks"), ("batch", "task*")),
    **dict.fromkeys(("run-shard", "reset"), ("batch", "task", "shard")),
    "shards": ("batch", "task", "status*"),
    "pipeline": ("pipeline",),
    "diagnostics": ("batch", "task", "severity*", "code*", "path*", "limit*"),
    "outputs": ("batch", "task", "kind*", "path*", "limit*"),
    "stats": ("batch", "task*", "by*"),
    "errors": ("batch", "limit*"),
    "files": ("batch*", "snapshot*", "limit*"),
    "top": ("batch", "by*", "limit*"),
    "inspect": ("batch", "path", "kind*"),
    "explain": ("command_name",),
    **dict.fromkeys(("diff", "regressions", "improvements"), ("batch", "other", "kind*")),
    "index-build": ("batch", "verify*"),
    "gate-list": ("status*", "tag*", "phase*"),
    "gate-run": ("gate", "batch*"),
    "gate-bundle": ("bundle", "batch*", "fail_fast*"),
    "gate-explain": ("gate",),
}
SWITCHES = ("allow_reinit", "include_hidden", "verify", "fail_fast")
NO_STORE = ("api", "pipelines", "pipeline", "gate-list", "gate-explain", "explain")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="srclake")
    sub = top.add_subparsers(dest="command", required=True)
    for c in registry.commands():
        p = sub.add_parser(c["name"], help=c["description"])
        p.add_argument("--json", action="store_true")
        if c["name"] not in NO_STORE:
            p.add_argument("--store", required=True)
        for a in ARGUMENTS.get(c["name"], ()):
            name = a.rstrip("*")
            more = {"action": "store_true"} if name in SWITCHES else {"type": int} if name == "limit" else {}
            p.add_argument(f"--{name.replace('_', '-')}", required=not a.endswith("*"), **more)
    return top


def parser_commands() -> list[str]:
    return list(next(a for a in parser()._actions if isinstance(a, argparse._SubParsersAction)).choices)


def rows_of(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def answer(spark: SparkSession, a: argparse.Namespace) -> tuple[object, int]:
    """What the command shows (a dict, a list of rows or a text) and its exit code."""
    c = a.command
    if c == "api":
        return registry.api(), 0
    if c == "pipelines":
        return [{"name": n, "description": p["description"], "tasks": len(p["tasks"])} for n, p in sorted(PIPELINES.items())], 0
    if c == "pipeline":
        return details(a.pipeline), 0
    if c == "explain":
        return {"command": a.command_name, "sources": list(registry.SOURCES.get(a.command_name, ()))}, 0
    if c == "gate-list":
        return [{"gate_id": g.gate_id, "title": g.title, "phase": g.phase, "enforced": g.enforced} for g in gates.listed(a.status, a.tag, a.phase)], 0
    if c == "gate-explain":
        g = gates.find(a.gate)
        return {"gate_id": g.gate_id, "title": g.title, "phase": g.phase, "enforced": g.enforced, "tags": list(g.tags)}, 0
    if c == "init":
        return Store.init(spark, a.store, a.allow_reinit).metadata(), 0
    if c == "diagnose":
        return diagnose(spark, a.store)
    store = Store(spark, a.store)
    if c in ("diff", "regressions", "improvements"):
        one, two = store.outputs(a.batch), store.outputs(a.other)
        if c == "diff":
            return rows_of(diff.diff(one, two, kind=a.kind).orderBy("key")), 0
        return rows_of((diff.regressions if c == "regressions" else diff.improvements)(one, two).orderBy("path", "line", "col", "code")), 0
    simple = {
        "store-stats": lambda: rows_of(store.usage()),
        "snapshot": lambda: {"snapshot_id": store.snapshot(a.source, a.id, a.include_hidden)},
        "snapshot-list": lambda: rows_of(store.snapshots()),
        "snapshot-show": lambda: rows_of(store.load_snapshot(a.snapshot))[0],
        "batch-init": lambda: {"batch_id": store.init_batch(a.snapshot, a.pipeline or "full", a.id)},
        "batch-list": lambda: rows_of(store.batches()),
        "batch-show": lambda: store.load_batch(a.batch).asDict() | {"status": runtime.batch_status(store, a.batch), "tasks": rows_of(store.tasks(a.batch))},
        "tasks": lambda: rows_of(store.tasks(a.batch).join(runtime.status(store, a.batch).select("task_id", "status"), "task_id").orderBy("position")),
        "run-shard": lambda: {"status": runtime.run_shards(store, a.batch, a.task, [a.shard])},
        "reset": lambda: {"reset": runtime.reset(store, a.batch, a.task, a.shard) is None},
        "status": lambda: rows_of(runtime.status(store, a.batch).orderBy("task_id")),
        "summary": lambda: rows_of(runtime.summary(store, a.batch).orderBy("task_id")),
        "shards": lambda: rows_of(runtime.shards(store, a.batch, a.task, a.status)),
        "diagnostics": lambda: rows_of(_limited(query.diagnostics(store.outputs(a.batch, a.task), a.severity, a.code, a.path).orderBy("path", "line", "col", "code"), a.limit)),
        "outputs": lambda: rows_of(_limited(query.outputs(store.outputs(a.batch, a.task), a.kind, a.path).orderBy("path", "kind", "seq"), a.limit)),
        "stats": lambda: rows_of(index.stats(store, a.batch, a.by or "kind", a.task).orderBy(F.desc("n"), "value")),
        "errors": lambda: rows_of(query.errors(store.outputs(a.batch), [r["task_id"] for r in store.tasks(a.batch).collect()], a.limit or query.LIMITS["errors"])),
        "files": lambda: rows_of(query.files(store.files(a.snapshot or store.load_batch(a.batch)["snapshot_id"]), a.limit or query.LIMITS["files"])),
        "top": lambda: rows_of(index.stats(store, a.batch, a.by or "kind").orderBy(F.desc("n"), "value").limit(a.limit or query.LIMITS["top"])),
        "inspect": lambda: rows_of(query.inspect(store.outputs(a.batch), a.path, a.kind.split(",") if a.kind else None)),
        "index-build": lambda: index.build(store, a.batch, a.verify),
    }
    if c in ("run", "resume"):
        done = runtime.run(store, a.batch, [a.task] if a.task else None)
        return done, int("failed" in done.values())
    if c == "gate-run":
        r = gates.run(store, a.gate, a.batch)
        gates.write_artifact(store, r, uuid.uuid4().hex[:8])
        return vars(r), int(r.enforced and r.status == "failed")
    if c == "gate-bundle":
        r = gates.run_bundle(store, a.bundle, a.batch, a.fail_fast)
        return r, int(not r["ok"])
    return simple[c](), 0


def _limited(df: DataFrame, n: int | None) -> DataFrame:
    return df.limit(n) if n else df


def diagnose(spark: SparkSession, root: str) -> tuple[dict, int]:
    """Checks of a store, each ok, warning or error."""
    try:
        store = Store(spark, root)
    except EngineError as e:
        return {"status": "error", "checks": [{"name": "store", "status": "error", "message": e.message}]}, 1
    n = {t: store.read(t).count() for t in ("snapshots", "batches", "objects")}
    lost = store.read("files").select("object").distinct().join(store.read("objects").select("object"), "object", "left_anti").count()
    failed = sum(store.states(r["batch_id"]).where("status = 'failed'").count() for r in store.batches().collect())
    stale = [r["batch_id"] for r in store.batches().collect() if store._exists(f"{store.root}/indexes/{r['batch_id']}/meta") and not index.is_valid(store, r["batch_id"])]
    check = lambda name, ok, bad, message: {"name": name, "status": "ok" if ok else bad, "message": message}
    checks = [
        check("store", True, "", "store.json can be read"),
        check("snapshots", n["snapshots"] > 0, "warning", f"{n['snapshots']} snapshots"),
        check("batches", n["batches"] > 0, "warning", f"{n['batches']} batches"),
        check("objects", lost == 0, "error", f"{lost} objects are missing"),
        check("shards", failed == 0, "warning", f"{failed} shards failed"),
        check("index", not stale, "warning", f"{len(stale)} indexes do not fit their batch"),
    ]
    worst = "error" if any(x["status"] == "error" for x in checks) else "warning" if any(x["status"] == "warning" for x in checks) else "ok"
    return {"status": worst, "checks": checks}, int(worst == "error")


def show(value: object, as_json: bool) -> str:
    if as_json or isinstance(value, dict):
        return render.as_json(value)
    return render.table(value, list(value[0])) if value else ""


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    try:
        value, code = answer(spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), a)
    except EngineError as e:
        print(e.to_json() if a.json else "\n".join([f"Error: {e.message}", *(f"  Hint: {h}" for h in e.hints)]), file=sys.stderr)
        return 2
    print(show(value, a.json))
    return code


if __name__ == "__main__":
    sys.exit(main())

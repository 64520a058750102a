"""What the engine can do, as data: commands, tasks and kinds of records."""

from __future__ import annotations

from srclake.plans.pipelines import KINDS, PIPELINES
from srclake.schemas import SCHEMA_VERSION

#: Commands by group; those marked '!' change a store.
_COMMANDS = {
    "store": {"init!": "Create a store", "store-stats": "Bytes and files by table"},
    "snapshot": {"snapshot!": "Freeze a directory", "snapshot-list": "List snapshots", "snapshot-show": "Show a snapshot"},
    "batch": {"batch-init!": "Create a batch of a snapshot", "batch-list": "List batches", "batch-show": "Show a batch"},
    "run": {"run!": "Run a batch", "resume!": "Run what is not done", "run-shard!": "Run one shard of a task", "reset!": "Make a failed shard ready", "status": "Progress by task", "summary": "Counts of a batch", "shards": "States of a task's shards", "tasks": "Tasks of a batch", "pipelines": "List pipelines", "pipeline": "Show a pipeline"},
    "query": {"diagnostics": "Diagnostics of a task", "outputs": "Records of a task", "stats": "Counts by a field", "errors": "Errors of all tasks", "files": "Files of a snapshot or batch", "top": "Most frequent values", "inspect": "All records of a file", "explain": "How a query is answered"},
    "compare": {"diff": "Compare two batches", "regressions": "What got worse", "improvements": "What got better"},
    "index": {"index-build!": "Materialise counts"},
    "gate": {"gate-list": "List gates", "gate-run!": "Run a gate", "gate-bundle!": "Run a bundle of gates", "gate-explain": "Show a gate"},
    "meta": {"api": "Show capabilities", "diagnose": "Check a store"},
}
#: The version that all commands are there from.
SINCE = "1.0"
#: What identifies a record, by kind.
CANONICAL_KEYS = {"ast": ("kind", "path", "object"), "diagnostic": ("kind", "path", "line", "col", "code"), "metric": ("kind", "path", "metric"), "symbol": ("kind", "path", "name", "line"), "edge": ("kind", "path")}


def commands(group: str | None = None) -> list[dict]:
    """All commands with what they need and offer, as the command line has it."""
    from srclake.plans.cli import ARGUMENTS, NO_STORE

    def row(name: str, description: str, group: str) -> dict:
        plain = name.rstrip("!")
        needs = {"requires_store": plain not in NO_STORE, "requires_batch": "batch" in ARGUMENTS.get(plain, ())}
        return {"name": plain, "description": description, "group": group, "read_only": plain == name, "supports_json": True, "supports_explain": plain in SOURCES, "since": SINCE} | needs

    rows = [row(n, d, g) for g, some in _COMMANDS.items() for n, d in some.items()]
    return sorted((r for r in rows if not group or r["group"] == group), key=lambda r: r["name"])


def command(name: str) -> dict | None:
    return next((c for c in commands() if c["name"] == name), None)


def tasks() -> list[dict]:
    return [{"task_id": t["task_id"], "type": t["type"], "kinds": list(KINDS[t["type"]]), "depends_on": t["depends_on"]} for t in PIPELINES["full"]["tasks"]]


def kinds() -> list[dict]:
    return [{"kind": k, "canonical_key": list(v)} for k, v in sorted(CANONICAL_KEYS.items())]


def api() -> dict:
    """The capabilities as one document."""
    from srclake.plans.gates import GATES

    return {
        "producer": {"name": "srclake", "version": "1.0"},
        "schema_version": SCHEMA_VERSION,
        "commands": commands(),
        "tasks": tasks(),
        "output_kinds": kinds(),
        "pipelines": [{"name": n, "description": p["description"], "tasks": [t["task_id"] for t in p["tasks"]]} for n, p in sorted(PIPELINES.items())],
        "gates": sorted(GATES),
    }


#: What answers a query, for explain.
SOURCES = {
    "diagnostics": ("outputs of one task, kind = diagnostic",),
    "outputs": ("outputs of one task",),
    "stats": ("index statistics if they fit the records", "else outputs, joined with files for lang"),
    "top": ("index statistics if they fit the records", "else outputs of all tasks"),
    "errors": ("outputs of all tasks, severity = error",),
    "inspect": ("outputs of all tasks, one path",),
    "diff": ("outputs of both batches, full outer join on the record key",),
}

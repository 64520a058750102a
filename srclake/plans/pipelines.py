"""Pipelines: named lists of tasks with their dependencies."""

from __future__ import annotations

from srclake.plans.errors import EngineError

_PARSE = {"task_id": "01_parse", "type": "parse", "depends_on": [], "config": {"languages": ["python", "javascript", "typescript"], "emit_ast": True, "emit_diagnostics": True}}


def _after_parse(task_id: str, kind: str) -> dict:
    return {"task_id": task_id, "type": kind, "depends_on": ["01_parse"], "config": {}}


PIPELINES = {
    "parse": {"description": "Parse source files", "tasks": [_PARSE]},
    "analyze": {"description": "Parse source files and measure them", "tasks": [_PARSE, _after_parse("02_analyze", "analyze")]},
    "full": {"description": "Parse, measure, extract symbols and lint", "tasks": [_PARSE, _after_parse("02_analyze", "analyze"), _after_parse("03_symbols", "symbols"), _after_parse("04_lint", "lint")]},
}
#: What tasks write, by type.
KINDS = {"parse": ("ast", "diagnostic"), "analyze": ("metric",), "symbols": ("symbol", "edge", "diagnostic"), "lint": ("diagnostic",)}


def register(name: str, description: str, tasks: list[dict]) -> None:
    """Adds a pipeline; its tasks must be of known types and in an order that can be found."""
    for t in tasks:
        if t["type"] not in KINDS:
            raise EngineError("INVALID_ARGUMENT", argument=t["type"])
    topological(tasks)
    PIPELINES[name] = {"description": description, "tasks": tasks}


def topological(tasks: list[dict]) -> list[dict]:
    """tasks with each after those it depends on, else as given. Cycles and unknown dependencies are errors."""
    out, left, done = [], list(tasks), set()
    while left:
        ready = next((t for t in left if set(t["depends_on"]) <= done), None)
        if ready is None:
            raise EngineError("INVALID_ARGUMENT", argument="dependencies of " + ", ".join(t["task_id"] for t in left))
        left.remove(ready)
        done.add(ready["task_id"])
        out.append(ready)
    return out


def details(name: str) -> dict:
    if name not in PIPELINES:
        raise EngineError("PIPELINE_NOT_FOUND", pipeline=name)
    return {"name": name, **PIPELINES[name]}

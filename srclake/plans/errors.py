"""Errors with a code, hints and details, as exceptions and as a JSON envelope."""

from __future__ import annotations

import json

#: Error codes, with the message and hints of those that have a standard one.
CODES = {
    "STORE_NOT_FOUND": ("Store does not exist: {path}", ["Create it with init", "Check that the path is correct"]),
    "STORE_INVALID": ("Invalid store: {path}", ["Check that the path was made by init"]),
    "STORE_EXISTS": ("Store already exists: {path}", ["Use a different path", "Remove the existing store first"]),
    "BATCH_NOT_FOUND": ("Batch not found: {batch_id}", ["List batches with batch-list"]),
    "BATCH_INVALID": ("Invalid batch: {batch_id}", []),
    "SNAPSHOT_NOT_FOUND": ("Snapshot not found: {snapshot_id}", ["List snapshots with snapshot-list"]),
    "SNAPSHOT_INVALID": ("Invalid snapshot: {snapshot_id}", []),
    "PIPELINE_NOT_FOUND": ("Pipeline not found: {pipeline}", ["List pipelines with pipelines"]),
    "TASK_NOT_FOUND": ("Task not found: {task_id}", ["List tasks with tasks"]),
    "SHARD_NOT_FOUND": ("Shard not found: {shard_id}", []),
    "GATE_NOT_FOUND": ("Gate not found: {gate_id}", ["List gates with gate-list"]),
    "INVALID_ARGUMENT": ("Invalid argument: {argument}", []),
    "SCHEMA_ERROR": ("Unexpected schema: {reason}", []),
    "FILE_NOT_FOUND": ("File not found: {path}", []),
    "COMMAND_ERROR": ("Command failed: {reason}", []),
    "INTERNAL_ERROR": ("Internal error: {reason}", []),
}


class EngineError(Exception):
    def __init__(self, code: str, hints: list[str] | None = None, **details: str):
        message, standard = CODES[code]
        self.code, self.details = code, details
        self.hints = standard if hints is None else hints
        self.message = message.format(**details)
        super().__init__(self.message)

    def envelope(self) -> dict:
        return {"error": {"code": self.code, "message": self.message, "hints": self.hints, "details": self.details}}

    def to_json(self) -> str:
        return json.dumps(self.envelope(), sort_keys=True, ensure_ascii=False)

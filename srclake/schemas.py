"""Tables of the engine. NULL in outputs means that a record does not have the field."""

FILES = "snapshot_id string, schema_version int, path string, path_key string, object string, size long, lang_hint string, shard_id string"
OBJECTS = "object string, content binary, size long, prefix string"
SNAPSHOTS = "snapshot_id string, schema_version int, created_at timestamp, source struct<type:string,path:string>, file_count long, total_bytes long, include_hidden boolean, metadata map<string,string>, warnings array<struct<type:string,path:string,message:string>>"
BATCHES = "batch_id string, snapshot_id string, schema_version int, created_at timestamp, pipeline string, metadata map<string,string>"
TASKS = "batch_id string, task_id string, position int, type string, depends_on array<string>, config map<string,string>"
SHARDS = "batch_id string, task_id string, shard_id string, status string, attempt int, started_at timestamp, completed_at timestamp, error struct<code:string,message:string>, files_processed long, outputs_written long"
EVENTS = "ts timestamp, event string, batch_id string, task_id string, shard_id string, attempt int, duration_ms long, error struct<code:string,message:string>"

#: Fields of an output record that a task sets, in order.
RECORD = {
    "path": "string",
    "kind": "string",
    "object": "string",
    "format": "string",
    "severity": "string",
    "code": "string",
    "message": "string",
    "line": "bigint",
    "col": "bigint",
    "name": "string",
    "symbol_type": "string",
    "scope": "string",
    "edge_type": "string",
    "target": "string",
    "metric": "string",
    "value_num": "bigint",
    "value_str": "string",
}
#: What identifies the run that a record comes from. seq keeps the order of a task's records within a file.
RUN = {"schema_version": "int", "snapshot_id": "string", "batch_id": "string", "task_id": "string", "shard_id": "string", "seq": "bigint", "ts": "timestamp"}
OUTPUTS = ", ".join(f"{k} {t}" for k, t in (RUN | RECORD | {"extra": "string"}).items())
SCHEMA_VERSION = 1
SHARDS_IN_ALL = 256

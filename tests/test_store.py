"""A store from a directory to answers: snapshot, run, resume, retry, index, gates, command line."""

import ast
import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from srclake.operators import diff, query
from srclake.plans import gates, index, runtime
from srclake.plans.cli import main
from srclake.plans.errors import EngineError
from srclake.plans.pipelines import register, topological
from srclake.plans.store import Store

FILES = {
    "hello.py": b'import os\nimport sys\n\ndef greet(name):\n    unused = 1\n    return "hi"\n\nprint(sys.argv)\n',
    "bad.py": b"def f(:\n",
    "pkg/__init__.py": b"",
    "pkg/_private.py": b"x = 1  \n",
    "crlf.txt": b"one\r\ntwo  \r\nthree",
    "unicode_路径.txt": "café 路径\n".encode(),
    "emoji_\U0001f389.md": "# TODO \U0001f389\n".encode(),
    "binary.bin": b"\x00\xff\xfe\x80",
    "empty.txt": b"",
    "app.js": b"const a = {};\nfunction f() { return 'x'; \n",
    ".hidden/secret.txt": b"no\n",
    "copy/hello.py": b'import os\nimport sys\n\ndef greet(name):\n    unused = 1\n    return "hi"\n\nprint(sys.argv)\n',
}


def make_tree(root, files=FILES):
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("world")
    make_tree(root / "src")
    store = Store.init(spark, str(root / "store"))
    store.snapshot(str(root / "src"), "snap-1")
    store.init_batch("snap-1", "full", "batch-1")
    assert set(runtime.run(store, "batch-1").values()) == {"done"}
    return store, root


def canonical(df):
    return sorted((tuple(r) for r in df.drop("ts", "seq").collect()), key=repr)


def test_snapshot(world):
    store, _ = world
    rows = {r["path"]: r for r in store.files("snap-1").collect()}
    assert set(rows) == set(FILES) - {".hidden/secret.txt"}
    assert rows["empty.txt"]["object"].startswith("sha256:e3b0c442") and rows["empty.txt"]["size"] == 0
    assert rows["hello.py"]["object"] == rows["copy/hello.py"]["object"] and store.read("objects").where(F.col("object").isin([r["object"] for r in rows.values()])).count() == len({r["object"] for r in rows.values()})
    assert rows["app.js"]["lang_hint"] == "javascript" and rows["binary.bin"]["lang_hint"] is None
    meta = store.load_snapshot("snap-1").first()
    assert (meta["file_count"], meta["total_bytes"], meta["warnings"]) == (len(rows), sum(len(v) for k, v in FILES.items() if not k.startswith(".")), [])
    assert store.object_bytes(rows["crlf.txt"]["object"]) == FILES["crlf.txt"]
    with pytest.raises(EngineError) as e:
        store.load_snapshot("none")
    assert e.value.code == "SNAPSHOT_NOT_FOUND"


def test_hidden_files_and_warnings(world):
    store, root = world
    sid = store.snapshot(str(root / "src"), "snap-hidden", include_hidden=True)
    assert store.files(sid).where("path = '.hidden/secret.txt'").count() == 1
    frame = store.spark.createDataFrame([("A.txt", b"1"), ("a.txt", b"2"), ("con.txt", b"3"), ("../x", b"4"), ("gone", None)], "path string, content binary")
    sid = store.snapshot_frame(frame, "snap-odd")
    assert sorted((w["type"], w["path"]) for w in store.load_snapshot(sid).first()["warnings"]) == [("case_collision", "a.txt"), ("invalid_path", "../x"), ("invalid_path", "con.txt"), ("unreadable", "gone")]


def test_records(world):
    store, _ = world
    out = store.outputs("batch-1")
    found = {(r["path"], r["code"], r["line"]) for r in query.diagnostics(out).collect()}
    assert found == {
        ("hello.py", "L101", 1), ("hello.py", "L102", 5), ("copy/hello.py", "L101", 1), ("copy/hello.py", "L102", 5), ("bad.py", "E0001", 1),
        ("pkg/_private.py", "L001", 1), ("pkg/_private.py", "L102", 1), ("crlf.txt", "L001", 2), ("crlf.txt", "L005", 3), ("emoji_\U0001f389.md", "L003", 1), ("app.js", "W0001", 1), ("app.js", "L001", 2),
    }
    metrics = {(r["path"], r["metric"]): r["value_num"] if r["value_str"] is None else r["value_str"] for r in query.outputs(out, "metric").collect()}
    assert metrics["binary.bin", "bytes"] == 4 and ("binary.bin", "loc") not in metrics and metrics["binary.bin", "lang"] == "unknown"
    assert metrics["hello.py", "complexity"] == 1 and metrics["hello.py", "import_count"] == 2 and ("bad.py", "complexity") not in metrics
    assert {r["path"] for r in query.files_with_kind(out, "ast").collect()} == {r["path"] for r in store.files("snap-1").collect()} - {"binary.bin", "bad.py"}
    assert [r["path"] for r in query.failed_files(out).collect()] == ["bad.py"]
    assert {r["kind"] for r in query.inspect(out, "./hello.py").collect()} == {"ast", "metric", "symbol", "edge", "diagnostic"}


def test_status(world):
    store, _ = world
    assert runtime.batch_status(store, "batch-1") == "done"
    assert runtime.run(store, "batch-1") == dict.fromkeys(("01_parse", "02_analyze", "03_symbols", "04_lint"), "skipped")
    total = runtime.summary(store, "batch-1").where("task_id is null").first()
    assert total["outputs"] == store.outputs("batch-1").count() and total["errors"] == 1
    assert {r["event"] for r in store.events("batch-1").collect()} == {"batch_created", "shard_started", "shard_completed"}


def test_failure_reset_and_retry_give_the_same(world, monkeypatch):
    store, _ = world
    store.init_batch("snap-1", "analyze", "batch-2")
    runtime.run(store, "batch-2", ["01_parse"])
    shard = store.files("snap-1").where("path = 'hello.py'").first()["shard_id"]
    with monkeypatch.context() as m:
        m.setitem(runtime.EXECUTORS, "analyze", lambda files, facts, config: files.select("nothing"))
        assert runtime.run(store, "batch-2")["02_analyze"] == "failed"
    assert runtime.batch_status(store, "batch-2") == "failed"
    state = runtime.shards(store, "batch-2", "02_analyze", "failed").where(F.col("shard_id") == shard).first()
    assert state["attempt"] == 1 and state["error"]["message"]
    runtime.reset(store, "batch-2", "02_analyze", shard)
    assert runtime.run_shards(store, "batch-2", "02_analyze", [shard]) == "done"
    assert runtime.resume(store, "batch-2")["02_analyze"] == "done"
    now = runtime.shards(store, "batch-2", "02_analyze").where(F.col("shard_id") == shard).first()
    assert (now["status"], now["attempt"], now["error"]) == ("done", 2, None)
    assert diff.equivalent(store.outputs("batch-2", "02_analyze"), store.outputs("batch-1", "02_analyze"))
    before = canonical(store.outputs("batch-2"))
    runtime.run_shards(store, "batch-2", "02_analyze", [shard])
    assert canonical(store.outputs("batch-2")) == before  # replaced, not appended


def test_stored_trees(world):
    store, _ = world
    records = {r["path"]: r for r in store.outputs("batch-1", "01_parse", kind="ast").collect()}
    tree = json.loads(store.object_bytes(records["hello.py"]["object"]))
    assert (tree["type"], tree["ast_mode"], records["hello.py"]["format"]) == ("Module", "full", "json")
    assert tree["stats"]["total_nodes"] == sum(1 for _ in ast.walk(ast.parse(FILES["hello.py"])))
    greet = tree["body"][2]
    assert (greet["name"], greet["args"], greet["end_lineno"]) == ("greet", {"args": [{"arg": "name", "annotation": None}]}, 6)
    assert greet["body"][0]["targets"][0]["id"] == "unused" and tree["body"][3]["value"]["func"]["id"] == "print"
    assert json.loads(store.object_bytes(records["emoji_\U0001f389.md"]["object"]))["type"] == "TextInfo"
    assert store.facts("batch-1", [store.get_file("snap-1", "bad.py").first()["shard_id"]]).where("fact = 'error'").count() == 1


def test_trees_in_chunks(world):
    store, _ = world
    register("chunked", "", [{"task_id": "01_parse", "type": "parse", "depends_on": [], "config": {"chunk_threshold": 200}}])
    store.init_batch("snap-1", "chunked", "batch-chunks")
    assert runtime.run(store, "batch-chunks") == {"01_parse": "done"}
    whole = {r["path"]: r["object"] for r in store.outputs("batch-1", "01_parse", kind="ast").collect()}
    record = store.outputs("batch-chunks", kind="ast").where("path = 'hello.py'").first()
    manifest = json.loads(store.object_bytes(record["object"]))
    assert record["format"] == "json+chunks" and [c["index"] for c in manifest["chunks"]] == list(range(len(manifest["chunks"])))
    assert b"".join(store.object_bytes(c["object"]) for c in manifest["chunks"]) == store.object_bytes(whole["hello.py"])


def test_one_bad_file_or_shard_leaves_the_others(spark, tmp_path, monkeypatch):
    make_tree(tmp_path / "src")
    store = Store.init(spark, str(tmp_path / "store"))
    store.snapshot(str(tmp_path / "src"), "s")
    store.init_batch("s", "full", "b")
    lost, poison = store.get_file("s", "crlf.txt").first(), store.get_file("s", "app.js").first()["shard_id"]
    path = f"{store.root}/objects/prefix={lost['shard_id']}"
    assert store.read("objects").where(F.col("prefix") == lost["shard_id"]).count() == 1
    shutil.rmtree(path.removeprefix("file:"))

    def poisoned(files, facts, config):
        return runtime.analyze_task(files.withColumn("size", F.when(F.col("shard_id") == poison, F.raise_error(F.lit("poison")).cast("long")).otherwise(F.col("size"))), facts, config)

    monkeypatch.setitem(runtime.EXECUTORS, "analyze", poisoned)
    seen = []
    ended = runtime.run(store, "b", on_shard=lambda task, shard, how: seen.append((task, shard, how)))
    assert ended == {"01_parse": "done", "02_analyze": "failed", "03_symbols": "done", "04_lint": "done"}
    states = {(r["task_id"], r["shard_id"]): r["status"] for r in store.states("b").where("task_id = '02_analyze' and status <> 'ready'").collect()}
    assert {s for s in states.values()} == {"done", "failed"} and [k for k, v in states.items() if v == "failed"] == [("02_analyze", poison)]
    assert [x for x in seen if x[2] == "failed"] == [("02_analyze", poison, "failed")] and len(seen) == 4 * len(states)
    found = {(r["code"], r["path"]) for r in query.diagnostics(store.outputs("b"), severity="error").collect()}
    assert found == {("E9999", "crlf.txt"), ("L999", "crlf.txt"), ("E0001", "bad.py")}
    assert store.outputs("b", "02_analyze").where("path = 'hello.py' and metric = 'complexity'").count() == 1


def test_dependencies_are_enforced(world):
    store, _ = world
    store.init_batch("snap-1", "full", "batch-3")
    shard = store.files("snap-1").first()["shard_id"]
    with pytest.raises(EngineError):
        runtime.run_shards(store, "batch-3", "02_analyze", [shard])
    assert [t["task_id"] for t in topological([{"task_id": "b", "depends_on": ["a"]}, {"task_id": "a", "depends_on": []}])] == ["a", "b"]
    with pytest.raises(EngineError):
        register("loop", "", [{"task_id": "a", "type": "lint", "depends_on": ["a"], "config": {}}])


def test_index_agrees_with_scan(world):
    store, _ = world
    assert not index.is_valid(store, "batch-1")
    built = index.build(store, "batch-1", verify=True)
    assert built["differs"] == [] and index.is_valid(store, "batch-1") and index.build(store, "batch-1") == built
    for group in index.GROUPS:
        pairs = lambda cached, g=group: sorted(map(tuple, index.stats(store, "batch-1", g, use_index=cached).collect()))
        assert pairs(True) == pairs(False)
    assert index.stat(store, "batch-1", "severity", "error") == 1 and index.stat(store, "batch-1", "severity", "nope") == 0
    by_kind = lambda: sorted(map(tuple, index.outputs_by_kind(store, "batch-1", "01_parse", "ast").collect()))
    by_severity = lambda: sorted(map(tuple, index.diagnostics_by_severity(store, "batch-1", "04_lint", "info").collect()))
    indexed = by_kind(), by_severity()
    index.delete(store, "batch-1")
    assert indexed == (by_kind(), by_severity()) and all(indexed)
    assert not index.is_valid(store, "batch-1") and index.stat(store, "batch-1", "severity", "error") == 1


def test_comparison_of_stored_batches(world):
    store, root = world
    changed = FILES | {"hello.py": FILES["hello.py"].replace(b"import os\n", b"") + b"# FIXME\n", "new.py": b"y = 2\n"}
    del changed["bad.py"]
    make_tree(root / "src2", changed)
    store.snapshot(str(root / "src2"), "snap-2")
    store.init_batch("snap-2", "full", "batch-4")
    runtime.run(store, "batch-4")
    a, b = store.outputs("batch-1"), store.outputs("batch-4")
    assert {(r["path"], r["code"]) for r in diff.regressions(a, b).collect()} == {("hello.py", "L003"), ("new.py", "L102"), ("hello.py", "L102")}
    assert {(r["path"], r["code"]) for r in diff.improvements(a, b).collect()} == {("hello.py", "L101"), ("bad.py", "E0001"), ("hello.py", "L102")}
    assert diff.diff(a, a).isEmpty()


def test_gates(world):
    store, _ = world
    for g in gates.GATES:
        result = gates.run(store, g, "batch-1")
        assert result.status == "passed", result
    bundle = gates.run_bundle(store, "phase3", "batch-1")
    assert bundle["ok"] and bundle["passed"] == 4
    assert gates.run(store, "p2_g1").status == "skipped" and gates.find("cache-fallback").gate_id == "P3-A2"
    with pytest.raises(EngineError) as e:
        gates.find("P2-G11")
    assert any("P2-G1" in h for h in e.value.hints)


def test_command_line(world, spark, capsys, tmp_path):
    store, root = world

    def run(*args):
        code = main([*args, "--json"], spark)
        out = capsys.readouterr()
        return code, json.loads(out.out or out.err)

    assert run("stats", "--store", store.root, "--batch", "batch-1", "--by", "severity")[1][0]["value"] == "none"
    assert run("top", "--store", store.root, "--batch", "batch-1", "--by", "code", "--limit", "2")[0] == 0
    assert run("inspect", "--store", store.root, "--batch", "batch-1", "--path", "bad.py", "--kind", "diagnostic")[1][0]["code"] == "E0001"
    assert len(run("errors", "--store", store.root, "--batch", "batch-1")[1]) == 1
    assert run("status", "--store", store.root, "--batch", "none") == (2, {"error": {"code": "BATCH_NOT_FOUND", "details": {"batch_id": "none"}, "hints": ["List batches with batch-list"], "message": "Batch not found: none"}})
    assert run("init", "--store", str(tmp_path / "new"))[0] == 0
    assert run("init", "--store", str(tmp_path / "new"))[0] == 2
    code, sid = run("snapshot", "--store", str(tmp_path / "new"), "--source", str(root / "src"))
    assert code == 0 and sid["snapshot_id"].startswith("snap-")
    assert run("diagnose", "--store", str(tmp_path / "new"))[1]["status"] == "warning"
    assert run("diagnose", "--store", str(tmp_path / "nowhere"))[0] == 1
    assert run("gate-run", "--store", store.root, "--gate", "P5-G4") [0] == 0
    assert len(run("api")[1]["commands"]) == len(run("api")[1]["commands"]) > 30
    assert main(["files", "--store", store.root, "--batch", "batch-1"], spark) == 0 and "PATH" in capsys.readouterr().out
    assert os.path.isdir(f"{store.root}/indexes/gate_artifacts/P5-G4")

"""Scalar functions, rules, Python facts and rendering on literal cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from srclake.functions import scalar
from srclake.operators import diff, parse
from srclake.operators.lint_text import TextLint, text_diagnostics
from srclake.operators.python_facts import source_facts
from srclake.plans import catalog, gates, registry, render
from srclake.plans.errors import CODES, EngineError
from srclake.plans.pipelines import details
from srclake.streaming import events


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)])
    return row.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(("path", "want", "error"), catalog.PATHS)
def test_canonical_path(spark, path, want, error):
    got = one(spark, scalar.canonical_path(F.col("p")), p=path)
    assert (got["path"], got["error"]) == (want, error)
    assert one(spark, scalar.is_safe_path(F.col("p")), p=path) == (error is None)


@pytest.mark.parametrize(("path", "want"), [("a.PY", "python"), ("x/.py", None), ("b.tar.SH", "shell"), ("README", None), ("a.b/c", None), ("s.R", "r"), ("..x.md", "markdown")])
def test_language(spark, path, want):
    assert one(spark, scalar.language(F.col("p")), p=path) == want


def test_references(spark):
    ref = one(spark, scalar.content_ref(F.col("c")), c="")
    assert ref == "sha256:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert one(spark, scalar.shard_prefix(F.col("r")), r=ref) == "e3" == one(spark, scalar.shard_prefix(F.col("r")), r=ref[7:])
    assert one(spark, scalar.ref_hex(F.col("r")), r="md5:00") is None
    with pytest.raises(Exception, match="not an object reference"):
        one(spark, scalar.checked_ref_hex(F.col("r")), r="md5:00")


@pytest.mark.parametrize("n", [0, 1023, 1024, 1280, 1536, 1048576, 5 * 1024**3, 3 * 1024**4])
def test_human_size(spark, n):
    unit, x = "B", float(n)
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if x < 1024 or unit == "TB":
            break
        x /= 1024
    assert one(spark, scalar.human_size(F.col("n")), n=n) == (f"{n} B" if unit == "B" else f"{x:.1f} {unit}")


def test_small_functions(spark):
    assert one(spark, scalar.display_path(F.col("p")), p="./../.github/x") == "github/x"
    assert [one(spark, scalar.severity_rank(F.col("s")), s=s) for s in ("ERROR", "warning", "info", "hint", "?")] == [0, 1, 2, 3, 99]
    key = one(spark, scalar.cache_key(F.col("a"), F.lit(3)), a="x")
    assert key == "v1\x1fx\x1f3" and one(spark, scalar.cache_key_parts(F.col("k")), k=key) == ["x", "3"]
    assert one(spark, scalar.loc(F.col("t")), t="a\n \n\x1c\n\tb\n") == 2
    assert one(spark, scalar.text_stats(F.col("t")), t="a b\n\x1d c d").asDict() == {"lines": 2, "words": 4, "characters": 9, "non_empty_lines": 2}
    assert one(spark, scalar.token_counts(F.col("t")), t="const é1 = 'a'; // for\nlet $x = 1.5").asDict() == {"keyword": 3, "string": 1, "number": 1, "comment": 1, "identifier": 5}
    assert one(spark, scalar.is_text(F.col("b")), b=bytearray(b"\xff")) is False
    assert one(spark, scalar.without_ansi(F.col("t")), t="\x1b[1mA\x1b[0m") == "A"
    assert one(spark, parse.chunks(F.col("b"), 4), b=bytearray(b"")) == []
    assert [(c["index"], c["size"]) for c in one(spark, parse.chunks(F.col("b"), 4), b=bytearray(b"123456789"))] == [(0, 4), (1, 4), (2, 1)]


def test_script_tokens_of_any_text(spark):
    rng = random.Random(4)
    parts = ["const", "let", " ", "é", "ü1", "$x", "_", "9", "1.5", "٣", "'a'", '"b\\""', "// c\n", "/* d\n */", "\n", ".", "漢", "if(", "for"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", scalar.token_counts(F.col("t")).alias("c"))
    for r in df.collect():
        assert r["c"].asDict() == {k: sum(1 for _ in re.finditer(p, texts[r["i"]])) for k, p in scalar.TOKENS.items()}, texts[r["i"]]


def lint(spark, text, **config):
    df = spark.createDataFrame([("p", "00", text)], "path string, shard_id string, text string")
    return sorted((r["code"], r["line"], r["col"], r["message"]) for r in text_diagnostics(df, TextLint(**config)).collect())


def test_text_rules(spark):
    assert lint(spark, "ok\n") == [] == lint(spark, "") == lint(spark, None)
    assert lint(spark, "a \nb\t \r\n") == [("L001", 1, 2, "Trailing whitespace"), ("L001", 2, 2, "Trailing whitespace")]
    assert lint(spark, "y" * 11 + "\n", max_line_length=10) == [("L002", 1, 11, "Line too long (11 > 10)")]
    assert lint(spark, "hack todo\nfixme\nßtodo\n") == [("L003", 1, 6, "Found TODO comment"), ("L003", 2, 1, "Found FIXME comment"), ("L003", 3, 3, "Found TODO comment")]
    assert lint(spark, "\tx") == [("L004", 1, 1, "Tab indentation (prefer spaces)"), ("L005", 1, 3, "Missing newline at end of file")]
    off = dict.fromkeys(("check_trailing_whitespace", "check_line_length", "check_todo", "check_tab_indentation", "check_final_newline"), False)
    assert lint(spark, "\ttodo  ", **off) == []


def kinds(source, fact, *columns):
    return [tuple(r[c] for c in columns) for r in source_facts(source) if r[0] == fact]


def test_python_facts():
    src = b"import a.b, c as d\nfrom e import *\nx = y = 1\nx += z\nfor i in r: pass\nwith open(q) as h: g = h\nclass K: v: T = 2\nasync def f(p, *, k=1): return [i for i in p]\n"
    assert kinds(src, "import", 2) == [("a",), ("d",)]
    assert {n for (n,) in kinds(src, "use", 2)} == {"x", "r", "T"}
    assert {(n, k) for n, k in kinds(src, "definition", 2, 3)} == {("a", "import"), ("d", "import"), ("x", "variable"), ("y", "variable"), ("i", "variable"), ("g", "variable"), ("K", "class"), ("v", "variable"), ("f", "function"), ("p", "parameter")}
    assert kinds(src, "symbol", 2, 3, 6)[-2:] == [("f", "function", "module"), ("p", "parameter", "f")]
    assert kinds(b"", "module", 8) == [(1,)] and kinds(b"x = (", "error", 3) == [("E0001",)]
    deep = b"x" + b".a" * 70 + b"\n"
    assert kinds(deep, "use", 2) == []
    everything = {r[2] for r in source_facts(src, full=True) if r[0] == "use"}
    assert everything >= {"q", "h", "open", "p"}


def test_record_keys(spark):
    rows = [("diagnostic", "p", 1, 2, "C", None, "m1"), ("diagnostic", "p", 1, 2, "C", None, "m2"), ("metric", "p", None, None, None, "loc", None), ("metric", "p", None, None, None, "bytes", None)]
    df = spark.createDataFrame(rows, "kind string, path string, line long, col long, code string, metric string, message string").withColumns({"task_id": F.lit("t"), "shard_id": F.lit("0"), "object": F.lit(None).cast("string"), "name": F.lit(None).cast("string"), "seq": F.monotonically_increasing_id()})
    last = {(r["key"]["kind"], r["key"]["name"]): r["record"]["message"] for r in diff.last_of_key(df).collect()}
    assert last == {("diagnostic", "C"): "m2", ("metric", "loc"): None, ("metric", "bytes"): None}
    assert diff.last_of_key(df, ["kind"]).count() == 2
    assert "seq" not in diff.normalised(df, ["message"]).columns and "message" not in diff.normalised(df, ["message"]).columns


ROWS = [{"path": p, "kind": "diagnostic", "code": c, "severity": s} for p, c, s in (("tests/test.py", "I001", "info"), ("src/main.py", "E001", "error"), ("src/main.py", "E003", "error"))]


def test_tables():
    text = render.table(ROWS, ["path", render.Col("code", width=3, align="right"), "severity"], key="path")
    assert text.split("\n") == ["PATH           CODE  SEVERITY", "-------------  ---  --------", "src/main.py    ...  error   ", "src/main.py    ...  error   ", "tests/test.py  ...  info    "]
    assert render.table([], ["a"]) == "" and render.table(ROWS, ["code"], header=False, most=1) == "I001"
    assert render.table(ROWS, ["code"], page=1, size=2, header=False) == "E003"
    assert render.as_jsonl(ROWS[:1]) == '{"code": "I001", "kind": "diagnostic", "path": "tests/test.py", "severity": "info"}'
    assert render.as_json({"b": 1, "a": "é"}) == '{\n  "a": "é",\n  "b": 1\n}'
    assert render.plain(render.coloured("x", "bold", "always")) == "x" != render.coloured("x", "bold", "always")


def test_registry_and_errors():
    assert registry.command("diff")["read_only"] and not registry.command("run")["read_only"] and registry.command("nope") is None
    assert registry.command("diff") | {"requires_store": True, "requires_batch": True, "supports_json": True, "supports_explain": True, "since": "1.0"} == registry.command("diff") and not registry.command("api")["requires_store"]
    assert {k["kind"] for k in registry.kinds()} == {"ast", "diagnostic", "metric", "symbol", "edge"}
    assert [t["task_id"] for t in registry.tasks()] == ["01_parse", "02_analyze", "03_symbols", "04_lint"] and registry.api()["gates"] == sorted(gates.GATES)
    assert {g.gate_id for g in gates.listed(phase="phase3")} == {"P3-A1", "P3-A2", "P3-A3", "P3-A4"} and gates.listed(tag="schema")[0].gate_id == "P1-G1"
    with pytest.raises(EngineError) as e:
        details("none")
    assert e.value.envelope()["error"]["code"] == "PIPELINE_NOT_FOUND" and len(CODES) == 16


def test_streams(spark, tmp_path):
    rows = [(0, "a"), (600, "a"), (4000, "b"), (9000, "a")]
    frame = spark.createDataFrame(rows, "s long, user string").select(F.timestamp_seconds("s").alias("ts"), "user")
    frame.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = events.read_events(spark, str(tmp_path / "events"), "ts timestamp, user string")
    events.run_available(events.sessions(stream, "ts", "user", late="0 seconds"), str(tmp_path / "c1"))
    # What the watermark has not passed stays in the state: the last session is not written.
    assert sorted((r["user"], r["n"]) for r in spark.read.parquet(str(tmp_path / "c1" / "result")).collect()) == [("a", 2), ("b", 1)]
    assert events.finished(events.windowed(stream, "ts", "user", "1 hour", "30 minutes"), str(tmp_path / "c2")).agg(F.sum("n")).first()[0] == 8
    log = [(F.lit(1), "shard_started", "x"), (F.lit(2), "shard_completed", "x")]
    states = spark.createDataFrame([(k + 1, e, s, 1) for k, (_, e, s) in enumerate(log)], "s long, event string, shard_id string, attempt int").select(F.timestamp_seconds("s").alias("ts"), "event", F.lit("b").alias("batch_id"), F.lit("t").alias("task_id"), "shard_id", "attempt")
    assert [r["event"] for r in events.latest_states(states).collect()] == ["shard_completed"]

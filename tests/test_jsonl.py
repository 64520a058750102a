"""Records survive the way through JSON lines, unknown fields included."""

import json

from pyspark.sql import functions as F

from srclake.operators.records import enrich, select_records, union_records
from srclake.sources import jsonl


def test_round_trip(spark, tmp_path):
    files = spark.createDataFrame([("00", "a.py", 7), ("01", "b é.py", None)], "shard_id string, path string, n long")
    records = union_records(
        select_records(files.where("n is not null"), kind="metric", path=F.col("path"), metric="bytes", value_num=F.col("n")),
        select_records(files, kind="metric", path=F.col("path"), metric="lang", value_str="python"),
        select_records(files, kind="diagnostic", path=F.col("path"), severity="error", code="E0001", message='say "x"', line=1, col=2),
    )
    full = enrich(records, "s", "b", "t", F.timestamp_seconds(F.lit(1_700_000_000))).withColumn("extra", F.when(F.col("kind") == "diagnostic", '{"later":"field"}'))
    jsonl.write(full, str(tmp_path / "out"))
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert {x["value"] for x in lines if x["kind"] == "metric"} == {7, "python"} and all(x["later"] == "field" for x in lines if x["kind"] == "diagnostic")
    back = jsonl.read(spark, str(tmp_path / "out"))
    assert back.exceptAll(full).isEmpty() and full.exceptAll(back).isEmpty()


def test_foreign_lines(spark):
    lines = spark.createDataFrame([('{"kind":"diagnostic","path":"p","column":3,"new":{"a":1}}',), (" ",)], "value string")
    row = jsonl.from_lines(lines).first()
    assert (row["col"], row["path"], json.loads(row["extra"])) == (3, "p", {"new": '{"a":1}'}) and jsonl.from_lines(lines).count() == 1

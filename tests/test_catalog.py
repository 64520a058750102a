"""Queries of the catalogue that use the same records several times."""

import pytest

from srclake.operators import diff
from srclake.plans import catalog


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, None if i == 3 else "word " * (i % 40) + "\n" * (i % 2) + "x" * 130, "en", f"src{i % 3}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["cache_equivalence", "last_wins"])
def test_texts_are_read_once(spark, tables, name):
    df = catalog.QUERIES[name](spark, tables)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "text:string" not in plan and "text#" not in plan
    records = catalog.records(spark, tables)
    if name == "cache_equivalence":
        assert [tuple(r) for r in df.collect()] == [(0, records.count())]
    else:
        found = {}
        for r in records.where("code = 'L002'").collect():
            found.setdefault(r.path, []).append(r.line)
        assert {r.path: (r.line, r.n) for r in df.collect()} == {p: (max(x), len(x)) for p, x in found.items()} != {}


def test_differing(spark):
    frame = lambda rows: spark.createDataFrame(rows, "value string, n int")
    a, b = frame([("x", 1), ("x", 1), ("y", 2), (None, None)]), frame([("x", 1), ("z", 2), (None, None)])
    assert diff.differing(a, b).first()[0] == diff.differing(b, a).first()[0] == 3
    assert diff.differing(a, a).first()[0] == diff.differing(a.limit(0), a.limit(0)).first()[0] == 0

"""Interchange of output records as JSON lines, one object a record, without the fields that it does not have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclake.functions.scalar import timestamp_text
from srclake.schemas import RECORD, RUN

_NAMES = {"value_num": "value", "value_str": "value"}


def to_lines(records: DataFrame) -> DataFrame:
    """(value): records as JSON with sorted keys; value is the number or the text of a metric; seq stays, extra is merged in
    as it was."""
    plain = sorted(k for k in (*RECORD, *RUN) if k not in ("ts", *_NAMES))
    fields = [F.to_json(F.struct(F.col(k).alias(k))) for k in plain]
    value = F.coalesce(F.to_json(F.struct(F.col("value_num").alias("value"))), F.lit("{}"))
    text = F.to_json(F.struct(F.col("value_str").alias("value")))
    ts = F.to_json(F.struct(timestamp_text(F.col("ts")).alias("ts")))
    parts = F.array(*fields, ts, F.when(F.col("value_str").isNotNull(), text).otherwise(value), F.coalesce("extra", F.lit("{}")))
    inner = F.filter(F.transform(parts, lambda x: F.substring(x, F.lit(2), F.length(x) - 2)), lambda x: x != "")
    return records.select(F.concat(F.lit("{"), F.array_join(F.array_sort(inner), ","), F.lit("}")).alias("value"))


def write(records: DataFrame, path: str) -> None:
    to_lines(records).write.mode("errorifexists").text(path)


def from_lines(lines: DataFrame) -> DataFrame:
    """Records of (value): unknown fields go to extra as JSON, column is read as col, blank lines are skipped."""
    known = {*RECORD, *RUN, "value", "column"}
    schema = ", ".join(f"{k} {t}" for k, t in (RUN | RECORD).items() if k not in _NAMES) + ", `column` bigint, value string"
    rows = lines.where(F.btrim("value") != "").select("value", F.from_json("value", schema).alias("r"), F.from_json("value", "map<string,string>").alias("m"))
    number = F.get_json_object("value", "$.value")
    is_number = F.regexp_like("value", F.lit(r'"value"\s*:\s*-?[0-9]+\s*[,}]'))
    extra = F.map_filter("m", lambda k, _: ~k.isin(*known))
    special = {"col": F.coalesce("r.col", "r.column"), "value_num": F.when(is_number, number).cast("bigint"), "value_str": F.when(~is_number, number)}
    return rows.select(*[special.get(k, F.col(f"r.{k}")).alias(k) for k in (*RUN, *RECORD)], F.when(F.size(extra) > 0, F.to_json(extra)).alias("extra"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return from_lines(spark.read.text(path))

"""What the training-data operators share: reading, materialising, skew-safe helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where that is unset, a temporary folder is made
    and set if all executors are on this machine; on a cluster it is an error, since rows would be lost."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="srclake-")
        spark.sparkContext.setCheckpointDir(path)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return path


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back. It cuts the lineage, so that a lost executor costs
    a re-read and not a recomputation, and it keeps a costly scan from running once per consumer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/srclake-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(name: str = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty. Binary crosses to Python without decoding."""
    return F.coalesce(F.col(name).cast("string").cast("binary"), F.lit(b""))


#: Rows of a narrow table that are broadcast by hand at most.
FEW = 1 << 20


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """df, to be broadcast if it has `most` rows or fewer; beyond that it is joined as Spark plans it. For tables of a few
    numbers a row that are stored already, so that counting them is cheap."""
    return F.broadcast(df) if df.count() <= most else df


#: Bytes of text that a worker takes at a time.
SLICE = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose values of a binary column have `most` bytes or so; a longer value is a slice by itself."""
    for b in batches:
        if b.num_rows:
            data = b.column(column)
            ends = np.frombuffer(data.buffers()[1], np.int64 if pa.types.is_large_binary(data.type) else np.int32)[data.offset : data.offset + b.num_rows + 1].astype(np.int64)
            part = (ends[1:] - ends[0] - 1).clip(0) // most
            cuts = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), b.num_rows]
            for x, y in zip(cuts[:-1], cuts[1:]):
                yield b.slice(x, y - x)

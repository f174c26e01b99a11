"""Helpers that several operators share: text columns, shared storage, document keys."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. Plain lower() is right, and much faster, where every character is one byte."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


#: A table in one file of these sizes may be one row group, and so one task.
ONE_FILE = (1 << 20, 1 << 28)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. The rows of a small one that is a single file are dealt to all cores."""
    path = f"{sf_dir}/{name}.parquet"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)
    df = spark.read.parquet(path)
    return df.repartition(spark.sparkContext.defaultParallelism) if found.isFile() and ONE_FILE[0] < found.getLen() < ONE_FILE[1] else df


def own_name(df: DataFrame, name: str) -> str:
    """A name for a helper column that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices, so that a Python worker holds few texts as objects at a time."""
    for batch in batches:
        yield from (batch.slice(i, rows) for i in range(0, len(batch), rows))


_WRITTEN: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one only where all runs in one process."""
    sc = spark.sparkContext
    set_here = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if set_here:
        return set_here.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="maskloom-"))
    return sc.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage, and a lost executor loses nothing.

    The files stay until the driver ends or clear_stored() is called, since the frame returned can be read at any time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/maskloom-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def clear_stored() -> None:
    """Deletes what stored() has written. Frames built on it can't be read afterwards."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        with contextlib.suppress(Exception):
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


atexit.register(clear_stored)

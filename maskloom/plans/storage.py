"""Tables that a plan writes between its steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list = []
_OWN = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where all runs in one process."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="maskloom-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back, so that nothing above it is computed twice or lost with an executor."""
    path = f"{shared_dir(df.sparkSession)}/maskloom-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    getattr(_OWN, "written", _WRITTEN).append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _clear(written: list) -> None:
    while written:
        spark, path = written.pop()
        with contextlib.suppress(Exception):
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def stored_here() -> Iterator[None]:
    """What this thread stores within is deleted at the end, and nothing else; frames built on it can't be read afterwards."""
    before = getattr(_OWN, "written", None)
    _OWN.written = []
    try:
        yield
    finally:
        _clear(_OWN.written)
        if before is None:
            del _OWN.written
        else:
            _OWN.written = before


def clear_stored() -> None:
    """Deletes all that stored() has written outside stored_here()."""
    _clear(_WRITTEN)


atexit.register(clear_stored)

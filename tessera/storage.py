"""Tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, a temporary one, which only a local master can use."""
    global _own
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return _own


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it back: this cuts its lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables_written() -> int:
    """How many tables ``materialize`` has written and ``remove_tables`` has left."""
    return len(_written)


def remove_tables(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables that ``materialize`` wrote after the first ``since``; frames that read them can't be used any more."""
    for path in _written[since:]:
        remove(spark, path)
    del _written[since:]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

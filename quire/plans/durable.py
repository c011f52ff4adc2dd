"""Cutting lineage with a table in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_OWNERS = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; a temporary one only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="quire-")
    return _LOCAL[app]


def _hadoop(spark: SparkSession, path: str):
    """The path and its file system, whatever store it is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    where, store = _hadoop(spark, path)
    store.delete(where, True)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, which goes when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where, store = _hadoop(spark, path)
    store.mkdirs(where)
    store.deleteOnExit(where)
    if getattr(_OWNERS, "held", None):
        _OWNERS.held[-1].append(path)
    return path


@contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """Delete all folders made inside when the block ends, for long sessions.

    Results that read them must be written inside the block; what is to stay is written to a folder
    made before it.
    """
    if not hasattr(_OWNERS, "held"):
        _OWNERS.held = []
    _OWNERS.held.append([])
    try:
        yield
    finally:
        for path in _OWNERS.held.pop():
            delete(spark, path)


def settled(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the rows once and read them back: later uses do not recompute them.

    Unlike a cache the table survives the loss of executors, and unlike
    checkpoint() the rows are computed a single time. The table goes when the
    application ends, since results that read it may be computed until then, or
    with the block of ``owned`` around it. ``folder`` is one made before.
    """
    path = f"{folder or fresh_folder(df.sparkSession, 'settled')}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

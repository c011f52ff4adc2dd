"""Readers for the parquet tables and small-input spreading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One parquet table; zone-less timestamps become instants (session zone UTC)."""
    df = spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


# bytes of a table that may be moved to use all cores; no larger one is ever shuffled for that
SMALL_TABLE = 1 << 30
# bytes of a table that make a task: rows become files and pages, so few are much work
TASK_BYTES = 2 << 20
# bytes that a grouping by many keys holds in a task, as they are in the file
DEALT_BYTES = 8 << 20
# an estimate above this says that nothing is known
UNKNOWN = 1 << 42


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a small table in a single file, which a scan cannot cut, by tasks that do not
    grow with it.

    Larger tables are returned as they are; their files are cut by
    spark.sql.files.maxPartitionBytes.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > SMALL_TABLE:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to a number of tasks that grows with the table, so that a task does not,
    whatever the session's number of shuffle partitions; a grouping by these keys needs no more.

    Rows of no known size get the session's number.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > UNKNOWN:
        return df.repartition(*keys)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, size // DEALT_BYTES), *keys)

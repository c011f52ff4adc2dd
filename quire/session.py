"""Local session for tests, checks and the bench; a cluster brings its own."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on, in any session.

    HotSpot does not compile methods above 8000 bytes of bytecode; Spark's
    documentation recommends this limit so that such stages fall back to
    smaller generated methods.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    # joins on a unique key leave a hot key of the other side to the skew split
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    # rows can be whole files: a batch for a Python worker is bounded by its bytes as well, which a
    # worker holds several times, and an executor has two workers a core
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the workers of a cluster that does not have it installed."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as folder:  # the driver's own; Spark copies the archive
        path = shutil.make_archive(os.path.join(folder, "quire"), "zip", root, "quire")
        spark.sparkContext.addPyFile(path)
    return spark


def local_session(app: str, cpus: str | None = None) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus or os.environ.get('BENCH_CPUS', '8')}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)

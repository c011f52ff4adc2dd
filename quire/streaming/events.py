"""Document expiry, annotation updates and telemetry as streaming aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.catalog import RETENTION_SECONDS
from quire.operators.usage import SCENARIO_PROBS
from quire.plans.increments import Increments
from quire.plans.skew import last_per_key
from quire.sources.corpus import TELEMETRY_SCHEMA


def expiries(touches: DataFrame, ttl: int = RETENTION_SECONDS, delay: str = "1 hour") -> DataFrame:
    """Documents (doc_id, ts of a store or change) that outlived their time to live.

    A change may arrive ``delay`` late and still keep its document alive.

    A document lives while no gap between its changes exceeds the ttl in whole
    seconds, which is a session; the session's end is the moment of expiry and
    append mode emits it when the watermark has passed.
    """
    return (
        touches.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", f"{ttl + 1} seconds").alias("life"), "doc_id")
        .agg(F.max("ts").alias("last_change"))
        .select("doc_id", "last_change", F.col("life.end").alias("expired_at"))
    )


def annotation_updates(batches: DataFrame) -> DataFrame:
    """Latest annotation count per document (doc_id, batch_ts, annotation_count)."""
    return (
        batches.groupBy("doc_id")
        .agg(F.max(F.struct("batch_ts", "annotation_count")).alias("_last"))
        .select(F.lit("annotations_updated").alias("type"), "doc_id", "_last.batch_ts",
                F.col("_last.annotation_count").alias("count"))
    )


def _newest(rows: DataFrame) -> DataFrame:
    return last_per_key(rows, ["doc_id"], ["batch_ts", "batch"])


def publish_updates(batches: DataFrame, path: str, checkpoint: str,
                    trigger: dict | None = None) -> StreamingQuery:
    """Add the updates of every micro-batch to a table of increments, merged as it grows.

    No state is held between batches; a repeated batch counts once.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        rows = annotation_updates(batch).withColumn("batch", F.lit(epoch).cast("bigint"))
        Increments(batch.sparkSession, path, _newest).add(rows, epoch)

    return batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def latest_updates(spark: SparkSession, path: str) -> DataFrame:
    """The newest update of every document, from few parts however many batches there were."""
    return Increments(spark, path, _newest).read()


def telemetry_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(TELEMETRY_SCHEMA).option("header", True).csv(folder)


def telemetry_windows(samples: DataFrame, width: str = "1 minute",
                      delay: str = "1 minute") -> DataFrame:
    """Mean and peak load per tumbling window of samples with an event time ``ts``."""
    return (
        samples.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"))
        .agg(F.count("*").alias("samples"), F.avg("total_cpu_percent").alias("mean_cpu"),
             F.max("total_cpu_percent").alias("peak_cpu"), F.max("max_hwm_mb").alias("max_hwm_mb"),
             F.max("total_rss_mb").alias("peak_rss_mb"))
        .select(F.col("w.start").alias("start"), "samples", "mean_cpu", "peak_cpu", "peak_rss_mb",
                "max_hwm_mb")
    )


#: the rank of a percentile is off by one part in so many at most
ACCURACY = 1000
#: size of a summary for each part; the bound is then seven standard errors of a rank away
_SIZE = 16


def latency_windows(samples: DataFrame, value: str, keys: Sequence[str] = (), width: str = "1 minute",
                    delay: str = "1 minute", probs: Mapping[str, float] = SCENARIO_PROBS,
                    accuracy: int = ACCURACY) -> DataFrame:
    """Percentiles of a column by keys in tumbling windows of samples with an event time ``ts``.

    The state of a window is one mergeable summary (Karnin, Lang and Liberty) a key, whatever the
    number of samples: tasks summarise their own rows, and summaries meet. Of n values the one given
    for p has a rank within n / accuracy of p * n; up to ``_SIZE`` * accuracy values are all kept.
    ``usage.percentiles`` is exact, in batch.
    """
    if not 1 <= accuracy * _SIZE <= 65535:
        raise ValueError(f"accuracy from 1 to {65535 // _SIZE}")
    found = samples.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), *keys).agg(
        F.count(value).alias("n"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), accuracy * _SIZE).alias("_s"))
    # a window without values has no percentiles
    given = found.select(F.col("w.start").alias("start"), *keys, "n", F.when(
        F.col("n") > 0, F.kll_sketch_get_quantile_double(
            "_s", F.array(*map(F.lit, probs.values())))).alias("_p"))
    return given.select("start", *keys, "n", *[F.col("_p")[k].alias(name) for k, name in enumerate(probs)])

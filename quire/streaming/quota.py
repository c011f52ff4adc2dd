"""Anchored quota windows over a request stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators import usage
from quire.plans.durable import delete

# batches between two rewrites of the state; seconds a request may be late and still find it
COMPACT, LATE = 50, 3600


def _snapshot(epoch: int, compact: int) -> int:
    """The batch after which the state was last written whole, -1 for none."""
    return epoch // compact * compact - 1


def open_windows(spark: SparkSession, path: str, epoch: int, compact: int = COMPACT
                 ) -> DataFrame | None:
    """Open window and use of every key before batch ``epoch``."""
    last = _snapshot(epoch, compact)
    parts = [f"{path}/state/whole={last}"] if last >= 0 else []
    parts += [f"{path}/state/batch={n}" for n in range(last + 1, epoch)]
    if not parts:
        return None
    return usage.last_windows(reduce(DataFrame.unionByName, map(spark.read.parquet, parts)))


def meter(requests: DataFrame, path: str, checkpoint: str, window: int = usage.WINDOW_SECONDS,
          trigger: dict | None = None, compact: int = COMPACT, late: int = LATE) -> StreamingQuery:
    """Decide every request of a stream (quota_key, quota_limit, ts, event_id).

    Each micro-batch runs the batch operator with the open windows of its keys
    as the starting state, so a hot key is split inside a batch as well.
    Decisions go to ``path/decisions``, the windows of the keys of batch n to
    ``path/state/batch=n``; both are overwritten when a batch is repeated. Every
    ``compact`` batches the state is written whole, without the windows that
    ended ``late`` seconds before the newest request, and older parts go.
    ``trigger`` is that of the stream, by default all that is available.
    """
    def decide(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        state = open_windows(spark, path, epoch, compact)
        if state is not None:
            # windows that ended before the batch decide nothing in it
            first = batch.agg(F.min(F.floor(F.unix_micros("ts") / 1e6))).first()[0] or 0
            state = state.where(F.col("open_start") + window > first).join(
                batch.select("quota_key").distinct(), "quota_key", "left_semi")
        out = f"{path}/decisions/batch={epoch}"
        usage.quota_decisions(batch, window=window, state=state).write.mode("overwrite").parquet(out)
        usage.quota_state(spark.read.parquet(out), state).write.mode("overwrite").parquet(
            f"{path}/state/batch={epoch}")
        if (epoch + 1) % compact == 0:
            whole = reduce(DataFrame.unionByName, [
                x for x in (open_windows(spark, path, epoch, compact),
                            spark.read.parquet(f"{path}/state/batch={epoch}")) if x is not None])
            newest = spark.read.parquet(out).agg(F.max(F.unix_micros("ts"))).first()[0] or 0
            usage.last_windows(whole).where(
                F.col("open_start") + window + late > newest // 1_000_000
            ).write.mode("overwrite").parquet(f"{path}/state/whole={epoch}")
            # the parts before the last whole state; a repeated batch needs the later ones
            for n in range(epoch + 1 - 2 * compact, epoch + 1 - compact):
                delete(spark, f"{path}/state/batch={n}")
            delete(spark, f"{path}/state/whole={epoch - 2 * compact}")

    return requests.writeStream.foreachBatch(decide).option(
        "checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

"""Quotas, cache and request statistics, percentiles, telemetry and sizing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.plans import skew
from quire.plans.durable import settled
from quire.plans.grouped import Arrays, map_sorted_groups

# Quota window and default limits.
WINDOW_SECONDS = 3600
KEY_LIST_LIMIT = 1000
UNKNOWN_KEY_LIMIT = 10_000
ANONYMOUS_LIMIT, ANONYMOUS_REMAINING = 100_000, 99_999

# Render parameters.
DPI_DEFAULT, DPI_MIN, DPI_MAX = 120, 10, 600

# windows per chunk of a key's time line; a chunk holds at most
# WINDOW_SECONDS * CHUNK_WINDOWS distinct seconds
CHUNK_WINDOWS = 24
NO_WINDOW = -1


# --- quota keys -----------------------------------------------------------

def parse_key_list(df: DataFrame, col: str) -> DataFrame:
    """Rows (api_key, quota_limit) of lists like ``a:10,b``; a bad number drops its key."""
    parts = F.split(F.trim("entry"), ":")
    number = F.get(parts, F.lit(1))
    limit = F.when(number.isNull(), F.lit(KEY_LIST_LIMIT).cast("bigint")).when(
        number.rlike("^[+]?[0-9]+$"), number.try_cast("bigint"))
    rows = df.select(F.explode(F.split(col, ",")).alias("entry"))
    # a bare entry needs a name; an entry with a number is kept as it is
    return rows.select(parts[0].alias("api_key"), limit.alias("quota_limit"),
                       number.isNull().alias("_bare")).where(
        F.col("quota_limit").isNotNull() & ~(F.col("_bare") & (F.col("api_key") == ""))
    ).drop("_bare")


def resolve_limits(requests: DataFrame, limits: DataFrame, auth_required: bool) -> DataFrame:
    """Key rules per request: adds quota_key, quota_limit and key_status.

    anonymous: no key and none required; invalid: empty, or unknown while
    required; otherwise the key's own limit or the general one.
    """
    key = F.trim("api_key")
    # requests without a key find no limit: spread them instead of joining one null key
    place = F.coalesce(F.nullif(key, F.lit("")),
                       F.concat(F.lit("\0"), F.spark_partition_id().cast("string")))
    joined = (
        requests.withColumns({"quota_key": key, "_place": place})
        .join(limits.select(F.col("api_key").alias("_place"), "quota_limit"), "_place", "left")
        .drop("_place")
    )
    missing, empty = F.col("api_key").isNull(), F.col("api_key") == ""
    if auth_required:
        status = F.when(missing | empty | F.col("quota_limit").isNull(), "invalid")
    else:
        status = F.when(missing, "anonymous").when(empty, "invalid")
    status = F.coalesce(status, F.lit("metered"))
    limit = (
        F.when(F.col("key_status") == "anonymous", F.lit(ANONYMOUS_LIMIT).cast("bigint"))
        .when(F.col("key_status") == "metered",
              F.coalesce("quota_limit", F.lit(UNKNOWN_KEY_LIMIT).cast("bigint"))))
    return joined.withColumn("key_status", status).withColumns({
        "quota_limit": limit,
        "quota_key": F.when(F.col("key_status") == "anonymous", F.lit("anonymous"))
        .otherwise(F.col("quota_key")),
    })


# --- anchored quota windows -----------------------------------------------

def _next_start(secs: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Index of the first second that opens a new window after the one opened at ``at``."""
    return np.searchsorted(secs, secs[at] + window)


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


def _chunk_summary(window: int):
    def summarise(g: Arrays) -> Arrays:
        """Where a chunk can be entered, and the last window start for each entry."""
        secs, chunk = g["sec"], int(g["_chunk"][0])
        # a window open at the chunk's start ends within its first window length,
        # one continued from earlier requests within a window of its own start
        opened = max(chunk * window * CHUNK_WINDOWS, int(g["open_start"][0]))
        last = np.searchsorted(secs, opened + window)
        entries = np.arange(min(last + 1, len(secs)))
        at = entries.copy()
        while True:
            nxt = _next_start(secs, at, window)
            more = nxt < len(secs)
            if not more.any():
                break
            at = np.where(more, nxt, at)
        return {"quota_key": g["quota_key"][:1], "_chunk": g["_chunk"][:1],
                "open_start": g["open_start"][:1], "entries": _objects([secs[entries]]), "exits": _objects([secs[at]])}

    return summarise


def _chain_chunks(window: int):
    def chain(g: Arrays) -> Arrays:
        """Window open at the start of every chunk of one key; -1 for none."""
        start = int(g["open_start"][0])
        carried = np.empty(len(g["_chunk"]), np.int64)
        for no, (entries, exits) in enumerate(zip(g["entries"], g["exits"])):
            carried[no] = start
            at = 0 if start == NO_WINDOW else int(np.searchsorted(entries, start + window))
            if at < len(entries):
                start = int(exits[at])
        return {"quota_key": g["quota_key"], "_chunk": g["_chunk"], "carried": carried}

    return chain


def _assign_windows(window: int):
    def assign(g: Arrays) -> Arrays:
        """Window start of every second of a chunk."""
        secs, carried = g["sec"], int(g["carried"][0])
        starts = np.empty(len(secs), np.int64)
        at = 0
        if carried != NO_WINDOW:
            at = int(np.searchsorted(secs, carried + window))
            starts[:at] = carried
        while at < len(secs):
            nxt = int(np.searchsorted(secs, secs[at] + window))
            starts[at:nxt] = secs[at]
            at = nxt
        return {"quota_key": g["quota_key"], "sec": secs, "n": g["n"], "window_start": starts}

    return assign


def quota_decisions(requests: DataFrame, order: Sequence[str] = ("ts", "event_id"),
                    window: int = WINDOW_SECONDS, state: DataFrame | None = None) -> DataFrame:
    """Fixed windows anchored at a key's first request, for (quota_key, quota_limit, ts).

    A window opens with the first request after the last one ran out; every
    request counts, refused ones too. Adds window_start, used, remaining,
    reset_epoch and accepted.

    Only counts per key and second are walked. A key's time line is cut into
    chunks; each chunk is summarised on its own (which last window follows from
    which entry), the short summaries are chained per key, and the windows are
    then assigned per chunk. A key with a third of all requests is thus worked
    on by as many tasks as it has chunks.

    ``state`` (quota_key, open_start, open_used) continues windows of earlier
    requests; times before an open window's start count into that window.
    """
    timed = requests.withColumn("sec", F.floor(F.unix_micros("ts") / 1e6).cast("bigint"))
    # the compact counts are read twice below, the requests only once more
    per_sec = settled(
        timed.groupBy("quota_key", "sec").agg(F.count("*").alias("n"))
        .withColumn("_chunk", F.floor(F.col("sec") / (window * CHUNK_WINDOWS)))
    )
    key_type = dict(requests.dtypes)["quota_key"]
    if state is None:
        opened = per_sec.withColumn("open_start", F.lit(NO_WINDOW).cast("bigint"))
    else:
        opened = per_sec.join(state.select("quota_key", "open_start"), "quota_key", "left") \
            .fillna(NO_WINDOW, ["open_start"])
    summaries = map_sorted_groups(
        opened.select("quota_key", "_chunk", "sec", "open_start"), ["quota_key", "_chunk"], ["sec"],
        _chunk_summary(window),
        f"quota_key {key_type}, _chunk bigint, open_start bigint, entries array<bigint>, "
        "exits array<bigint>")
    chain = map_sorted_groups(summaries, ["quota_key"], ["_chunk"], _chain_chunks(window),
                              f"quota_key {key_type}, _chunk bigint, carried bigint")
    assigned = map_sorted_groups(
        per_sec.join(chain, ["quota_key", "_chunk"]), ["quota_key", "_chunk"], ["sec"],
        _assign_windows(window), f"quota_key {key_type}, sec bigint, n bigint, window_start bigint")
    # a window holds at most `window` distinct seconds (and late ones of a stream)
    earlier = Window.partitionBy("quota_key", "window_start").orderBy("sec").rowsBetween(
        Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    starts = assigned.withColumn("_before", before).drop("n")
    if state is not None:
        opened = state.select("quota_key", F.col("open_start").alias("window_start"), "open_used")
        starts = starts.join(opened, ["quota_key", "window_start"], "left").withColumn(
            "_before", F.col("_before") + F.coalesce("open_used", F.lit(0))).drop("open_used")
    inside = Window.partitionBy("quota_key", "sec").orderBy(*order)
    used = (F.col("_before") + F.row_number().over(inside)).cast("bigint")
    limit = F.col("quota_limit")
    return (
        timed.join(starts, ["quota_key", "sec"])
        .withColumn("used", used)
        .withColumns({
            "remaining": F.greatest(limit - F.col("used"), F.lit(0)).cast("bigint"),
            "reset_epoch": F.col("window_start") + window,
            "accepted": F.col("used") <= limit,
        })
        .drop("sec", "_before")
    )


def quota_state(decisions: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Open window and its use per key after some decisions."""
    now = decisions.select("quota_key", F.col("window_start").alias("open_start"),
                           F.col("used").alias("open_used"))
    return last_windows(now if state is None else now.unionByName(state))


def last_windows(rows: DataFrame) -> DataFrame:
    """The latest window of every key and its largest use."""
    return rows.groupBy("quota_key").agg(F.max(F.struct("open_start", "open_used")).alias("_s")) \
        .select("quota_key", "_s.open_start", "_s.open_used")


# --- cache and requests -----------------------------------------------------

def cache_key(doc: Column, page: Column, dpi: Column, *variant: Column) -> Column:
    blank = F.lit("")
    tail = F.concat_ws(":", *[F.coalesce(v.cast("string"), blank) for v in variant])
    return F.sha2(F.concat_ws(":", doc, page, dpi, tail), 256)


def render_params(dpi: Column, number: Column) -> tuple[Column, Column]:
    """Clamped dpi and an optional number given as text (bad text is an error, here null)."""
    clamped = F.greatest(F.least(F.coalesce(dpi, F.lit(DPI_DEFAULT)), F.lit(DPI_MAX)), F.lit(DPI_MIN))
    absent = number.isNull() | number.isin("", "undefined", "null")
    return clamped, F.when(~absent, number.try_cast("double"))


def cache_counters(log: DataFrame, by: Sequence[str] = ("node",)) -> DataFrame:
    """Counts of l1, l2, miss and write outcomes, and the hit ratio in percent."""
    def n(outcome: str) -> Column:
        return F.count_if(F.col("outcome") == outcome)

    hits, looked = F.col("l1_hits") + F.col("l2_hits"), (
        F.col("l1_hits") + F.col("l2_hits") + F.col("misses"))
    return log.groupBy(*by).agg(
        n("l1").alias("l1_hits"), n("l2").alias("l2_hits"), n("miss").alias("misses"),
        n("write").alias("writes"),
    ).withColumn("hit_ratio_percent", F.when(looked > 0, F.round(hits / looked * 100, 2))
                 .otherwise(F.lit(100.0)))


def cache_metrics(counters: DataFrame, by: Sequence[str] = ("node",)) -> DataFrame:
    """Counters in long form: one row per node and tier."""
    return counters.unpivot(list(by), ["l1_hits", "l2_hits", "misses", "writes"], "tier", "value")


def percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float],
                method: str = "linear") -> DataFrame:
    """Exact percentiles per key without holding a key's values in one task.

    Values are counted and dealt into ranges of (key, value) of equal size, as a
    sample of them tells; a range is a chunk of the running counts, whatever the
    scale of the values. The rows at the wanted positions are picked. linear:
    position (n - 1) * p with interpolation; index: position floor(n * p).
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    counted = settled(counts.repartitionByRange(*keys, value)
                      .withColumn("_range", F.spark_partition_id()))
    ranked = skew.chunked_running(counted, keys, [value], F.col("_range"),
                                  sums={"_upto": F.col("_n")})
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    rows = ranked.join(totals, keys)
    picks = []
    for name, p in probs.items():
        if method == "linear":
            at = (F.col("_total") - 1) * F.lit(float(p))
            positions = {"lo": F.floor(at), "hi": F.ceil(at)}
        else:
            positions = {"lo": F.floor(F.col("_total") * F.lit(float(p)))}
        for edge, position in positions.items():
            here = (F.col("_upto") - F.col("_n") <= position) & (position < F.col("_upto"))
            picks.append(F.max(F.when(here, F.col(value))).alias(f"_{edge}_{name}"))
    found = rows.groupBy(*keys).agg(F.max("_total").alias("n"), *picks)
    out = {}
    for name, p in probs.items():
        lo = F.col(f"_lo_{name}")
        if method == "linear":
            at = (F.col("n") - 1) * F.lit(float(p))
            hi = F.col(f"_hi_{name}")
            frac = at - F.floor(at)
            out[name] = F.when(frac == 0, lo).otherwise(
                lo * (F.ceil(at) - at) + hi * (at - F.floor(at)))
        else:
            out[name] = lo
    return found.select(*keys, "n", *[e.alias(n) for n, e in out.items()])


# Percentiles of a scenario summary and the queueing flag.
SCENARIO_PROBS = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
CONTENTION_RATIO = 15.0


def scenario_statistics(requests: DataFrame, keys: Sequence[str], duration: Column) -> DataFrame:
    """Requests, errors, rate, MiB/s and latency distribution per scenario.

    requests: latency_ms (null for an error), n_bytes, ok; duration in seconds.
    """
    keys = list(keys)
    base = requests.groupBy(*keys).agg(
        F.count("*").alias("requests"), F.count_if(~F.col("ok")).alias("errors"),
        F.sum("n_bytes").alias("n_bytes"), F.min("latency_ms").alias("min_ms"),
        F.max("latency_ms").alias("max_ms"), F.avg("latency_ms").alias("avg_ms"),
        duration.alias("duration_s"))
    spread_of = percentiles(requests, keys, "latency_ms", SCENARIO_PROBS).drop("n")
    d = F.col("duration_s")
    ratio = F.when(F.col("p50") > 0, F.col("p99") / F.col("p50")).otherwise(F.lit(1.0))
    return base.join(spread_of, keys, "left").withColumns({
        "rps": F.when(d > 0, F.col("requests") / d).otherwise(F.lit(0.0)),
        "mib_per_s": F.when(d > 0, F.col("n_bytes") / (1024 * 1024) / d).otherwise(F.lit(0.0)),
        "p99_p50": ratio, "contention": ratio > CONTENTION_RATIO,
    })


def traffic_mix(requests: DataFrame, kind: str) -> DataFrame:
    """Share of every kind of request."""
    n = settled(requests.groupBy(kind).agg(F.count("*").alias("requests")))
    total = n.agg(F.sum("requests").alias("_all"))  # one row
    return n.join(F.broadcast(total)).withColumn(
        "share", F.col("requests") / F.col("_all")).drop("_all")


def process_cpu(samples: DataFrame, ticks_per_second: int = 100,
                chunk_seconds: int = 86_400) -> DataFrame:
    """CPU percent per process sample from counter differences (pid, ts, utime, stime)."""
    seconds = F.unix_micros("ts") / 1e6
    prev = skew.chunked_running(
        samples, ["pid"], ["ts"], F.floor(seconds / chunk_seconds),
        lags={"prev_ticks": F.col("utime") + F.col("stime"), "prev_s": seconds})
    dt = seconds - F.col("prev_s")
    ticks = F.col("utime") + F.col("stime") - F.col("prev_ticks")
    cpu = F.when(dt > 0, ticks / (ticks_per_second * dt) * 100.0).otherwise(F.lit(0.0))
    return prev.withColumn("cpu_percent", F.coalesce(cpu, F.lit(0.0))).drop("prev_ticks", "prev_s")


def interval_totals(cpu: DataFrame, at: Sequence[str] = ("ts",)) -> DataFrame:
    """Totals over the processes of one interval, and the highest high-water mark."""
    return cpu.groupBy(*at).agg(
        F.countDistinct("pid").alias("active_nodes"), F.sum("cpu_percent").alias("total_cpu_percent"),
        F.sum("rss_mb").alias("total_rss_mb"), F.max("hwm_mb").alias("max_hwm_mb"))


def sla_grid(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Metrics (metric, value) against thresholds (metric, op, threshold)."""
    joined = metrics.join(thresholds, "metric")
    met = F.when(F.col("op") == "<=", F.col("value") <= F.col("threshold")).otherwise(
        F.col("value") >= F.col("threshold"))
    return joined.withColumn("met", met)


# Thresholds of the acceptance grid.
SLA_THRESHOLDS = [
    ("p50_ms", "<=", 2.0), ("p99_ms", "<=", 50.0), ("max_ms", "<=", 250.0),
    ("success_percent", ">=", 99.99), ("rss_mb", "<=", 256.0),
]


def capacity(df: DataFrame, per_day: Column, throughput: Column, hours: float = 24.0,
             peak: float = 5.0) -> DataFrame:
    """Mean and peak need per second, headroom in percent and instances needed."""
    mean = per_day / (hours * 3600.0)
    return df.withColumns({
        "need_per_s": mean, "peak_per_s": mean * peak,
        "headroom_percent": throughput / (mean * peak) * 100.0,
        "instances": F.greatest(F.ceil(mean * peak / throughput), F.lit(1)).cast("bigint"),
    })

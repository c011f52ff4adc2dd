"""Quota, cache, latency and telemetry queries over events, orders and customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import usage as U
from quire.sources.tables import spread, table


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")


def _requests_by(spark, sf, key, limit):
    """Requests against a limit; an event that is there twice with its time and key counts once."""
    e = _events(spark, sf).select(F.col(key).alias("quota_key"), "ts", "event_id").distinct()
    return e.withColumn("quota_limit", F.lit(limit).cast("bigint"))


def quota_windows(spark, sf):
    req = _requests_by(spark, sf, "user_id", 2)
    return U.quota_decisions(req).select(
        "event_id", "window_start", "used", "remaining", "reset_epoch", "accepted")


def quota_daily(spark, sf):
    """Day-long windows on event types: few keys with very many requests."""
    req = _requests_by(spark, sf, "event_type", 50)
    return U.quota_decisions(req, window=86400).select(
        "event_id", "window_start", "used", "remaining", "reset_epoch", "accepted")


def _limits(spark, sf):
    """Key list text per customer segment, parsed into limits."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    entry = F.concat(F.lit(" k"), "c_custkey", F.when(F.col("c_custkey") % 3 == 0, "")
                     .when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(":"), F.col("c_custkey") * 10))
                     .otherwise(F.lit(":many")))
    return U.parse_key_list(c.select(F.concat(entry, F.lit(",")).alias("keys")), "keys")


def quota_key_list(spark, sf):
    return _limits(spark, sf)


def _keyed(spark, sf):
    e = _events(spark, sf)
    return e.select("event_id", F.when(F.col("event_id") % 10 == 0, None)
                    .when(F.col("event_id") % 10 == 1, "")
                    .otherwise(F.concat(F.lit(" k"), "user_id")).alias("api_key"))


def quota_key_rules(spark, sf):
    return U.resolve_limits(_keyed(spark, sf), _limits(spark, sf), False).groupBy(
        "key_status", "quota_limit").agg(F.count("*").alias("requests"))


def quota_key_rules_required(spark, sf):
    return U.resolve_limits(_keyed(spark, sf), _limits(spark, sf), True).groupBy(
        "key_status", "quota_limit").agg(F.count("*").alias("requests"))


def cache_keys(spark, sf):
    e = _events(spark, sf)
    dpi, wc = U.render_params(
        F.when(F.col("event_id") % 4 > 0, (F.col("event_id") % 900).cast("int")),
        F.when(F.col("event_id") % 5 == 0, "undefined").when(F.col("event_id") % 5 == 1, "")
        .when(F.col("event_id") % 5 == 2, "12x").otherwise((F.col("event_id") % 7 * 10 + 0.5)
                                                          .cast("string")))
    return e.select("event_id", "user_id", dpi.alias("dpi"), wc.alias("wc")).select(
        "event_id", F.col("dpi").cast("bigint").alias("dpi"), "wc",
        U.cache_key(F.col("user_id"), F.col("event_id") % 9 + 1, F.col("dpi"), F.lit("orig"),
                    F.lit("default"), F.lit(""), F.col("wc"), F.lit("")).alias("cache_key"))


def _cache_log(spark, sf):
    outcome = (F.when(F.col("event_type") == "view", "l1").when(F.col("event_type") == "click", "l2")
               .when(F.col("event_type") == "error", "miss").otherwise(F.lit("write")))
    return _events(spark, sf).select(F.concat(F.lit("node-"), F.col("user_id") % 8).alias("node"),
                                     outcome.alias("outcome"))


def cache_hit_ratio(spark, sf):
    return U.cache_counters(_cache_log(spark, sf))


def cache_tier_metrics(spark, sf):
    return U.cache_metrics(U.cache_counters(_cache_log(spark, sf)))


def _requests(spark, sf):
    e = _events(spark, sf)
    ok = F.col("event_type") != "error"
    return e.select(F.concat(F.lit("scenario-"), F.col("user_id") % 5).alias("scenario"), "ts",
                    F.when(ok, F.col("value")).alias("latency_ms"), ok.alias("ok"),
                    (F.col("event_id") % 5000).alias("n_bytes"))


def scenario_statistics(spark, sf):
    stats = U.scenario_statistics(_requests(spark, sf), ["scenario"],
                                  F.lit(3600.0))
    cols = ["min_ms", "max_ms", "p50", "p75", "p90", "p95", "p99", "p999", "p99_p50", "rps",
            "mib_per_s", "avg_ms"]
    return stats.select("scenario", "requests", "errors", "n_bytes", "contention",
                        *[F.round(c, 6).alias(c) for c in cols])


def index_percentiles(spark, sf):
    return U.percentiles(_events(spark, sf), ["event_type"], "value",
                         {"p50": 0.5, "p95": 0.95, "p99": 0.99}, method="index")


def traffic_mix(spark, sf):
    return U.traffic_mix(_events(spark, sf), "event_type")


def _samples(spark, sf):
    """Counter samples of processes: running event counts stand for clock ticks."""
    e = _events(spark, sf)
    hour = F.date_trunc("hour", "ts")
    return e.groupBy((F.col("user_id") % 6).alias("pid"), hour.alias("ts")).agg(
        F.sum("event_id").alias("utime"), F.count("*").alias("stime"),
        F.max(F.col("event_id") % 400).cast("double").alias("rss_mb"),
        F.max(F.col("event_id") % 500).cast("double").alias("hwm_mb"))


def process_cpu(spark, sf):
    return U.process_cpu(_samples(spark, sf)).select(
        "pid", "ts", F.round("cpu_percent", 9).alias("cpu_percent"))


def telemetry_totals(spark, sf):
    totals = U.interval_totals(U.process_cpu(_samples(spark, sf)))
    return totals.select("ts", "active_nodes", F.round("total_cpu_percent", 9)
                         .alias("total_cpu_percent"), "total_rss_mb", "max_hwm_mb")


def sla_grid(spark, sf):
    stats = U.scenario_statistics(_requests(spark, sf), ["scenario"], F.lit(3600.0))
    metrics = stats.select(
        "scenario", F.col("p50").alias("p50_ms"), F.col("p99").alias("p99_ms"), "max_ms",
        ((F.col("requests") - F.col("errors")) / F.col("requests") * 100).alias("success_percent"))
    long = metrics.unpivot(["scenario"], ["p50_ms", "p99_ms", "max_ms", "success_percent"],
                           "metric", "value")
    limits = spark.createDataFrame(U.SLA_THRESHOLDS, "metric string, op string, threshold double")
    return U.sla_grid(long, limits).select("scenario", "metric", F.round("value", 6).alias("value"),
                                           "met")


def capacity_sizing(spark, sf):
    n = _events(spark, sf).groupBy("event_type").agg(F.count("*").alias("per_day"),
                                                     F.max("user_id").alias("tp"))
    sized = U.capacity(n, F.col("per_day") * 1000, F.col("tp") / 100.0, hours=8.0)
    return sized.select("event_type", "per_day", F.round("need_per_s", 6).alias("need_per_s"),
                        F.round("peak_per_s", 6).alias("peak_per_s"),
                        F.round("headroom_percent", 6).alias("headroom_percent"), "instances")


QUERIES = {f.__name__: f for f in (
    quota_windows, quota_daily, quota_key_list, quota_key_rules, quota_key_rules_required,
    cache_keys, cache_hit_ratio, cache_tier_metrics, scenario_statistics, index_percentiles,
    traffic_mix, process_cpu, telemetry_totals, sla_grid, capacity_sizing)}


def _quota_sql(key: str, limit: int, window: int) -> str:
    """Window starts by recursion from each key's first request."""
    return f"""WITH RECURSIVE e AS (
  SELECT event_id, ts, {key} AS k, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events),
s AS (
  SELECT k, min(sec) AS start FROM e GROUP BY 1
  UNION ALL
  SELECT k, start FROM (SELECT s.k, (SELECT min(e.sec) FROM e WHERE e.k = s.k AND e.sec >= s.start + {window})
                          AS start FROM s) WHERE start IS NOT NULL),
w AS (SELECT e.event_id, e.ts, e.k, max(s.start) AS window_start
      FROM e JOIN s ON e.k = s.k AND s.start <= e.sec GROUP BY 1, 2, 3),
u AS (SELECT *, row_number() OVER (PARTITION BY k, window_start ORDER BY ts, event_id) AS used FROM w)
SELECT event_id, window_start, used, CAST(greatest({limit} - used, 0) AS BIGINT) AS remaining,
       window_start + {window} AS reset_epoch, used <= {limit} AS accepted FROM u"""


LIMITS = """
limits AS (
  SELECT 'k' || c_custkey AS api_key, CASE WHEN c_custkey % 3 = 0 THEN 1000 ELSE c_custkey * 10 END
    AS quota_limit FROM customer WHERE c_custkey % 3 < 2)
"""
KEYED = """
keyed AS (
  SELECT event_id, event_id % 10 AS m, CASE WHEN event_id % 10 > 1 THEN 'k' || user_id END AS key FROM events),
resolved AS (SELECT m, quota_limit AS own FROM keyed LEFT JOIN limits ON key = api_key)
"""
REQ = """
req AS (
  SELECT 'scenario-' || (user_id % 5) AS scenario, CASE WHEN event_type <> 'error' THEN value END AS lat,
         event_type <> 'error' AS ok, event_id % 5000 AS n_bytes FROM events),
st AS (
  SELECT scenario, count(*) AS requests, count(*) FILTER (NOT ok) AS errors,
    CAST(sum(n_bytes) AS BIGINT) AS n_bytes, min(lat) AS min_ms, max(lat) AS max_ms,
    avg(lat) AS avg_ms, quantile_cont(lat, 0.5) AS p50, quantile_cont(lat, 0.75) AS p75,
    quantile_cont(lat, 0.9) AS p90, quantile_cont(lat, 0.95) AS p95, quantile_cont(lat, 0.99) AS p99,
    quantile_cont(lat, 0.999) AS p999 FROM req GROUP BY 1)
"""
SAMPLES = """
samples AS (
  SELECT user_id % 6 AS pid, date_trunc('hour', ts) AS ts, CAST(sum(event_id) AS BIGINT) AS utime,
    count(*) AS stime, CAST(max(event_id % 400) AS DOUBLE) AS rss_mb,
    CAST(max(event_id % 500) AS DOUBLE) AS hwm_mb FROM events GROUP BY 1, 2),
d AS (SELECT *, utime + stime - lag(utime + stime) OVER w AS ticks,
             epoch(ts) - lag(epoch(ts)) OVER w AS dt FROM samples WINDOW w AS (PARTITION BY pid ORDER BY ts)),
cpu AS (SELECT *, CASE WHEN dt > 0 THEN ticks / (100 * dt) * 100.0 ELSE 0.0 END AS cpu FROM d)
"""

SQL = {
    "quota_windows": _quota_sql("user_id", 2, 3600),
    "quota_daily": _quota_sql("event_type", 50, 86400),
    "quota_key_list": f"WITH {LIMITS} SELECT api_key, quota_limit FROM limits",
    "quota_key_rules": f"""WITH {LIMITS}, {KEYED}
SELECT CASE m WHEN 0 THEN 'anonymous' WHEN 1 THEN 'invalid' ELSE 'metered' END AS key_status,
  CAST(CASE m WHEN 0 THEN 100000 WHEN 1 THEN NULL ELSE coalesce(own, 10000) END AS BIGINT) AS quota_limit,
  count(*) AS requests FROM resolved GROUP BY 1, 2""",
    "quota_key_rules_required": f"""WITH {LIMITS}, {KEYED}
SELECT CASE WHEN m < 2 OR own IS NULL THEN 'invalid' ELSE 'metered' END AS key_status,
  CAST(CASE WHEN m < 2 THEN NULL ELSE own END AS BIGINT) AS quota_limit,
  count(*) AS requests FROM resolved GROUP BY 1, 2""",
    "cache_keys": """
WITH p AS (SELECT *, CASE WHEN event_id % 4 > 0 THEN least(greatest(event_id % 900, 10), 600) ELSE 120 END AS dpi,
  CASE WHEN event_id % 5 > 2 THEN CAST(event_id % 7 * 10 + 0.5 AS DOUBLE) END AS wc FROM events)
SELECT event_id, dpi, wc, sha256(user_id || ':' || (event_id % 9 + 1) || ':' || dpi || ':orig:default::'
  || coalesce(CAST(wc AS VARCHAR), '') || ':') AS cache_key FROM p""",
    "cache_hit_ratio": """
WITH c AS (SELECT 'node-' || (user_id % 8) AS node, count(*) FILTER (event_type = 'view') AS l1_hits,
  count(*) FILTER (event_type = 'click') AS l2_hits, count(*) FILTER (event_type = 'error') AS misses,
  count(*) FILTER (event_type IN ('signup', 'purchase')) AS writes FROM events GROUP BY 1)
SELECT *, CASE WHEN l1_hits + l2_hits + misses > 0
  THEN round((l1_hits + l2_hits) / (l1_hits + l2_hits + misses) * 100, 2) ELSE 100.0 END
  AS hit_ratio_percent FROM c""",
    "cache_tier_metrics": """
SELECT 'node-' || (user_id % 8) AS node, CASE event_type WHEN 'view' THEN 'l1_hits'
  WHEN 'click' THEN 'l2_hits' WHEN 'error' THEN 'misses' ELSE 'writes' END AS tier,
  count(*) AS value FROM events GROUP BY 1, 2""",
    "scenario_statistics": f"""WITH {REQ}
SELECT scenario, requests, errors, n_bytes,
  CASE WHEN p50 > 0 THEN p99 / p50 ELSE 1.0 END > 15 AS contention,
  round(min_ms, 6) AS min_ms, round(max_ms, 6) AS max_ms, round(avg_ms, 6) AS avg_ms,
  round(p50, 6) AS p50, round(p75, 6) AS p75, round(p90, 6) AS p90, round(p95, 6) AS p95,
  round(p99, 6) AS p99, round(p999, 6) AS p999,
  round(CASE WHEN p50 > 0 THEN p99 / p50 ELSE 1.0 END, 6) AS p99_p50,
  round(requests / 3600.0, 6) AS rps, round(n_bytes / 1048576.0 / 3600.0, 6) AS mib_per_s FROM st""",
    "index_percentiles": """
WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, n, v[CAST(floor(n * 0.5) AS BIGINT) + 1] AS p50,
  v[CAST(floor(n * 0.95) AS BIGINT) + 1] AS p95, v[CAST(floor(n * 0.99) AS BIGINT) + 1] AS p99 FROM s""",
    "traffic_mix": """
SELECT event_type, count(*) AS requests, count(*) / (SELECT count(*) FROM events) AS share
FROM events GROUP BY 1""",
    "process_cpu": f"WITH {SAMPLES} SELECT pid, ts, round(cpu, 9) AS cpu_percent FROM cpu",
    "telemetry_totals": f"""WITH {SAMPLES}
SELECT ts, count(DISTINCT pid) AS active_nodes, round(sum(cpu), 9) AS total_cpu_percent,
  sum(rss_mb) AS total_rss_mb, max(hwm_mb) AS max_hwm_mb FROM cpu GROUP BY 1""",
    "sla_grid": f"""WITH {REQ},
m AS (SELECT scenario, 'p50_ms' AS metric, p50 AS value, p50 <= 2 AS met FROM st
  UNION ALL SELECT scenario, 'p99_ms', p99, p99 <= 50 FROM st
  UNION ALL SELECT scenario, 'max_ms', max_ms, max_ms <= 250 FROM st
  UNION ALL SELECT scenario, 'success_percent', (requests - errors) / requests * 100,
    (requests - errors) / requests * 100 >= 99.99 FROM st)
SELECT scenario, metric, round(value, 6) AS value, met FROM m""",
    "capacity_sizing": """
WITH n AS (SELECT event_type, count(*) AS per_day, max(user_id) / 100.0 AS tp FROM events GROUP BY 1),
s AS (SELECT *, per_day * 1000 / (8.0 * 3600) AS mean FROM n)
SELECT event_type, per_day, round(mean, 6) AS need_per_s, round(CAST(mean * 5 AS DOUBLE), 6) AS peak_per_s,
  round(tp / (mean * 5) * 100, 6) AS headroom_percent,
  greatest(CAST(ceil(mean * 5 / tp) AS BIGINT), 1) AS instances FROM s""",
}

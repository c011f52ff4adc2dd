import random
import statistics
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quire.operators import usage as U
from quire.plans import skew
from quire.streaming import quota

T0 = datetime(2024, 1, 1)
REQ = "quota_key string, quota_limit bigint, ts timestamp, event_id bigint"


def requests(spark, rows):
    return spark.createDataFrame(
        [(k, lim, (T0 + timedelta(seconds=s)).replace(tzinfo=timezone.utc), i)
         for i, (k, lim, s) in enumerate(rows)], REQ)


def walk(rows, window, state=None):
    """One pass per key in time order."""
    state, out = dict(state or {}), {}
    base = int(T0.replace(tzinfo=timezone.utc).timestamp())
    for i, (k, lim, s) in sorted(enumerate(rows), key=lambda r: (r[1][2], r[0])):
        t = base + int(s)
        start, n = state.get(k, (t, 0))
        if t >= start + window:
            start, n = t, 0
        state[k] = (start, n + 1)
        out[i] = (start, n + 1, max(lim - n - 1, 0), n + 1 <= lim)
    return out


def as_dict(df):
    return {r.event_id: (r.window_start, r.used, r.remaining, r.accepted) for r in df.collect()}


def test_quota_limit_two(spark):
    rows = [("a", 2, s) for s in (0, 10, 20, 3599, 3600)]
    got = U.quota_decisions(requests(spark, rows)).orderBy("event_id").collect()
    assert [r.accepted for r in got] == [True, True, False, False, True]
    base = int(T0.replace(tzinfo=timezone.utc).timestamp())
    assert [r.reset_epoch - base for r in got] == [3600] * 4 + [7200]


def test_quota_equals_one_pass_per_key(spark):
    rng = random.Random(11)
    for window, horizon in ((3600, 40 * 3600), (10, 3000), (60, 500)):
        rows = [(rng.choice("aaaaab"), 3, rng.uniform(0, horizon)) for _ in range(600)]
        got = as_dict(U.quota_decisions(requests(spark, rows), window=window))
        assert got == walk(rows, window)


@pytest.mark.parametrize("window", [10, 600])
def test_stream_quota_equals_batch(spark, tmp_path, window):
    rng = random.Random(12)
    rows = sorted(((rng.choice("ab"), 2, float(rng.randrange(0, 9000))) for _ in range(90)),
                  key=lambda r: r[2])
    # no key has two requests in one second across a batch border
    rows = list({(k, int(s)): (k, n, s) for k, n, s in rows}.values())
    df = requests(spark, rows)
    for no in range(3):
        part = df.where((F.col("event_id") >= no * 30) & (F.col("event_id") < (no + 1) * 30))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(REQ).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    quota.meter(stream, str(tmp_path / "out"), str(tmp_path / "log"), window=window).awaitTermination()
    got = as_dict(spark.read.parquet(str(tmp_path / "out" / "decisions")))
    assert len({r.batch for r in spark.read.parquet(str(tmp_path / "out" / "decisions")).collect()}) == 3
    assert got == walk(rows[:90], window)


def test_key_list_and_rules(spark):
    df = spark.createDataFrame([("a:10, b,c:x,,d:7:9",)], "keys string")
    limits = U.parse_key_list(df, "keys")
    assert {(r.api_key, r.quota_limit) for r in limits.collect()} == {("a", 10), ("b", 1000), ("d", 7)}
    req = spark.createDataFrame([(0, None), (1, ""), (2, " a "), (3, "zz")], "i int, api_key string")
    free = {r.i: (r.key_status, r.quota_limit) for r in U.resolve_limits(req, limits, False).collect()}
    assert free == {0: ("anonymous", 100000), 1: ("invalid", None), 2: ("metered", 10),
                    3: ("metered", 10000)}
    need = {r.i: r.key_status for r in U.resolve_limits(req, limits, True).collect()}
    assert need == {0: "invalid", 1: "invalid", 2: "metered", 3: "invalid"}


def test_cache_counters(spark):
    log = spark.createDataFrame([("n", o) for o in ("miss", "write", "l1", "l2")] + [("m", "write")],
                                "node string, outcome string")
    got = {r.node: r for r in U.cache_counters(log).collect()}
    assert (got["n"].l1_hits, got["n"].l2_hits, got["n"].misses, got["n"].writes) == (1, 1, 1, 1)
    assert got["n"].hit_ratio_percent == 66.67 and got["m"].hit_ratio_percent == 100.0


def test_percentiles(spark):
    rng = random.Random(13)
    values = [round(rng.uniform(0, 30), 1) for _ in range(997)]
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    got = U.percentiles(df, ["k"], "v", {"p50": 0.5, "p90": 0.9, "p999": 0.999}).collect()[0]
    s = sorted(values)

    def linear(p):
        at = (len(s) - 1) * p
        lo = int(at)
        return s[lo] if lo == at else s[lo] * (lo + 1 - at) + s[lo + 1] * (at - lo)

    assert abs(got.p50 - statistics.median(values)) < 1e-9
    assert abs(got.p90 - linear(0.9)) < 1e-9 and abs(got.p999 - linear(0.999)) < 1e-9
    ix = U.percentiles(df, ["k"], "v", {"p95": 0.95}, method="index").collect()[0]
    assert ix.p95 == s[int(len(s) * 0.95)]


def test_chunked_running_equals_plain_walk(spark):
    rng = random.Random(14)
    rows = [(k, i, rng.choice([None, rng.randrange(9)])) for k in "ab" for i in rng.sample(range(500), 90)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = skew.chunked_running(df, ["k"], ["i"], F.floor(F.col("i") / 37), sums={"s": F.col("v")},
                               lags={"prev": F.col("v")}, lasts={"last": F.col("v")})
    by = {(r.k, r.i): (r.s, r.prev, r.last) for r in got.collect()}
    for k in "ab":
        s, prev, last = 0, None, None
        for _, i, v in sorted(r for r in rows if r[0] == k):
            s += v or 0
            last = v if v is not None else last
            assert by[(k, i)] == (s, prev, last)
            prev = v


def test_process_cpu(spark):
    rows = [(1, 0, 100, 50), (1, 2, 250, 100), (1, 90000, 250, 300), (2, 0, 5, 5)]
    df = spark.createDataFrame(
        [(p, (T0 + timedelta(seconds=s)).replace(tzinfo=timezone.utc), u, t, 1.5, float(s))
         for p, s, u, t in rows],
        "pid int, ts timestamp, utime bigint, stime bigint, rss_mb double, hwm_mb double")
    got = {(r.pid, r.ts.second, r.utime + r.stime): r.cpu_percent for r in U.process_cpu(df).collect()}
    assert got[(1, 0, 150)] == 0.0 and got[(1, 2, 350)] == 100.0 and got[(2, 0, 10)] == 0.0
    total = U.interval_totals(U.process_cpu(df)).orderBy("ts").collect()[0]
    assert total.active_nodes == 2 and total.total_rss_mb == 3.0


def test_repeated_requests_count_once(spark, tmp_path):
    from quire.queries.usage import quota_daily

    rows = [(no, T0 + timedelta(seconds=no), user, "view", 1.0) for no in range(60) for user in (1, 2, 3)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double") \
        .write.parquet(str(tmp_path / "events.parquet"))
    got = sorted((r.event_id, r.used, r.accepted) for r in quota_daily(spark, str(tmp_path)).collect())
    assert got == [(no, no + 1, no < 50) for no in range(60)]

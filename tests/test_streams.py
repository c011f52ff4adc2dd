import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from quire.operators import catalog, search, textlayer
from quire.plans.increments import Increments
from quire.streaming import events as S

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def stream_of(spark, df, folder, parts):
    """A stream that delivers a table in so many files, in order."""
    n = df.count()
    for no in range(parts):
        lo, hi = no * n // parts, (no + 1) * n // parts
        df.where((F.col("i") >= lo) & (F.col("i") < hi)).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_expiry_stream_equals_walk(spark, tmp_path):
    rng = random.Random(31)
    rows = sorted((rng.uniform(0, 20000), rng.choice("abc")) for _ in range(80))
    rows.append((10 ** 6, "z"))  # closes every session before it
    rows.append((10 ** 6 + 5000, "y"))
    df = spark.createDataFrame([(i, d, at(s)) for i, (s, d) in enumerate(rows)],
                               "i int, doc_id string, ts timestamp")
    stream = stream_of(spark, df, str(tmp_path / "in"), 4)
    q = S.expiries(stream, ttl=900).writeStream.format("memory").queryName("expired") \
        .outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.doc_id, r.last_change, r.expired_at) for r in spark.table("expired").collect())
    want = []
    for doc in "abc":
        times = [s for s, d in rows if d == doc]
        for i, s in enumerate(times):
            if i + 1 == len(times) or times[i + 1] - s >= 901:
                want.append((doc, at(s), at(s + 901)))
    naive = lambda t: t.replace(tzinfo=None)
    assert [(d, naive(a), naive(b)) for d, a, b in got if d in "abc"] == sorted(
        (d, naive(a), naive(b)) for d, a, b in want)


def test_annotation_updates_keep_the_latest(spark, tmp_path):
    rows = [(0, "a", at(0), 3), (1, "a", at(50), 7), (2, "b", at(10), 1), (3, "a", at(40), 9)]
    df = spark.createDataFrame(rows, "i int, doc_id string, batch_ts timestamp, annotation_count bigint")
    stream = stream_of(spark, df, str(tmp_path / "in"), 4)
    path = str(tmp_path / "out")
    S.publish_updates(stream, path, str(tmp_path / "log")).awaitTermination()
    assert Increments(spark, path).manifest()["batch"] == 3
    assert sorted((r.type, r.doc_id, r["count"]) for r in S.latest_updates(spark, path).collect()) == [
        ("annotations_updated", "a", 7), ("annotations_updated", "b", 1)]


def test_telemetry_windows_drop_late_samples(spark, tmp_path):
    # the watermark of one batch decides on lateness in the next
    rows = [(0, at(5), 10.0), (1, at(50), 30.0), (2, at(400), 1.0), (3, at(410), 3.0),
            (4, at(20), 99.0), (5, at(900), 1.0)]
    df = spark.createDataFrame([(i, t, c, 1.0, 2.0) for i, t, c in rows],
                               "i int, ts timestamp, total_cpu_percent double, total_rss_mb double, "
                               "max_hwm_mb double")
    stream = stream_of(spark, df, str(tmp_path / "in"), 6)
    q = S.telemetry_windows(stream).writeStream.format("memory").queryName("load") \
        .outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.samples, r.mean_cpu, r.peak_cpu) for r in spark.table("load").orderBy("start").collect()]
    assert got == [(2, 20.0, 30.0), (2, 2.0, 3.0)]


def test_percentiles_keep_their_bound(spark, tmp_path):
    rng = random.Random(3)
    values = [round(rng.expovariate(1 / 40), 1) for _ in range(6000)]
    df = spark.createDataFrame([(i, at(i / 100), v) for i, v in enumerate(values)],
                               "i int, ts timestamp, latency double")
    stream = stream_of(spark, df, str(tmp_path / "in"), 5)
    q = S.latency_windows(stream, "latency", (), "20 seconds", "1 second", accuracy=100) \
        .writeStream.format("memory").queryName("latency").outputMode("append") \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("latency").orderBy("start").collect()
    assert len(rows) == 2
    for k, r in enumerate(rows):
        own = sorted(values[2000 * k:2000 * (k + 1)])
        assert r.n == 2000
        for name, p in S.SCENARIO_PROBS.items():
            low, high = (sum(v < r[name] for v in own), sum(v <= r[name] for v in own))
            assert low - 20 <= p * 2000 <= high + 20


def test_search(spark):
    df = spark.createDataFrame([(1, "Alpha beta\nALPHABET soup"), (2, "gamma")], "doc_id int, text string")
    found = search.search_text(df, " alpha ")
    assert sorted(r.text for r in found.collect()) == ["ALPHABET", "Alpha"]
    assert search.search_text(df, "  ").count() == 0 and search.search_text(df, "alpha beta").count() == 0
    spans = textlayer.spans(textlayer.lines(df))
    queries = spark.createDataFrame([(1, "ALPHA"), (2, "m"), (3, ""), (4, "et"), (5, "zzz"), (6, "a b")],
                                    "query_id int, query string")
    got = sorted((r.query_id, r.text) for r in search.search_many(spans, queries).collect())
    assert got == [(1, "ALPHABET"), (1, "Alpha"), (2, "gamma"), (4, "ALPHABET"), (4, "beta")]
    phrase = spark.createDataFrame([(1, "foo bar"), (2, "foobar")], "i int, text string")
    found_in = search.search_many(phrase, spark.createDataFrame([(9, "O b")], "query_id int, query string"))
    assert [(r.i, r.query_id) for r in found_in.collect()] == [(1, 9)]
    totals = search.count_many(spans, queries, ["doc_id"]).collect()
    assert sorted((r.query_id, r.doc_id, r.total_matches) for r in totals) == [
        (1, 1, 2), (2, 2, 1), (4, 1, 2)]
    nav = {r.text: (r.match_no, r.match_count, r.next_line_no, r.prev_line_no)
           for r in search.ordinals(found, ["doc_id"], ["line_no", "span_idx"]).collect()}
    assert nav == {"Alpha": (1, 2, 1, 1), "ALPHABET": (2, 2, 0, 0)}


def test_caps(spark):
    rows = [(1, "page", 0), (2, "page", 50000), (3, "sources", 51), (4, "query_bytes", 500),
            (5, "annotations", 10001), (6, "other", 10 ** 9)]
    df = spark.createDataFrame(rows, "request_id int, kind string, amount bigint")
    assert {r.request_id: r.reason for r in catalog.caps_violations(df).collect()} == {
        1: "page_below_1", 3: "sources_above_50", 5: "annotations_above_10000"}


def test_percentiles_of_repeated_values_keep_their_bound(spark, tmp_path):
    from quire.queries.streams import stream_percentiles

    e = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
    e = e.where(F.col("ts") < F.lit("2024-01-06").cast("timestamp_ntz"))
    e.join(spark.range(6), how="cross").withColumn("event_id", F.col("event_id") + 100_000 * F.col("id")) \
        .drop("id").write.parquet(str(tmp_path / "events.parquet"))
    rows = stream_percentiles(spark, str(tmp_path)).collect()
    assert len(rows) == 4 * 5 * len(S.SCENARIO_PROBS) and all(r.in_bound for r in rows)

import hashlib

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quire.llm import exact
from quire.llm.exact import CountingQuotientFilter


def counted(values, bits):
    keys, counts = np.unique(np.array(values, np.uint64), return_counts=True)
    return CountingQuotientFilter(keys, counts.astype(np.uint64), bits)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2 ** 12 - 1), max_size=60), min_size=1, max_size=4))
def test_filters_merge_without_loss(parts):
    blobs = [counted(p, 12).to_bytes() for p in parts]
    filters = [CountingQuotientFilter.from_bytes(b) for b in blobs]
    whole, want = CountingQuotientFilter.merged(filters), counted(sum(parts, []), 12)
    assert whole.keys.tolist() == want.keys.tolist()
    assert whole.counts.tolist() == want.counts.tolist()
    again = CountingQuotientFilter.from_bytes(whole.to_bytes())
    assert again.keys.tolist() == want.keys.tolist()


def test_filter_counts_are_exact(spark, monkeypatch):
    monkeypatch.setattr(exact, "PER_FILTER", 10)
    prints = spark.range(3000).repartition(5).select(F.xxhash64(F.col("id") % 1700).alias("p"))
    got = {r.print: r.n for r in exact.repeated_prints(prints).collect()}
    want = {r.p: r["count"] for r in prints.groupBy("p").count().filter("count > 1").collect()}
    assert got == want and len(want) == 1300


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        if len(groups[t or ""]) == 1:
            keep = i
        out.append((str(i), str(keep), len(groups[t or ""]), i == keep,
                    hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out)


def test_against_brute_force(odd_docs, sample):
    for docs in (odd_docs, sample[0]):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256)
                     for r in exact.exact_duplicates(docs).collect())
        assert got == brute(rows)


def test_kept_rows_keep_their_columns(odd_docs, no_docs):
    kept = exact.without_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    want = {(r.doc_id, r.text_sha256) for r in exact.exact_duplicates(odd_docs).collect() if r.kept}
    rows = [(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in kept.collect()]
    assert set(rows) == want and len(rows) == len({sha for _, sha in rows})
    assert {r.keep_id for r in kept.collect()} == {"own keep_id"}
    assert exact.exact_duplicates(no_docs).collect() == []
    assert exact.without_copies(no_docs).collect() == []


def test_large_group(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(
        F.col("id") % 3 > 0, F.lit("the same")).otherwise(F.col("id").cast("string")).alias("text"))
    rows = exact.exact_duplicates(docs)
    assert rows.filter("group_size > 1").groupBy("keep_id", "group_size").count().collect() == [
        (3998, 2666, 2666)]
    assert exact.without_copies(docs).count() == 1335


def test_one_row_of_equal_texts_stays(spark):
    rows = [(7, "same", "a"), (7, "same", "b"), (3, "same", "c"), (None, "same", "d"),
            (None, "nameless", "e"), (None, "nameless", "e"), (None, None, "f"), (None, "", "g"),
            (1, "alone", "h"), (1, "other", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id string")
    for part in (1, 4):
        kept = [tuple(r) for r in exact.without_copies(docs.repartition(part)).collect()]
        assert sorted(t or "" for _, t, _ in kept) == ["", "alone", "nameless", "other", "same"]
        assert set(kept) <= set(rows) and [i for i, t, _ in kept if t == "same"] == [7]

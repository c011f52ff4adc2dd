import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import lm


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def brute(rows):
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter()
    for i, t in rows:
        if not held[i]:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    return [(i, held[i], len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n,
             sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows]


def compare(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    want = sorted(brute(rows), key=key)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score)
                  for r in lm.language_scores(docs).collect()), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)


def test_base_against_brute_force(odd_docs, sample):
    compare(odd_docs)
    compare(sample[0])


def test_rare_words_are_joined_exactly(odd_docs, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 0.01)
    compare(odd_docs)


def test_model_beats_the_base(sample):
    rows = lm.language_scores(sample[0]).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def exact_filter(counts, order, cutoff=1, bits=8):
    """The filter of one order, built as the tasks do."""
    import pandas as pd

    keys = np.array(sorted(counts), np.uint64)
    values = np.array([counts[int(k)] for k in keys])
    shard = (keys >> np.uint64(64 - bits)).astype(int)
    frames = []
    for s in np.unique(shard):
        k, c = keys[shard == s], values[shard == s]
        half = len(k) // 2 or 1  # two tasks, both with the first keys
        parts = [(k, np.maximum(c - 1, 1)), (k[c > 1], np.ones((c > 1).sum(), int))]
        frames.append(lm._merged(pd.DataFrame({
            "order_no": order, "shard": s,
            "steps": [lm._planes(np.diff(x, prepend=np.uint64(0))) for x, _ in parts],
            "counts": [lm._planes(y) for _, y in parts]}), cutoff))
        assert half
    return pd.concat(frames)


def test_filter_returns_levels_by_repeated_probes():
    rng = np.random.default_rng(4)
    counts = {int(k): int(c) for k, c in zip(
        rng.integers(0, 2 ** 63, 5000, dtype=np.uint64) * np.uint64(2),
        rng.geometric(0.05, 5000))}
    shards = exact_filter(counts, 1)
    assert shards["n_keys"].sum() == len(counts)
    lengths = shards["filter"].map(len).to_numpy()
    sizes, starts = np.zeros(256, np.int64), np.zeros(256, np.int64)
    sizes[shards["shard"]], starts[shards["shard"]] = lengths * 8, np.cumsum(lengths) - lengths
    order = lm.FilterOrder(np.frombuffer(b"".join(shards["filter"]), np.uint8), starts, sizes, 56,
                           np.arange(lm._LEVELS + 1.0))
    keys = np.array(list(counts), np.uint64)
    found = order.counts(keys)
    levels = lm.levels_of(np.array(list(counts.values())), 1)
    assert (found >= levels).all()  # a Bloom filter forgets nothing
    assert (found == levels).mean() > 0.97
    strange = rng.integers(0, 2 ** 63, 20000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert (order.counts(strange) > 0).mean() < 0.03


def test_size_bound_of_the_filter():
    for cutoff in (1, 3, 10):
        counts = np.arange(cutoff, 100_000)
        assert (lm.levels_of(counts, cutoff) <= 1.4 * counts / cutoff).all()


def test_probabilities_are_at_most_one(sample):
    assert all(r.score <= 0 for r in lm.language_scores(sample[0]).collect())


def test_odd_rows(odd_docs, no_docs):
    out = lm.language_scores(odd_docs).collect()
    ends = [r for r in out if r.doc_id in (4, 5, 6)]
    assert [r.n_tokens for r in ends] == [1, 1, 1] and len({r.score for r in ends}) == 1
    assert lm.language_scores(no_docs).collect() == []
    only = odd_docs.filter("pmod(crc32(cast(cast(doc_id as string) as binary)), 7) = 2")
    rows = lm.language_scores(only).collect()
    assert rows and {(r.n_known, r.train_tokens, r.score) for r in rows} == {(0, 0, 0.0)}


def test_large_corpora_keep_their_rare_pairs(spark):
    """Among 36 million tokens a pair that occurs once is still told from one that does not occur."""
    from pyspark.sql import functions as F

    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2]
    many = spark.createDataFrame([(i,) for i in ids[:36]], "doc_id long").repartition(4).withColumn(
        "text", F.repeat(F.lit("a "), 1_000_000))
    held = next(i for i in range(100) if i not in ids)
    few = spark.createDataFrame([(ids[36], "foo bar"), (held, "zig zag")], many.schema)
    got = {r.doc_id: r.score for r in lm.language_scores(many.unionAll(few)).collect()}
    assert got[ids[36]] > got[held] + 1

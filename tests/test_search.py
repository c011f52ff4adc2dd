import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.operators import search
from quire.plans.durable import settled


def test_pieces_of_long_texts_are_not_written(spark, monkeypatch):
    """What is written on the way grows with the texts, not with their length squared."""
    written = []

    def kept(df, folder=None):
        size = F.sum(sum(F.length(F.col(c).cast("string")) for c in df.columns))
        written.append(df.agg(size).first()[0] or 0)
        return settled(df, folder)

    monkeypatch.setattr(search, "settled", kept)
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"]
    texts = [" ".join(words[k::5]) for k in range(5)]
    queries = [(k, w) for k, w in enumerate(words)] + [(9999, f"{words[5]} {words[10]}")]
    found = search.matched_texts(spark.createDataFrame([(t,) for t in texts], "word string"),
                                 spark.createDataFrame(queries, "query_id bigint, query string"))
    assert sorted(map(tuple, found.collect())) == sorted(
        (t, k) for t in texts for k, q in queries if q in t)
    assert sum(written) < 30 * sum(map(len, texts))


def test_only_pieces_of_queries_leave_a_text(spark, monkeypatch):
    """A text gives no row for a piece that no query has, wherever its places are cut."""
    texts = ["abcabcabd xyz", "", "zß日本 abc", None, "ab", "日"]
    plain = [sorted({(1 << 8 * n) | int.from_bytes(t[k:k + n], "big") for n in (1, 3)
                     for k in range(len(t) - n + 1)}) for t in ((x or "").encode() for x in texts)]
    needed = np.array(sorted({*plain[2]} - {plain[2][0]} | {7}), np.uint64)
    for places in (1, 4, 1 << 20):
        monkeypatch.setattr(search, "_PLACES", places)
        column = pa.array(["left out", *texts], pa.string())[1:]
        assert search._grams(column, [1, 3]).to_pylist() == plain
        assert search._grams(column, [1, 3], needed).to_pylist() == [
            [p for p in of if p in needed] for of in plain]
    rows = spark.createDataFrame([(f"{k} line of words {k % 7} and more",) for k in range(500)], "word string")
    queries = spark.createDataFrame([(1, " 7 LINE "), (2, "é"), (3, "4"), (4, "ne of w"), (5, " "), (6, None)],
                                    "query_id bigint, query string")
    found = sorted(map(tuple, search.matched_texts(rows, queries).collect()))
    words = [r.word for r in rows.collect()]
    assert found == sorted((w, i) for w in words for i, q in ((1, "7 line"), (3, "4"), (4, "ne of w")) if q in w)

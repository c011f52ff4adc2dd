import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import ngram_join, overlap


def shingles(text):
    found = (text or "").encode().lower().split()
    return {b" ".join(found[k:k + 4]) for k in range(max(1, len(found) - 3))} if found else set()


def plain(rows):
    """(doc_id, n, smallest id reachable) by all pairs."""
    ids, sets = [i for i, _ in rows], [shingles(t) for _, t in rows]
    top = list(range(len(ids)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 85 * max(len(x), len(y)) and (
                    100 * len(x & y) >= 85 * len(x | y)):
                top[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(zip(ids, sets)))


def changed(words, n, rng):
    words = list(words)
    for k in rng.sample(range(len(words)), min(n, len(words))):
        words[k] = f"new{rng.randrange(10 ** 6)}"
    return words


def families(seed, n, passage=()):
    """Texts, copies with changes, copies of copies; some hold a common passage."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        size = rng.choice([1, 2, 4, 8, 9, 12, 20, 40, 70, 130, 300])
        words = [f"w{rng.randrange(3000)}" for _ in range(size)]
        if rng.random() < 0.4:
            words += passage
        family = [words]
        for _ in range(rng.randint(0, 6)):
            family.append(changed(rng.choice(family), rng.randint(0, 1 + len(words) // 60), rng))
        texts += family
    rng.shuffle(texts)
    return [(k, " ".join(w)) for k, w in enumerate(texts)]


def found(rows):
    return sorted(map(tuple, rows.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = families(seed, 60, tuple(f"p{k}" for k in range(60)))
    want = plain(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(ngram_join.joined_documents(docs)) == want
    assert len({c for _, _, c in want}) < len(rows) * 0.8


def test_documents_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert found(ngram_join.joined_documents(docs)) == plain([*map(tuple, docs.collect())])


def test_frequent_shingles_only_reorder(spark, monkeypatch):
    rows = families(3, 40, tuple(f"p{k}" for k in range(60)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "SAMPLE", 1)
    frequent = ngram_join.frequent_shingles(docs.select(F.col("text").cast("binary")))
    assert len(frequent) > 50
    assert found(ngram_join.joined_documents(docs)) == plain(rows)


def test_one_family_without_a_centre(spark):
    """Copies that are linked in a chain, and two dense groups that share most, but not enough."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    texts = [words]
    for _ in range(30):
        texts.append(changed(texts[-1], 7, rng))
    other = changed(words, 22, rng)
    texts += [changed(other, 2, rng) for _ in range(40)] + [changed(words, 9, rng) for _ in range(40)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(ngram_join.joined_documents(docs)) == plain(rows)


def test_similar_sets_share_a_name():
    rng = np.random.default_rng(2)
    for n in [6, 7, 8, 13, 14, 20, 63, 64, 75, 127, 128, 300, 511, 512, 600]:
        for _ in range(20):
            whole = rng.integers(0, 2 ** 63, n + 200, np.uint64) * np.uint64(2)
            a = whole[:n]
            d = ngram_join.differing(n)
            gone = int(rng.integers(0, d + 1))
            for b in (np.concatenate([a[gone:], whole[n:n + d - gone]]), a[d:],
                      np.concatenate([a, whole[n:n + d]])):
                x, y = np.unique(a), np.unique(b)
                common = len(np.intersect1d(x, y))
                if 100 * common < 85 * (len(x) + len(y) - common):
                    continue
                (p, good), (q, also) = (ngram_join.segment_names(
                    s, s % np.uint64(5) > 0, 0) for s in (x, y))
                assert good and also
                assert np.intersect1d(p, q).size
                bits = overlap.sketch(x) ^ overlap.sketch(y)
                assert np.bitwise_count(bits.view(np.uint64)).sum() <= len(x) + len(y) - 2 * common


def test_odd_rows(spark, odd_docs, no_docs):
    rows = ngram_join.joined_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    want = plain([(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id is not None])
    assert {k: v for k, v in of.items() if k is not None} == {i: {(n, c)} for i, n, c in want}
    n = len(shingles(odd_docs.filter("doc_id = 1").first().text))
    assert (n, 1) in of[None] and (0, None) in of[None] and len(of[None]) == 3
    assert ngram_join.joined_documents(no_docs).collect() == []

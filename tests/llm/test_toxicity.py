import random
import zlib

import numpy as np

from quire.llm import toxicity


def corpus(n, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    rows = []
    for i in range(n):
        toxic = i % 5 == 0
        text = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        if toxic:
            for _ in range(4):
                text[rng.randrange(len(text))] = rng.choice(["zorkin", "Vladix,", "QUUM", "yuppo"])
        rows.append((i, " ".join(text), ["en", "de", "xx"][i % 3], int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([(i, t, g) for i, t, g, _ in rows], "doc_id long, text string, "
                                                                       "lang string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(i, y) for i, _, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out for i, _ in held)
    assert sum(r.held_out for r in out.values()) == len(held)
    right = sum(out[i].predicted == y for i, y in held) / len(held)
    flagged = sum(out[i].flagged == bool(y) for i, y in held) / len(held)
    assert right > 0.97 and flagged > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    kept = {r.doc_id for r in toxicity.not_toxic(docs, labels).collect()}
    assert kept == {i for i, r in out.items() if not r.flagged}


def test_held_out_labels_are_not_used(spark):
    rows = corpus(400)
    docs = spark.createDataFrame([(i, t, g) for i, t, g, _ in rows],
                                 "doc_id long, text string, lang string")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, _, y in rows]
    a, b = (toxicity.toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int"))
            .orderBy("doc_id").collect() for x in ([(r[0], r[3]) for r in rows], turned))
    assert a == b


def test_pooling_over_blocks_is_that_of_the_whole(monkeypatch):
    net = toxicity.Network.fresh(1)
    texts = [toxicity.word_hashes(b"w%d " % k * 7 + b" x y z" * k) for k in range(12)]
    texts[3] = texts[3][:0]
    whole = net.pooled(texts)
    slow = np.zeros_like(whole)
    for i, h in enumerate(texts):
        x = np.concatenate([net.vectors(h), np.zeros((2, toxicity.DIM), np.float32)])
        if len(h):
            slow[i] = np.maximum(net.responses(x, len(h)).max(axis=0), 0)
    monkeypatch.setattr(toxicity, "_BLOCK", 5)
    assert np.allclose(whole, slow, atol=1e-5) and np.allclose(net.pooled(texts), slow, atol=1e-5)


def test_score_does_not_depend_on_other_columns(spark):
    net = toxicity.Network.fresh(1)
    net.limits = {"en": 0.0}
    docs = spark.createDataFrame([(1, "a b", "en"), (2, "a b", "de"), (2, "a b", None)],
                                 "doc_id long, text string, lang string")
    rows = toxicity.scored(docs, net).collect()
    assert len({r.score for r in rows}) == 1
    assert [r.flagged for r in rows] == [True, rows[0].score >= 0.5, rows[0].score >= 0.5]


def test_odd_rows(spark, odd_docs, no_docs):
    some = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1), (8, None), (99, 1), (9, 0)],
                                 "doc_id long, toxic int")
    out = toxicity.toxicity(odd_docs, some).collect()
    assert len(out) == odd_docs.count() and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (4, 5, 6)}) == 1
    none = some.limit(0)
    out = toxicity.toxicity(odd_docs, none).collect()
    assert {(r.score, r.predicted, r.flagged) for r in out} == {(0.0, 0, False)}
    assert toxicity.not_toxic(odd_docs, none).columns == odd_docs.columns
    assert toxicity.not_toxic(odd_docs, none).count() == odd_docs.count()
    assert toxicity.toxicity(no_docs, some).collect() == []
    assert toxicity.not_toxic(no_docs, some).collect() == []


def test_thresholds_cover_all_labelled_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 200)
    monkeypatch.setattr(toxicity, "TRAIN_WORDS", 100)
    # a fifteenth of the rows is in a language of its own, half of them toxic
    rows = [(i, t, "rare" if i % 30 < 2 else g, y) for i, t, g, y in corpus(1500)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int")
    net = toxicity.train(docs, labels)
    assert set(net.limits) == {"en", "de", "xx", "rare"}
    order = [r.doc_id for r in docs.orderBy(F.xxhash64("doc_id")).select("doc_id").collect()]
    sample = [i for i in order if zlib.crc32(str(i).encode()) % 5][:200]
    sample = [i for i in sample if len(rows[i][1].split()) <= 100]
    fitted = {i for k, i in enumerate(sample) if k % toxicity.CALIBRATE}
    score = {r.doc_id: r.score for r in toxicity.scored(docs, net).collect()}

    def f1(mine, limit):
        hit = sum(y for i, y in mine if score[i] >= limit)
        return 2 * hit / (sum(score[i] >= limit for i, _ in mine) + sum(y for _, y in mine))

    for lang in (None, *net.limits):
        mine = [(i, y) for i, _, g, y in rows if lang in (None, g) and i not in fitted
                and zlib.crc32(str(i).encode()) % 5]
        assert any(len(rows[i][1].split()) > 100 for i, _ in mine)
        best = max(f1(mine, score[i]) for i, _ in mine)
        assert f1(mine, net.limit if lang is None else net.limits[lang]) > best - 0.005

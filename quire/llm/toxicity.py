"""Toxicity by a convolutional network over hashed word embeddings, trained with numpy.

A word is the sum of four rows of one embedding table: two chosen by two halves of its hash, so
that other words rarely share both, and two by hashes of its first letters, which forms of a word
have in common. Filters over one, two and three words run along
the whole text; each keeps its largest value, and a logistic layer turns those into a score. The
score is calibrated on sampled rows kept apart from the fit; one threshold for each language is
chosen on all labelled rows that the fit did not see.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import bucket, small_side
from quire.plans.durable import settled

#: bounds of the sample that the model is fitted on: labelled rows, words of one of them
TRAIN_ROWS, TRAIN_WORDS = 8_000, 3_000
#: every so many-th sampled row calibrates instead of fitting
CALIBRATE = 4
#: toxic rows of a language that it takes for a threshold of its own
OWN_THRESHOLD = 8
#: bins of a logit's unit in which scores are counted for the thresholds
LOGIT_BINS = 256
HASH_BITS, DIM, WIDTHS, FILTERS = 18, 8, (1, 2, 3), 8
#: bytes of a word that count as its beginning
STEMS = (4, 6)
EPOCHS, BATCH, RATE, NEGATIVES = 14, 32, 0.04, 4
#: spread of fresh embeddings; what Adagrad's sums start from; share of words left out in a pass
SPREAD, START, LEFT_OUT = 0.02, 1e-4, 0.5
#: words whose filters are evaluated at a time, bytes of text whose words are held
_BLOCK, _BYTES = 100_000, 1_000_000
_MASK = (1 << HASH_BITS) - 1
#: letters A-Z become small, other ASCII but digits and letters parts words
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122
              else 32 for c in range(256))


def word_hashes(text: bytes) -> np.ndarray:
    """A row for each word: hash of the word, hashes of its first bytes."""
    words = text.translate(_FOLD).split()
    out = np.empty((len(words), 1 + len(STEMS)), np.uint32)
    out[:, 0] = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    for j, n in enumerate(STEMS):
        out[:, j + 1] = np.fromiter((zlib.crc32(w[:n]) for w in words), np.uint32, len(words))
    return out


def table_rows(hashes: np.ndarray) -> np.ndarray:
    """The rows of the embedding table for each word."""
    return np.concatenate([hashes & _MASK, hashes[:, :1] >> (32 - HASH_BITS)], axis=1).T


@dataclass
class Network:
    """Weights; ``scale`` and ``shift`` calibrate the logit, ``limits`` are by language."""

    table: np.ndarray
    filters: list[np.ndarray]  # one (width, DIM, FILTERS) array for each width
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    limit: float = 0.5
    limits: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        # the row after the table stands for the end of a text
        table = rng.normal(0, SPREAD, ((1 << HASH_BITS) + 1, DIM)).astype(np.float32)
        table[-1] = 0
        return cls(table, [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32)
                           for w in WIDTHS], np.zeros(n, np.float32),
                   rng.normal(0, 0.3, n).astype(np.float32), 0.0)

    def vectors(self, hashes: np.ndarray) -> np.ndarray:
        return sum(self.table[rows] for rows in table_rows(hashes))

    def responses(self, x: np.ndarray, n: int) -> np.ndarray:
        """Filter values at the first ``n`` rows of x, which has more rows behind them."""
        parts = [sum(x[k:k + n] @ f[k] for k in range(len(f))) for f in self.filters]
        return np.concatenate(parts, axis=1) + self.bias

    def pooled(self, texts: list[np.ndarray]) -> np.ndarray:
        """Largest value of each filter along each text; nothing is larger than zero in none."""
        most = np.zeros((len(texts), FILTERS * len(WIDTHS)), np.float32)
        reach = max(WIDTHS) - 1
        pad = np.zeros((reach, DIM), np.float32)
        rows: list[int] = []
        blocks: list[np.ndarray] = []

        def flush() -> None:
            x = np.concatenate(blocks)
            y = self.responses(np.concatenate([x, pad]), len(x))
            starts = np.cumsum([0, *map(len, blocks)])
            spans = np.stack([starts[:-1], starts[1:] - reach], axis=1).reshape(-1)
            best = np.maximum.reduceat(y, spans, axis=0)[::2]
            np.maximum.at(most, rows, best)
            rows.clear()
            blocks.clear()

        for i, hashes in enumerate(texts):
            for a in range(0, len(hashes), _BLOCK):
                # a block ends with the words that its last windows reach, or with padding
                part = self.vectors(hashes[a:a + _BLOCK + reach])
                short = min(_BLOCK, len(hashes) - a) + reach - len(part)
                blocks.append(np.concatenate([part, pad[:short]]) if short else part)
                rows.append(i)
                if sum(map(len, blocks)) > _BLOCK:
                    flush()
        if rows:
            flush()
        return most

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        z = self.pooled(texts) @ self.out + self.out_bias
        return self.scale * z.astype(np.float64) + self.shift

    def text_logits(self, texts: list[bytes]) -> np.ndarray:
        """Logits of whole texts; the words of about ``_BYTES`` of them are held at a time."""
        out, held, size = [np.zeros(0)], [], 0
        for k, text in enumerate(texts):
            held.append(word_hashes(text))
            size += len(text)
            if size >= _BYTES or k + 1 == len(texts):
                out.append(self.logits(held))
                held, size = [], 0
        return np.concatenate(out)

    def text_scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.text_logits(texts), -40, 40)))


def _step(net: Network, texts: list[np.ndarray], y: np.ndarray, sums: dict) -> None:
    """One Adagrad step; only the windows that won the pooling have a gradient."""
    reach = max(WIDTHS) - 1
    best = np.zeros((len(texts), FILTERS * len(WIDTHS)), np.int64)
    value = np.zeros(best.shape, np.float32)
    xs = []
    for i, hashes in enumerate(texts):
        x = np.concatenate([net.vectors(hashes), np.zeros((reach, DIM), np.float32)])
        xs.append(x)
        if len(hashes):
            r = net.responses(x, len(hashes))
            best[i] = r.argmax(axis=0)
            value[i] = r[best[i], np.arange(r.shape[1])]
    hot = np.maximum(value, 0)
    z = hot @ net.out + net.out_bias
    slope = ((1 / (1 + np.exp(-z)) - y) / len(texts)).astype(np.float32)

    def update(name: str, param: np.ndarray, grad: np.ndarray) -> None:
        s = sums.setdefault(name, np.full(param.shape, START, np.float32))
        s += grad * grad
        param -= RATE * grad / np.sqrt(s)

    inner = slope[:, None] * net.out * (value > 0)
    rows, grads = [], []
    for j, f in enumerate(net.filters):
        cols = slice(j * FILTERS, (j + 1) * FILTERS)
        g_f = np.zeros_like(f)
        for k in range(len(f)):
            at = best[:, cols] + k
            seen = np.stack([x[np.minimum(a, len(x) - 1)] for x, a in zip(xs, at)])
            g_f[k] = np.einsum("bf,bfd->df", inner[:, cols], seen)
            back = inner[:, cols, None] * f[k].T[None]
            for hashes, a, b in zip(texts, at, back):
                inside = a < len(hashes)
                rows += [*table_rows(hashes[a[inside]])]
                grads += [b[inside]] * (2 + len(STEMS))
        update(f"f{j}", f, g_f)
    update("bias", net.bias, inner.sum(axis=0))
    update("out", net.out, hot.T @ slope)
    net.out_bias -= RATE * float(slope.sum())
    if rows:
        index, place = np.unique(np.concatenate(rows), return_inverse=True)
        total = np.zeros((len(index), DIM), np.float32)
        np.add.at(total, place, np.concatenate(grads))
        s = sums.setdefault("table", np.full(net.table.shape, START, np.float32))
        s[index] += total * total
        net.table[index] -= RATE * total / np.sqrt(s[index])


def _best_limit(bins: pd.DataFrame) -> float:
    """Threshold with the largest F1, in the middle of the gap below the lowest accepted score.

    A row for each bin of logits: bin, n, hits, low and high (its least and largest score).
    """
    bins = bins.sort_values("bin", ascending=False)
    hit = bins["hits"].cumsum().to_numpy()
    f1 = 2 * hit / (bins["n"].cumsum().to_numpy() + hit[-1])
    k = int(np.argmax(f1))
    below = bins["high"].iloc[k + 1] if k + 1 < len(bins) else 0.0
    return float((bins["low"].iloc[k] + below) / 2)


def calibrating(n: int) -> np.ndarray:
    """Which of the sampled rows calibrate."""
    return np.arange(n) % CALIBRATE == 0


def fit(texts: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Network | None:
    """Network for labelled word hashes, without thresholds; None if a class is missing."""
    y = np.asarray(y, np.float32)
    held = calibrating(len(y))
    toxic, clean = np.flatnonzero(~held & (y > 0)), np.flatnonzero(~held & (y == 0))
    if not len(toxic) or not len(clean):
        return None
    net, rng, sums = Network.fresh(seed), np.random.default_rng(seed), {}
    for _ in range(EPOCHS):
        some = rng.choice(clean, min(len(clean), NEGATIVES * len(toxic)), replace=False)
        order = rng.permutation(np.concatenate([toxic, some]))
        for a in range(0, len(order), BATCH):
            rows = order[a:a + BATCH]
            _step(net, [texts[i][rng.random(len(texts[i])) >= LEFT_OUT] for i in rows], y[rows],
                  sums)
    rows = np.flatnonzero(held)
    if y[rows].min() == y[rows].max():
        return net
    z = net.logits([texts[i] for i in rows])
    t = np.where(y[rows] > 0, 1 - 0.5 / (y[rows].sum() + 1), 0.5 / ((y[rows] == 0).sum() + 1))
    w = np.array([1.0, 0.0])
    for _ in range(30):  # Newton steps for a slope and a shift, slightly held back
        p = 1 / (1 + np.exp(-np.clip(w[0] * z + w[1], -40, 40)))
        x = np.stack([z, np.ones_like(z)], axis=1)
        grad = x.T @ (p - t) + (w - [1, 0])
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), grad)
    if np.isfinite(w).all() and 0.1 < w[0] < 10:
        net.scale, net.shift = float(w[0]), float(w[1])
    return net


def set_limits(net: Network, rows: DataFrame) -> None:
    """Thresholds from all of the labelled rows (doc_id, lang, toxic, text), whole texts.

    Scores are counted in bins of 1 / LOGIT_BINS of the logit, so that a language has at most
    80 * LOGIT_BINS of them; its threshold is picked where its bins are. A repeated document counts
    once in a language.
    """
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            if b.num_rows:
                z = model.text_logits([x.as_py() or b"" for x in b.column(3)])
                yield pa.record_batch([*b.columns[:3], pa.array(np.clip(z, -40, 40))],
                                      names=["doc_id", "lang", "toxic", "z"])

    def best(bins: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": bins["lang"].iloc[:1], "best": [_best_limit(bins)]})

    score = 1 / (1 + F.exp(-F.col("z")))
    bins = settled(
        rows.mapInArrow(run, "doc_id long, lang string, toxic int, z double")
        .groupBy("doc_id", "lang").agg(F.max("toxic").alias("toxic"), F.min("z").alias("z"))
        .groupBy("lang", F.floor(F.col("z") * LOGIT_BINS).alias("bin")).agg(
            F.count("*").alias("n"), F.sum((F.col("toxic") > 0).cast("long")).alias("hits"),
            F.min(score).alias("low"), F.max(score).alias("high")))
    shared.unpersist()
    whole = bins.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"),
                                    F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
    if not len(whole) or not 0 < whole["hits"].sum() < whole["n"].sum():
        return
    net.limit = _best_limit(whole)
    enough = bins.groupBy(F.col("lang").alias("own")).agg(
        F.sum("n").alias("all"), F.sum("hits").alias("toxic")).filter(
        (F.col("toxic") >= OWN_THRESHOLD) & (F.col("toxic") < F.col("all")))
    net.limits = {r.lang: r.best for r in bins.join(enough, bins["lang"] == enough["own"], "left_semi")
                  .groupBy("lang").applyInPandas(best, "lang string, best double").collect()}


def train(docs: DataFrame, labels: DataFrame) -> Network | None:
    """Fit on a bounded sample: TRAIN_ROWS labelled rows outside the held-out fifth, by hash.

    Only labels that are set count; if a document has several, the toxic one does. Rows of more
    than TRAIN_WORDS words are not used for fitting. The sample is what a driver can hold at any
    size of the input: at most TRAIN_ROWS * TRAIN_WORDS words of 12 bytes. All labelled rows that
    the fit did not see, but for the held-out fifth, set the thresholds.
    """
    labelled = small_side(labels.filter("doc_id is not null and toxic is not null")
                          .filter(bucket(F.col("doc_id"), 5) != 0)
                          .groupBy(F.col("doc_id").cast("long").alias("label_id"))
                          .agg(F.max("toxic").alias("toxic")))
    known = labelled.orderBy(F.xxhash64("label_id"), "label_id").limit(TRAIN_ROWS)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"),
                        F.coalesce("lang", F.lit("")).alias("lang"))
    sample = texts.join(F.broadcast(known), texts["doc_id"] == known["label_id"]).select(
        "doc_id", "lang", F.col("toxic").cast("int"), "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [word_hashes(x.as_py() or b"") for x in b.column(3)]
            fits = pa.array([len(f) <= TRAIN_WORDS for f in found], pa.bool_())
            yield pa.record_batch(
                [*b.columns[:3], pa.array([f.tobytes() for f in found], pa.binary())],
                names=["doc_id", "lang", "toxic", "words"]).filter(fits)

    rows = (sample.mapInArrow(hashed, "doc_id long, lang string, toxic int, words binary")
            .groupBy("doc_id").agg(F.min_by(F.struct("lang", "toxic", "words"), "words")
                                   .alias("r")).select("doc_id", "r.*")
            .orderBy(F.xxhash64("doc_id")).toPandas())
    if not len(rows):
        return None
    net = fit([np.frombuffer(w, np.uint32).reshape(-1, 1 + len(STEMS)) for w in rows["words"]],
              (rows["toxic"] > 0).to_numpy())
    if net is None:
        return None
    seen = docs.sparkSession.createDataFrame(
        rows.loc[~calibrating(len(rows)), ["doc_id"]].rename(columns={"doc_id": "seen_id"}),
        "seen_id long")
    others = labelled.join(F.broadcast(seen), labelled["label_id"] == seen["seen_id"], "left_anti")
    others = small_side(others)
    set_limits(net, texts.join(others, texts["doc_id"] == others["label_id"]).select(
        F.col("doc_id").cast("long"), "lang", F.col("toxic").cast("int"), "text"))
    return net


def scored(docs: DataFrame, net: Network | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, threshold, flagged."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts = [x.as_py() or b"" for x in b.column(3)]
            s = model.text_scores(texts) if model else np.zeros(len(texts))
            limit = np.array([model.limits.get(x, model.limit) if model else 0.5
                              for x in b.column(2).to_pylist()], np.float64)
            yield pa.record_batch(
                [b.column(0), b.column(1), pa.array(s, pa.float64()),
                 pa.array((s >= 0.5).astype(np.int32)), pa.array(limit, pa.float64()),
                 pa.array(s >= limit, pa.bool_())],
                names=["doc_id", "held_out", "score", "predicted", "threshold", "flagged"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (bucket(F.col("doc_id"), 5) == 0).alias("held_out"),
                       F.coalesce(F.col("lang"), F.lit("")),
                       F.col("text").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, "
                                "threshold double, flagged boolean")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of every whole text.

    score and predicted never see labels, lang, source or doc_id; ``flagged`` compares the score
    with the threshold of the row's language (the common one where lang is null or rare). Null
    and empty texts get the score of a text without words. Repeated rows get equal scores, rows
    without doc_id are scored too. Without labels of both classes every score is 0. No rows give
    no rows; other columns, whatever their names, are not read.
    """
    return scored(docs, train(docs, labels))


def not_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text stays below the threshold of their language.

    Null and empty texts get the score of a text without words; a null or rare language has the
    common threshold. Rows without doc_id and repeated rows are judged each. Without labels of both
    classes all rows stay. All columns of ``docs`` are kept, whatever their names; no rows give none.
    """
    net = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("boolean")
    def toxic(text, lang):
        model = shared.value
        if model is None or not len(text):
            return pd.Series([False] * len(text))
        s = model.text_scores([x or b"" for x in text])
        return pd.Series([bool(v >= model.limits.get(g or "", model.limit))
                          for v, g in zip(s, lang)])

    return docs.filter(~toxic(F.col("text").cast("binary"), F.col("lang")))

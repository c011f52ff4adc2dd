"""Periodic runs of words, found by string synchronising sets.

A run is a maximal stretch of words with smallest period q that is at least ``LEAST`` words and
``TIMES`` periods long. Periods below ``SMALL`` are looked for directly: they make the highly
periodic regions. A period of t to 2t - 1 words, t = 8, 16, 32 ..., is proposed by positions that
a hash selects: i is taken if the least hash of the t words at any of i .. i + t is that at i or
i + t, where places inside a region of a period of at most t / 4 have no hash. The choice depends
on the 2t words at i alone, so equal contexts are chosen alike, and of any 2t starts outside such
regions one of the first t is taken (Kempa and Kociumaka, 2019). Inside a run of period q the next
place with the same 2t words is q words on: neighbouring equal contexts give all periods. Every
proposal is extended to both sides over the words themselves.

Documents of a slice are laid one after the other, each closed by a number of its own, which no
run can cross; all steps but the extension are numpy operations over the slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import text_slices

#: least words of a run, and least number of its periods
LEAST, TIMES = 6, 4
#: periods below are compared directly
SMALL = 8
_NONE = np.iinfo(np.uint64).max
_MIX = np.random.default_rng(12).integers(1, 2 ** 63, 4, np.uint64) * np.uint64(2) + np.uint64(1)

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def _doubled(names: np.ndarray, width: int) -> np.ndarray:
    """Names of stretches of 2 * width words from the names of those of ``width``."""
    return _mixed(names[:-width] * _MIX[2] + names[width:] * _MIX[3])


def least_ahead(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbouring values."""
    n = len(values) - width + 1
    blocks = np.full((-(-len(values) // width), width), _NONE)
    blocks.reshape(-1)[:len(values)] = values
    upto = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[:n], upto[width - 1:width - 1 + n])


def synchronising(names: np.ndarray, width: int) -> np.ndarray:
    """Chosen positions, given a name for each ``width`` words; ``_NONE`` is never chosen."""
    if len(names) <= width:
        return np.zeros(0, np.int64)
    least = least_ahead(names, width + 1)
    n = len(least)
    return np.flatnonzero((least != _NONE) & ((least == names[:n]) | (
        least == names[width:width + n])))


def _until(words: np.ndarray, at: int, period: int) -> int:
    """First place from ``at`` on that differs from the one a period later."""
    step, stop = 4 * period, len(words) - period
    while at < stop:
        n = min(step, stop - at)
        other = np.flatnonzero(words[at:at + n] != words[at + period:at + period + n])
        if len(other):
            return at + int(other[0])
        at, step = at + n, 2 * step
    return stop


def _since(words: np.ndarray, at: int, period: int) -> int:
    """First place of the stretch around ``at`` that equals the one a period later."""
    step = 4 * period
    while at:
        n = min(step, at)
        other = np.flatnonzero(words[at - n:at] != words[at - n + period:at + period])
        if len(other):
            return at - n + int(other[-1]) + 1
        at, step = at - n, 2 * step
    return 0


def _direct(words: np.ndarray, longest: int) -> dict[tuple[int, int], int]:
    """(start, end) -> period of the runs of periods below SMALL."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, min(SMALL, longest // TIMES + 1)):
        edges = np.flatnonzero(np.diff(words[:-q] == words[q:], prepend=False, append=False))
        a, b = edges[::2], edges[1::2] + q
        long = b - a >= max(LEAST, TIMES * q)
        for run in zip(a[long].tolist(), b[long].tolist()):
            found.setdefault(run, q)  # a multiple of a period has the same run
    return found


def runs(words: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs, in no order. ``longest``: words of a document at most."""
    found = _direct(words, longest)
    width = SMALL
    if longest < TIMES * width:
        return [(s, e, q) for (s, e), q in found.items()]
    names = _mixed(words.astype(np.uint64) * _MIX[2] + _MIX[3])
    for k in range(width.bit_length() - 1):
        names = _doubled(names, 1 << k)
    while longest >= TIMES * width:
        contexts = _doubled(names, width)
        allowed = names.copy()
        for (s, e), q in found.items():
            if TIMES * q <= width <= e - s:
                allowed[s:e - width + 1] = _NONE
        at = synchronising(allowed, width)
        of = contexts[at]
        order = np.argsort(of, kind="stable")
        at, of = at[order], of[order]
        gap = np.diff(at)
        near = (of[1:] == of[:-1]) & (gap >= width) & (gap < 2 * width)
        at, gap = at[:-1][near], gap[near]
        order = np.lexsort((at, gap))
        period = end = 0
        for i, q in zip(at[order].tolist(), gap[order].tolist()):
            if q == period and i < end - q:  # in the stretch of the proposal before
                continue
            period, end = q, _until(words, i, q) + q
            start = _since(words, i, q)
            if end - start >= max(LEAST, TIMES * q):
                found.setdefault((start, end), q)
        names, width = contexts, 2 * width
    return [(s, e, q) for (s, e), q in found.items()]


def document_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words, by start and period."""
    number = {w: k for k, w in enumerate({w for t in texts for w in t})}
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    laid = np.empty(int(sizes.sum()) + len(texts), np.int64)
    for k, (a, t) in enumerate(zip(begin.tolist(), texts)):
        laid[a:a + len(t)] = [number[w] for w in t]
        laid[a + len(t)] = -1 - k
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = sorted(runs(laid, int(sizes.max(initial=0))), key=lambda r: (r[0], r[2]))
    owners = np.searchsorted(begin, [s for s, _, _ in found], side="right") - 1
    for k, (s, e, q) in zip(owners.tolist(), found):
        out[k].append((s - int(begin[k]), e - s, q))
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not found:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in found:
        kept[start + period:start + length] = False
    return b" ".join([words[k] for k in np.flatnonzero(kept).tolist()])


def _rows(keys: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
    words = [t.split() for t in texts]
    found = document_runs(words)
    flat = np.array([r for d in found for r in d], np.int64).reshape(-1, 3)
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    parts = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)],
                                       names=["start", "length", "period"])
    return pa.record_batch(
        [keys, pa.array([len(w) for w in words], pa.int64()),
         pa.ListArray.from_arrays(pa.array(ends), parts),
         pa.array(map(collapsed, words, found), pa.binary())],
        names=["doc_id", "n_words", "runs", "collapsed"])


def _periodic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in text_slices(batch.column(1)):
            yield _rows(batch.column(0).slice(a, b - a),
                        [x.as_py() or b"" for x in batch.column(1).slice(a, b - a)])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (start, length, period), collapsed.

    Runs are ordered by start and period; ``collapsed`` is the text (binary) without the words
    that a run repeats. Null, empty and blank texts have no words and no runs. Repeated rows get
    equal results, rows without doc_id are worked on too. No rows give no rows; other columns,
    whatever their names, are not read.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        _periodic, f"doc_id long, n_words long, runs {RUNS}, collapsed binary")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one text in ten, by crc32(doc_id), repeats a stretch to its end.

    With g the hash's tenth, words from number g % n on become copies of the next 1 + (the words
    left) / (3 + g % 8) ones. Rows without doc_id and texts without words stay as they are.
    """
    hashed = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.when(hashed % 10 == 0, F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.floor(hashed / 10).alias("g"), words.alias("words"))
    n = F.size("words")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    left = n - F.col("a")
    period = F.floor(left / (3 + F.col("g") % 8) + 1).cast("int")
    rows = rows.withColumn("period", period)
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("period")),
                                     F.ceil(left / F.col("period")).cast("int")))
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")),
                                    F.slice(again, F.lit(1), left)), " ")
    return rows.select("doc_id", F.when(n > 0, changed).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_runs, the longest run (start, length, period,
    exponent_milli; null without a run), runs_sha256 and collapsed_sha256.

    Of equally long runs the one that starts first counts, then the smaller period.
    """
    found = periodic_runs(docs)
    best = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start as start, "
                  "-r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, "
                   "'\\n')), '')")
    rows = found.select("doc_id", "runs", "collapsed", best.alias("best"), lines.alias("lines"))
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))

"""Similarity join of word shingle sets by vertical partitioning.

All shingles have one global order: those that are frequent in a sample of the texts come last,
the others by their hash. The order is cut into fragments, the same for all sets of a class of
sizes, so that every set falls into segments. Two sets of Jaccard similarity 0.85 or more differ
in at most d = 15/85 of the smaller one's shingles; each set names its first d + 1 segments that
are not empty. At most d of these can hold a difference, so two similar sets share a name, always.
Any order is a valid one: the sample only keeps common passages out of the names. Sets that share
a name are compared as ``quire.llm.overlap`` says: partial overlaps by fragment, summed per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import text_slices
from quire.llm.overlap import Rule, classes_of, components_of, named_sets
from quire.plans.durable import settled

#: words of a shingle, least similarity of a link in hundredths
RULE = Rule(4, 85)
#: one text of so many is in the sample; shingles found FREQUENT times there come last, of them
#: the MOST most frequent ones (8 bytes each are sent to the workers)
SAMPLE, FREQUENT, MOST = 64, 3, 1 << 20
#: sets below this size name single shingles, nearly
_SMALL_LEVEL, _FINE = 6, 1024
_MIX = np.random.default_rng(13).integers(1, 2 ** 63, 4, np.uint64) * np.uint64(2) + np.uint64(1)


def differing(n: int) -> int:
    """Most shingles in which a set of n and a larger or equal one can differ and still link."""
    return (100 - RULE.share) * n // RULE.share


def _fragments(level: int) -> int:
    """Number of fragments for sets of 2**level to 2**(level + 1) - 1 shingles."""
    return _FINE if level < _SMALL_LEVEL else 2 * (differing((2 << level) - 1) + 1)


def segment_names(found: np.ndarray, rare: np.ndarray, seed: int) -> tuple[np.ndarray, bool]:
    """Names of the first segments of a set, and whether there were enough of them."""
    n = len(found)
    if not differing(n):  # only an equal set can link
        return np.zeros(0, np.int64), True
    level = n.bit_length() - 1
    most = [(level, differing(n))]
    if 100 * ((1 << level) - 1) >= RULE.share * n:  # a partner may be of the level below
        most.append((level - 1, differing((1 << level) - 1)))
    names, enough = [], True
    high = found * (_MIX[:1] * np.uint64(2 * seed + 1)) if seed else found
    for at, d in most:
        f = _fragments(at)
        place = ((high >> np.uint64(32)) * np.uint64(f)) >> np.uint64(32)
        place = np.where(rare, place, place + np.uint64(f))
        order = np.argsort(place, kind="stable")
        place = place[order]
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        sums = np.add.reduceat(found[order], starts)[:d + 1]
        where = place[starts[:d + 1]]
        x = (sums ^ (where * _MIX[1] + np.array([at], np.uint64) * _MIX[2])) * _MIX[3]
        names.append((x ^ (x >> np.uint64(31))) * _MIX[0])
        enough &= len(starts) > d
    return np.concatenate(names).view(np.int64), enough


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of texts (one column)."""
    for batch in batches:
        for a, b in text_slices(batch.column(0)):
            found = [RULE.shingles(x.as_py() or b"") for x in batch.column(0).slice(a, b - a)]
            yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64))], names=["hash"])


def frequent_shingles(texts: DataFrame) -> np.ndarray:
    """Hashes of the shingles that come last in the order, ascending; at most ``MOST``.

    Different texts are sampled by their hash.
    """
    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    found = (some.mapInArrow(_own, "hash long").groupBy("hash").count()
             .filter(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "hash").limit(MOST))
    return np.sort(found.select("hash").toPandas()["hash"].to_numpy(np.int64).view(np.uint64))


def joined_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    component_id is the smallest doc_id reachable over links of at least 0.85 of the shingles. Null
    texts and texts without words have no shingles and link nothing. Rows without doc_id link
    nothing; they get the component of an equal set that has an id, else null. Repeated rows share
    their component. No rows give no rows; other columns, whatever their names, are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(texts))

    def names_by(seed: int):
        def names(found: np.ndarray) -> tuple[np.ndarray, bool]:
            last = shared.value
            rare = np.ones(len(found), bool)
            if len(last):
                rare = last[np.minimum(np.searchsorted(last, found), len(last) - 1)] != found
            return segment_names(found, rare, seed)

        return names

    for seed in count():  # a set with too few segments asks for other fragments
        rows = settled(named_sets(texts, RULE, names_by(seed)))
        if rows.filter(~F.col("enough")).isEmpty():
            break
    rows = components_of(rows, texts, classes_of(rows.filter("n > 0")), RULE)
    return rows.select("doc_id", F.col("n").alias("n_shingles"),
                       F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
                       .alias("component_id"))

"""Exact duplicates: counting quotient filters find what occurs twice, bytes decide.

1. Every partition counts the 64-bit fingerprints of its texts in counting quotient filters,
   one for each range of fingerprints.
2. The filters of a range are merged by their sorted remainders; no fingerprint and no count is
   lost, since quotient and remainder together are the whole fingerprint.
3. Fingerprints counted more than once route their rows to the comparison of the bytes
   themselves; all other rows are unique, as equal texts have equal fingerprints.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.common import small_side, whole_text
from quire.plans.durable import settled

#: fingerprints that a task holds before it writes its filters
FLUSH = 2_000_000
#: fingerprints of one merged filter, on average
PER_FILTER = 32_768
_HEAD = struct.Struct("<BBQQ")


class CountingQuotientFilter:
    """Sorted distinct keys of ``bits`` bits with counts, kept as quotients and remainders.

    ``occupied`` marks the quotients that have a run, ``run_end`` the last slot of each run, a
    slot holds a remainder, and ``counted`` marks slots with a count above one. Empty slots are
    not stored, so that a filter can be sent, merged and read in the order of its keys.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bits: int):
        self.keys, self.counts, self.bits = keys, counts, bits

    def to_bytes(self) -> bytes:
        n = len(self.keys)
        q = min(self.bits, max(0, int(n).bit_length() - 1))
        r = self.bits - q
        quotients = (self.keys >> np.uint64(r)).astype(np.int64) if q else np.zeros(n, np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotients] = True
        run_end = np.ones(n, bool)
        run_end[:-1] = quotients[1:] != quotients[:-1]
        counted = self.counts > 1
        width = (r + 7) // 8
        rest = (self.keys & np.uint64((1 << r) - 1)).astype("<u8").view(np.uint8).reshape(n, 8)
        return b"".join([
            _HEAD.pack(self.bits, q, n, int(counted.sum())), np.packbits(occupied).tobytes(),
            np.packbits(run_end).tobytes(), np.packbits(counted).tobytes(),
            rest[:, :width].tobytes(), self.counts[counted].astype("<u8").tobytes(),
        ])

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        bits, q, n, more = _HEAD.unpack_from(data)
        r, at = bits - q, _HEAD.size
        width = (r + 7) // 8

        def flags(count: int) -> np.ndarray:
            nonlocal at
            raw = np.frombuffer(data, np.uint8, (count + 7) // 8, at)
            at += len(raw)
            return np.unpackbits(raw, count=count).astype(bool)

        occupied, run_end, counted = flags(1 << q), flags(n), flags(n)
        rest = np.zeros((n, 8), np.uint8)
        rest[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        runs = np.concatenate([[0], np.cumsum(run_end)[:-1]]).astype(np.int64) if n else []
        keys = rest.reshape(-1).view("<u8").astype(np.uint64)
        if q:
            keys = keys | (np.flatnonzero(occupied)[runs].astype(np.uint64) << np.uint64(r))
        counts = np.ones(n, np.uint64)
        counts[counted] = np.frombuffer(data, "<u8", more, at)
        return cls(keys, counts, bits)

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        keys = np.concatenate([f.keys for f in filters])
        counts = np.concatenate([f.counts for f in filters])
        order = np.argsort(keys, kind="stable")  # sorted runs: the stable sort merges them
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
        if len(starts):
            keys, counts = keys[starts], np.add.reduceat(counts, starts)
        return cls(keys, counts, filters[0].bits)


def partition_filters(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Filters of a partition's fingerprints, one for each range that occurs."""
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        part = (keys >> np.uint64(bits)).astype(np.int64) if bits < 64 else keys * 0
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist()
        low = np.uint64((1 << bits) - 1)
        spans = list(zip(cuts, [*cuts[1:], len(keys)]))
        return pa.record_batch([
            pa.array([int(part[a]) for a, _ in spans], pa.int64()),
            pa.array([CountingQuotientFilter(keys[a:b] & low, counts[a:b].astype(np.uint64),
                                             bits).to_bytes() for a, b in spans], pa.binary()),
        ], names=["part", "filter"])

    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64).copy())
        if sum(map(len, held)) >= FLUSH:
            yield flush()
            held = []
    if sum(map(len, held)):
        yield flush()


def merge_filters(group: pd.DataFrame) -> pd.DataFrame:
    whole = CountingQuotientFilter.merged(
        [CountingQuotientFilter.from_bytes(x) for x in group["filter"]])
    return pd.DataFrame({"part": group["part"].iloc[:1].to_numpy(), "filter": [whole.to_bytes()]})


def quotient_filters(prints: DataFrame) -> tuple[DataFrame, int]:
    """Merged filters of a column of longs, by the high bits, and the bits below the range."""
    ranges = max(4, (max(1, prints.count()) // PER_FILTER).bit_length())
    bits = 64 - ranges
    built = prints.mapInArrow(lambda b: partition_filters(b, bits), "part long, filter binary")
    return built.groupBy("part").applyInPandas(merge_filters, "part long, filter binary"), bits


def repeated_prints(prints: DataFrame) -> DataFrame:
    """Fingerprints that the merged filters count more than once, with their counts."""
    filters, bits = quotient_filters(prints)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, data in zip(frame["part"], frame["filter"]):
                f = CountingQuotientFilter.from_bytes(data)
                twice = f.counts > 1
                keys = f.keys[twice] | np.uint64((int(part) << bits) & ((1 << 64) - 1))
                yield pd.DataFrame({"print": keys.view(np.int64),
                                    "n": f.counts[twice].astype(np.int64)})

    return filters.mapInPandas(read, "print long, n long")


def equal_groups(docs: DataFrame, id_column: str = "doc_id", text: Column | None = None
                 ) -> DataFrame:
    """Groups of at least two rows with equal bytes: text_sha256, keep_id, group_size.

    keep_id is the largest id of the group, null where no row of it has one.
    """
    text = whole_text(docs) if text is None else text
    rows = docs.select(docs[id_column].alias("id"), text.alias("text"))
    again = small_side(repeated_prints(rows.select(F.xxhash64("text"))).select("print"))
    routed = rows.join(again, F.xxhash64(rows["text"]) == again["print"], "left_semi")
    # copies meet inside their partition first: a group sends one row per task
    same = routed.groupBy("text").agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
    return same.filter("n > 1").select(F.sha2("text", 256).alias("text_sha256"), "keep_id",
                                       F.col("n").alias("group_size"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays. A null text counts as the empty one.
    Rows that share doc_id and text are one document: all of them stay or go together. Rows
    without doc_id go if an equal text has one, else they stay. No rows give no rows; other
    columns, whatever their names, are not read.
    """
    groups = settled(equal_groups(docs)).select(
        F.col("text_sha256").alias("sha"), "keep_id", "group_size")
    rows = docs.select("doc_id", F.sha2(whole_text(docs), 256).alias("text_sha256"))
    found = rows.join(groups, rows["text_sha256"] == groups["sha"], "left")
    keep = F.when(F.col("sha").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long")
        .alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` but for copies, with all their columns: of equal texts one row stays.

    It is the row with the largest doc_id; if several rows share that doc_id, or none has any, one
    of them by a hash of its columns. A null text counts as the empty one. No rows give no rows.
    """
    result = settled(exact_duplicates(docs).withColumn("hash", F.xxhash64("text_sha256")))
    gone = small_side(result.filter("not kept").select(
        F.col("doc_id").alias("gone_id"), F.col("hash").alias("gone_text")))
    text = F.xxhash64(F.sha2(whole_text(docs), 256))
    left = docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"])
                     & (text == gone["gone_text"]), "left_anti")
    tied = result.filter("kept and group_size > 1").groupBy("hash").count().filter(
        "count > 1").select(F.col("hash").alias("tied_text"))
    if tied.isEmpty():
        return left
    tied = small_side(tied)
    row = F.struct(*docs.columns)
    one = left.join(tied, text == tied["tied_text"], "left_semi").groupBy(
        F.sha2(whole_text(docs), 256)).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row"))
    return left.join(tied, text == tied["tied_text"], "left_anti").unionAll(one.select("row.*"))

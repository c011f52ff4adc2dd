"""Near duplicates by SimHash: pigeonhole blocks, verified by Hamming distance.

Fingerprints of 64 bits are cut into blocks. If two differ in at most four bits, then of b blocks
b - 4 are equal, so they meet in a bucket named by those blocks. Equal fingerprints count as one.
Inside a bucket only a forest of verified links is kept, as many as join what the bucket joins,
never all pairs. A bucket beyond ``MEMBERS`` fingerprints is cut into chunks, and every two chunks
meet in a cell of their own, so that no task receives a whole large bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quire.llm import common
from quire.llm.common import pigeonhole_masks, signed, small_side
from quire.llm.components import components
from quire.plans.durable import settled

#: contract of the fingerprint
WORDS, SEED, DISTANCE = 4, 42, 4
#: fingerprints of one bucket or chunk that meet in one group
MEMBERS = 1000
#: hashes whose bits are counted at a time (64 bytes each)
_HASHES = 200_000


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if more than half of the hashes have it; no hashes give zero."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), _HASHES):
        raw = hashes[a:a + _HASHES].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    bits = 2 * counts > len(hashes)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def shingle_hashes(text: bytes, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``words`` words; bytes.lower() and bytes.split() know ASCII only."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, of = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([of(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[:len(found) - words + 1].tolist(), ends[words - 1:].tolist())
    view = memoryview(joined)
    return np.fromiter((of(view[a:b], seed) for a, b in spans), np.uint64,
                       len(found) - words + 1)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [signed(fingerprint(shingle_hashes(x.as_py() or b""))) for x in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array(prints, pa.int64())],
                              names=["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, print (64 bits as a long) of every whole text; a null text has no words."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        _fingerprints, "doc_id long, print long")


def forest(prints: np.ndarray, distance: int = DISTANCE) -> tuple[list, list]:
    """Links that join what pairs within ``distance`` join, one fewer than members of a tree."""
    rest = np.arange(len(prints))
    a, b = [], []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(prints[rest] ^ prints[at]) <= distance
            hits = rest[near].tolist()
            a += [at] * len(hits)
            b += hits
            queue += hits
            rest = rest[~near]
    return a, b


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each group of rows (name, cell, print, node) that arrives sorted."""
    held: list[np.ndarray] = []

    def links(name, cell, prints, nodes) -> pa.RecordBatch:
        new = (name[1:] != name[:-1]) | (cell[1:] != cell[:-1])
        starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        sizes = np.diff(np.append(starts, len(name)))
        two = starts[sizes == 2]
        two = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= DISTANCE]
        u, v = [nodes[two]], [nodes[two + 1]]
        for i, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            x, y = forest(prints[i:i + n])
            u.append(nodes[i:i + n][x])
            v.append(nodes[i:i + n][y])
        u, v = np.concatenate(u), np.concatenate(v)
        return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())],
                               names=["u", "v"])

    def taken(arrays: list[list[np.ndarray]]) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*arrays)]

    parts: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        cols[2] = cols[2].view(np.uint64)
        parts.append(cols)
        name, cell = cols[0], cols[1]
        last = np.flatnonzero((name != name[-1]) | (cell != cell[-1]))
        if not len(last):  # the whole batch continues one group
            continue
        cut = int(last[-1]) + 1
        parts[-1] = [c[:cut] for c in cols]
        yield links(*taken(parts))
        parts = [[c[cut:] for c in cols]]
    if parts:
        yield links(*taken(parts))


def blocks_for(prints: int, bits: int = 64, differing: int = DISTANCE) -> int:
    """Blocks so that a bucket's name has two bits more than it takes to number the prints.

    Any number of blocks finds the same links; more prints take longer names.
    """
    blocks = differing + 2
    while bits * (blocks - differing) // blocks < max(1, prints).bit_length() + 2 and blocks < 11:
        blocks += 1
    return blocks


def near_links(classes: DataFrame, n: int, members: int = MEMBERS) -> DataFrame:
    """Verified links (u, v) between the nodes of (print, node), as forests of the buckets."""
    masks = [signed(m) for m in pigeonhole_masks(64, blocks_for(n), DISTANCE)]
    names = F.array(*[F.xxhash64(F.lit(k), F.col("print").bitwiseAND(F.lit(m)))
                      for k, m in enumerate(masks)])
    rows = classes.select("print", "node", F.explode(names).alias("name"))
    large = small_side(rows.groupBy("name").count().filter(F.col("count") > members)
                       .select(F.col("name").alias("large_name"),
                               F.ceil(F.col("count") / members).cast("int").alias("chunks")))
    rows = rows.join(large, rows["name"] == large["large_name"], "left")
    chunks, own = F.col("chunks"), F.pmod(F.xxhash64("print"), F.col("chunks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), chunks - 1),
                        lambda j: F.least(own, j) * chunks + F.greatest(own, j))
    rows = rows.select("name", F.explode(F.when(chunks.isNull(), F.array(F.lit(0)))
                                         .otherwise(cells)).alias("cell"), "print", "node")
    return (rows.repartition("name", "cell").sortWithinPartitions("name", "cell", "print")
            .mapInArrow(_bucket_links, "u long, v long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most four differing bits.
    Texts without words have the fingerprint zero and link like any other. Rows without doc_id
    link nothing; they get the component of an equal fingerprint that has an id, else null.
    Repeated rows share fingerprint and component. No rows give no rows; other columns, whatever
    their names, are not read.
    """
    rows = settled(fingerprints(docs))
    classes = settled(rows.groupBy("print").agg(F.min("doc_id").alias("node"))
                      .filter("node is not null"))
    joined = components(near_links(classes, classes.count()))
    classes = classes.join(joined, "node", "left").select(
        F.col("print").alias("class_print"),
        F.coalesce("component", "node").alias("component_id"))
    return rows.join(classes, rows["print"] == classes["class_print"], "left").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` but for near copies: of a component one row with the smallest doc_id stays.

    Rows without doc_id, or that share one, count each; those without go first. All columns stay,
    whatever their names; no rows give no rows.
    """
    return common.one_of_each(docs, near_duplicates)

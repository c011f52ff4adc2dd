"""Verified links of shingle sets that share names, without the pairs of a group.

Equal sets are one class. Classes that share a name are a bucket, and its most connected member is
its leader. First every set is compared with one of its leaders: as many pairs as sets. A pair is
dropped if the sizes or 512 parity bits of the sets exclude a link (each difference turns at most
one bit); for the rest the overlap is counted in each of ``PARTS`` fragments of the hashes' order
separately, and summed per pair. Linked sets become one component, and buckets whose members are one
component are done. In the others each set looks for the nearest sets of other components, by
the parity bits, in cells of bounded size; those pairs are compared, ``STEP`` times as many for a set
in each round, until no pair that could still join two components is left. No task holds a
bucket, and a group of near copies sends no pairs inside a component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.common import BROADCAST_ROWS, signed, small_side, text_slices
from quire.llm.components import components
from quire.llm.simhash import shingle_hashes
from quire.plans.durable import settled

#: fragments in which overlaps are counted separately
PARTS = 8
#: nearest sets that a set is compared with in the first round of cells, and in each further one as
#: a multiple of those in the round before
FIRST, STEP = 4, 16
#: sets of a bucket or chunk that meet in one cell
MEMBERS = 500
_BITS = 512
#: rows of cells that are gone through side by side
_ROWS = 20_000


class Rule(NamedTuple):
    """Words of a shingle, and the least Jaccard similarity of a link in hundredths."""

    words: int
    share: int

    def shingles(self, text: bytes) -> np.ndarray:
        """Hashes of the different shingles, ascending."""
        return np.unique(shingle_hashes(text, self.words))


def sketch(found: np.ndarray) -> np.ndarray:
    """Parity bits of a set: two sets differ in at least as many shingles as in bits."""
    odd = np.bincount((found >> np.uint64(7)).astype(np.int64) & (_BITS - 1), minlength=_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int64, copy=False)))


def prints(found: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set, which stand for it."""
    return (signed(xxhash.xxh64_intdigest(found.tobytes())),
            signed(int(found.sum(dtype=np.uint64))))


SETS = ("doc_id long, print long, total long, n long, names array<long>, bits array<long>, "
        "enough boolean")


def named_sets(texts: DataFrame, rule: Rule,
               names: Callable[[np.ndarray], tuple[np.ndarray, bool]]) -> DataFrame:
    """doc_id, print, total, n, names, bits, enough of (doc_id, text).

    ``names`` gives the names (64 bits each) of a set, and whether they are enough of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                sets = [rule.shingles(x.as_py() or b"") for x in batch.column(1).slice(a, b - a)]
                told, enough = zip(*map(names, sets))
                of = [*map(prints, sets)]
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), pa.array([x for x, _ in of], pa.int64()),
                     pa.array([x for _, x in of], pa.int64()),
                     pa.array(map(len, sets), pa.int64()), lists([*told]),
                     lists([*map(sketch, sets)]), pa.array(enough, pa.bool_())],
                    names=["doc_id", "print", "total", "n", "names", "bits", "enough"])

    return texts.mapInArrow(run, SETS)


def classes_of(rows: DataFrame) -> DataFrame:
    """One row for each different set of rows with doc_id: key (its number), node (smallest
    doc_id), print, total, n, names, bits. Written out, so that the numbers stay."""
    return settled(rows.filter("doc_id is not null").groupBy("print", "total").agg(
        F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("names").alias("names"),
        F.first("bits").alias("bits")).withColumn("key", F.monotonically_increasing_id()))


def _cut(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets of rows (text, print, total, u, v) as segments, where the text has these prints: u,
        v (lists), part, segment."""
        edges_of = np.arange(PARTS + 1, dtype=np.uint64) * np.uint64((1 << 32) // PARTS)
        for batch in batches:
            for a, b in text_slices(batch.column(0), 1_000_000):
                part = batch.slice(a, b - a)
                out, segments = [], []
                for x, *of, u, v in zip(part.column(0),
                                        *(part.column(k).to_pylist() for k in range(1, 5))):
                    found = rule.shingles(x.as_py() or b"")
                    if prints(found) != tuple(of):  # another text of the same doc_id
                        continue
                    edges = np.searchsorted(found >> np.uint64(32), edges_of)
                    own = [found[y:z].view(np.int64) for y, z in zip(edges, edges[1:])]
                    out += [(u, v, k) for k in range(PARTS)]
                    segments += own
                cols = [*zip(*out)] or [(), (), ()]
                yield pa.record_batch(
                    [pa.array(cols[0], pa.list_(pa.int64())), pa.array(cols[1], pa.list_(pa.int64())),
                     pa.array(cols[2], pa.int32()), lists(segments)],
                    names=["u", "v", "part", "segment"])

    return run


def _possible(share: int, n_u: Column, n_v: Column, other: Column) -> Column:
    """Whether sets of these sizes, differing in at least ``other`` shingles, may link."""
    return ((100 * F.least(n_u, n_v) >= share * F.greatest(n_u, n_v))
            & ((100 + share) * other <= (100 - share) * (n_u + n_v)))


def possible(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Pairs (u, v) of sets (key, n, bits) that sizes and parity bits do not exclude, with sizes."""
    for x in "uv":
        side = sets.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"),
                           F.col("bits").alias(f"bits_{x}"))
        pairs = pairs.join(side, x)
    other = sum((F.bit_count(F.col("bits_u")[k].bitwiseXOR(F.col("bits_v")[k]))
                 for k in range(_BITS // 64)), F.lit(0))
    return pairs.filter(_possible(share, F.col("n_u"), F.col("n_v"), other)).select(
        "u", "v", "n_u", "n_v")


def linked(pairs: DataFrame, texts: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Links among pairs (u, v, n_u, n_v): the overlaps are counted in each fragment by itself,
    then summed. Only texts that stand for a set of a pair are cut into segments again."""
    sets = classes.select("key", "node", "print", "total")

    def cut(wanted: DataFrame) -> DataFrame:
        # a text is cut once, whatever the number of its pairs
        of = wanted.groupBy("key").agg(F.collect_list(F.struct("u", "v")).alias("w")).select(
            "key", F.col("w.u").alias("u"), F.col("w.v").alias("v"))
        asked = settled(of.join(sets, "key").select("node", "print", "total", "u", "v"))
        if wanted.count() <= BROADCAST_ROWS:
            asked = F.broadcast(asked)
        rows = texts.join(asked, texts["doc_id"] == asked["node"])
        found = rows.select("text", "print", "total", "u", "v").mapInArrow(
            _cut(rule), "u array<long>, v array<long>, part int, segment array<long>")
        return found.select(F.explode(F.arrays_zip("u", "v")).alias("p"), "part", "segment").select(
            "p.u", "p.v", "part", "segment")

    members = cut(pairs.select(F.col("v").alias("key"), "u", "v")).withColumnRenamed(
        "segment", "segment_v")
    leaders = cut(pairs.select(F.col("u").alias("key"), "u", F.lit(0).cast("long").alias("v"))
                  .distinct()).drop("v")
    common = F.size(F.array_intersect("segment_u", "segment_v"))
    counted = members.join(leaders.withColumnRenamed("segment", "segment_u"), ["u", "part"]).groupBy(
        "u", "v", "part").agg(F.max(common).alias("common"))  # rows that repeat say the same
    of = counted.groupBy("u", "v").agg(F.sum("common").alias("common"))
    return of.join(pairs, ["u", "v"]).filter(
        (100 + rule.share) * F.col("common") >= rule.share * (F.col("n_u") + F.col("n_v"))).select(
        "u", "v")


def _first_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (u, v) of every member v of rows (name, key, size) and one leader u: of each bucket the
    member with the largest buckets, and of a member's leaders again the one with the largest."""
    weights = rows.groupBy("key").agg(F.sum("size").alias("weight"))
    weighed = rows.join(weights, "key")
    place = F.struct("weight", (-F.col("key")).alias("key"))
    leaders = weighed.groupBy("name").agg(F.max(place).alias("leader"))
    best = rows.select("name", "key").join(leaders, "name").groupBy("key").agg(
        F.max("leader").alias("leader"))
    return best.select((-F.col("leader.key")).alias("u"), F.col("key").alias("v")).filter("u <> v")


def near_pairs(cell: np.ndarray, component: np.ndarray, n: np.ndarray, bits: np.ndarray, share: int,
               most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b, more) of sets of one cell, but of different components, that sizes and parity bits
    do not exclude: for each set the ``most`` that differ in the fewest bits, and whether one of the
    two has more. The rows of a cell are neighbours; the cells are gone through side by side.
    """
    starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    end = np.repeat(np.append(starts[1:], len(cell)), np.diff(np.append(starts, len(cell))))
    found = []
    i = np.arange(len(cell))
    for step in range(1, int((end - i).max())):
        i = i[end[i] - i > step]
        a = i[(component[i] != component[i + step]) & (
            100 * np.minimum(n[i], n[i + step]) >= share * np.maximum(n[i], n[i + step]))]
        far = np.zeros(len(a), np.int64)
        for few in (slice(0, 2), slice(2, None)):  # two of the words exclude most pairs
            far += np.bitwise_count(bits[a, few] ^ bits[a + step, few]).sum(axis=1, dtype=np.int64)
            fits = (100 + share) * far <= (100 - share) * (n[a] + n[a + step])
            a, far = a[fits], far[fits]
        found.append((a, a + step, far))
    a, b, far = (np.concatenate(x) for x in zip(*found))
    of, other, far = np.append(a, b), np.append(b, a), np.append(far, far)
    order = np.lexsort((other, far, of))
    of, other = of[order], other[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    count = np.diff(np.append(first, len(of)))
    near = np.arange(len(of)) - np.repeat(first, count) < most
    many = np.repeat(count > most, count)[near]
    of, other = of[near], other[near]
    # two sets that look for each other are one pair
    both, pair = np.unique(np.minimum(of, other) * len(cell) + np.maximum(of, other),
                           return_inverse=True)
    more = np.zeros(len(both), bool)
    more[pair[many]] = True
    return both // len(cell), both % len(cell), more


def _cell_pairs(share: int, most: int):
    def pairs(name, cell, key, component, n, bits) -> Iterator[pa.RecordBatch]:
        of = np.cumsum(np.append(True, (name[1:] != name[:-1]) | (cell[1:] != cell[:-1])))
        several = np.bincount(of)[of] > 1
        if several.any():
            key, n = key[several], n[several]
            a, b, more = near_pairs(of[several], component[several], n, bits[several], share, most)
            a, b = np.where(key[a] < key[b], a, b), np.where(key[a] < key[b], b, a)
            yield pa.record_batch([*map(pa.array, (key[a], key[b], n[a], n[b], more))],
                                  names=["u", "v", "n_u", "n_v", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of each group of rows (name, cell, key, component, n, bits) that arrives sorted."""
        parts: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy() for k in range(5)]
            parts.append([*cols, batch.column(5).flatten().to_numpy().view(np.uint64).reshape(
                batch.num_rows, _BITS // 64)])
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            if sum(len(p[0]) for p in parts) < _ROWS or not len(last):
                continue
            cut = int(last[-1]) + 1  # the last group goes on
            rest = [c[cut:] for c in parts[-1]]
            parts[-1] = [c[:cut] for c in parts[-1]]
            yield from pairs(*(np.concatenate(x) for x in zip(*parts)))
            parts = [rest]
        if parts:
            yield from pairs(*(np.concatenate(x) for x in zip(*parts)))

    return run


def _more_pairs(rows: DataFrame, classes: DataFrame, share: int, most: int) -> DataFrame:
    """Pairs (u, v, n_u, n_v, more) of rows (name, key, component, size) that sizes and parity bits do
    not exclude: buckets are cut into chunks of ``MEMBERS``, of which every two meet in a cell."""
    chunks = F.ceil(F.col("size") / MEMBERS).cast("int")
    own = F.pmod(F.xxhash64("key"), chunks).cast("int")
    cells = F.transform(F.sequence(F.lit(0), chunks - 1),
                        lambda j: F.least(own, j) * chunks + F.greatest(own, j))
    sets = classes.select("key", "n", "bits")
    return (rows.select("name", F.explode(cells).alias("cell"), "key", "component").join(sets, "key")
            .select("name", "cell", "key", "component", "n", "bits")
            .repartition("name", "cell").sortWithinPartitions("name", "cell")
            .mapInArrow(_cell_pairs(share, most),
                        "u long, v long, n_u long, n_v long, more boolean"))


def similar_links(texts: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """node, component of the classes (key, node, print, total, n, names, bits) that link others.

    ``texts`` are rows (doc_id, text) in which the nodes are found.
    """
    spark = texts.sparkSession
    rows = classes.select("key", F.explode("names").alias("name"))
    sizes = small_side(rows.groupBy("name").agg(F.count("*").alias("size")).filter("size > 1")
                       .withColumnRenamed("name", "bucket"))
    rows = settled(rows.join(sizes, rows["name"] == sizes["bucket"]).select("name", "key", "size"))
    pairs = settled(possible(_first_pairs(rows), classes, rule.share))
    tested = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    found, left = None, True
    for most in (FIRST * STEP ** k for k in count()):
        links = settled(linked(pairs, texts, classes, rule))
        found = links if found is None else found.unionAll(links)
        joined = settled(components(found))
        if not left:
            return joined
        of = joined.select(F.col("node").alias("key"), "component")
        now = rows.join(of, "key", "left").select(
            "name", "key", "size", F.coalesce("component", "key").alias("component"))
        names = now.groupBy("name").agg(F.min("component").alias("a"), F.max("component").alias("b"))
        open_names = small_side(names.filter("a < b").select("name"))
        rows = settled(now.join(open_names, "name", "left_semi"))
        near = settled(_more_pairs(rows, classes, rule.share, most))
        # once no set has more, these pairs are the last
        left = not near.filter("more").isEmpty()
        pairs = settled(near.select("u", "v", "n_u", "n_v").distinct().join(
            tested, ["u", "v"], "left_anti"))
        if not left and pairs.isEmpty():
            return joined
        tested = tested.unionAll(pairs.select("u", "v"))
        rows = rows.drop("component")


def components_of(rows: DataFrame, texts: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """``rows`` (doc_id, print, total, n ...) with component_id, the smallest doc_id reachable; null
    for sets without a class."""
    joined = similar_links(texts, classes, rule).withColumnRenamed("node", "key")
    known = classes.join(joined, "key", "left").select(
        "print", "total", "node", F.coalesce("component", "key").alias("component"))
    least = known.groupBy("component").agg(F.min("node").alias("component_id"))
    known = known.join(least, "component").select(
        F.col("print").alias("of_print"), F.col("total").alias("of_total"), "component_id")
    return rows.join(known, (rows["print"] == known["of_print"])
                     & (rows["total"] == known["of_total"]), "left").drop("of_print", "of_total")

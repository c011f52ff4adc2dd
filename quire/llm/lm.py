"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs of the training texts are quantised on a logarithmic scale, and an
n-gram of level q is entered q times, as (n-gram, 1) to (n-gram, q). A count is read back by
asking for level 1, 2, ... until the filter says no. The filter is cut into shards by hash, and
every n-gram enters, whatever its count: a shard stays where it is built, and the n-grams of the
texts come to it instead.

Texts are held in blocks: their words once, and for each token the place of its word. A block sends
its different n-grams, with their counts in its training texts, to the shards of their hashes. The
task of a shard adds the counts up, builds the shard, and asks it for the n-grams of each block in
turn; the answers go back to the block, which sums its texts' scores. The number of shards grows with
the corpus, and only sums over all shards and the most frequent words pass through the driver.

Words and pairs are named by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import bucket
from quire.plans.durable import settled

HELD_OUT = (7, 2)
#: words with at least this share of all tokens (2 ** 20 at most) have exact counts in every worker,
#: so that they are not sent back to every block
FREQUENT = 2.0 ** -20
ORDER, BASE, BITS, PROBES = 2, 1.5, 10, 4
#: weight of the lower order, in occurrences of the context
PRIOR = 500.0
#: tokens of a block; bytes of text of one shard
FLUSH, SHARD = 1_000_000, 16_000_000
#: a line feed is in no word, so it names the end
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))
_LEVELS = 160


def token_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words and the end; bytes.lower() and bytes.split() know ASCII only."""
    words = text.lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return _mix(before * np.uint64(0x9E3779B97F4A7C15) + after)


def _planes(values: np.ndarray, kind: str = "<u8") -> bytes:
    """Bytes of equal weight side by side, which the shuffle compresses well."""
    size = np.dtype(kind).itemsize
    return values.astype(kind).view(np.uint8).reshape(-1, size).T.tobytes()


def _unplanes(data: bytes, kind: str = "<u8") -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).reshape(-1)


BLOCKS = ("block long, size long, tokens long, doc_id array<long>, held_out array<boolean>, "
          "lengths array<long>, words binary, places binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, held_out, text) of a task in blocks of at least ``FLUSH`` tokens but the last."""
    block = TaskContext.get().partitionId() << 32
    held: list[np.ndarray] = []
    ids: list[int | None] = []
    out: list[bool] = []
    n = size = 0

    def flush() -> pa.RecordBatch:
        lengths = np.array([len(x) for x in held])
        words, places = np.unique(np.concatenate(held), return_inverse=True)
        train = int(lengths[~np.array(out)].sum())
        return pa.record_batch(
            [pa.array([block]), pa.array([size]), pa.array([train]),
             pa.array([ids], pa.list_(pa.int64())), pa.array([out], pa.list_(pa.bool_())),
             pa.array([lengths], pa.list_(pa.int64())), pa.array([_planes(words)], pa.binary()),
             pa.array([_planes(places, "<u4")], pa.binary())],
            names=["block", "size", "tokens", "doc_id", "held_out", "lengths", "words", "places"])

    for batch in batches:
        for doc_id, held_out, text in zip(*(batch.column(k) for k in range(3))):
            text = text.as_py() or b""
            held.append(token_hashes(text))
            ids.append(doc_id.as_py())
            out.append(held_out.as_py())
            n, size = n + len(held[-1]), size + len(text)
            if n >= FLUSH:
                yield flush()
                held, ids, out, n, size, block = [], [], [], 0, 0, block + 1
    if held:
        yield flush()


def _tokens(lengths: np.ndarray, words: bytes, places: bytes) -> tuple:
    """Words and places of a block, the place of the word before each token, and pairs by token; a
    text begins after an end."""
    words, places = _unplanes(words), _unplanes(places, "<u4")
    before = np.empty_like(places)
    before[1:] = places[:-1]
    before[np.cumsum(lengths) - lengths] = np.searchsorted(words, END)
    return words, places, before, pair_keys(words[before], words[places])


def _counted(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Sorted keys of blocks by order and shard, and their counts in the training texts."""
    for batch in batches:
        for block, held_out, lengths, words, places in zip(
                *(batch.column(k) for k in range(5))):
            lengths = lengths.values.to_numpy()
            train = np.repeat(~held_out.values.to_numpy(zero_copy_only=False), lengths)
            words, places, _, pairs = _tokens(lengths, words.as_py(), places.as_py())
            rows: list[tuple] = []
            for order, keys, at in ((1, words, places), (2, *np.unique(pairs, return_inverse=True))):
                counts = np.bincount(at[train], minlength=len(keys))
                shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
                cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])).tolist()
                for a, b in zip(cuts, [*cuts[1:], len(keys)]):
                    steps = np.diff(keys[a:b], prepend=np.uint64(0))
                    rows.append((order, int(shard[a]), _planes(steps), _planes(counts[a:b])))
            cols = list(zip(*rows))
            yield pa.record_batch(
                [pa.array([block.as_py()] * len(rows), pa.int64()), pa.array(cols[0], pa.int32()),
                 pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()),
                 pa.array(cols[3], pa.binary())],
                names=["block", "order_no", "shard", "steps", "counts"])


def levels_of(counts: np.ndarray, cutoff: int = 1) -> np.ndarray:
    """Level of each count of at least ``cutoff``, at least 1."""
    return 1 + np.floor(np.log(counts / cutoff) / math.log(BASE) + 1e-9).astype(np.int64)


def probes(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and step of the bit numbers of (key, level)."""
    h = _mix(keys + np.uint64(0xD1B54A32D192ED03 * level & (1 << 64) - 1))
    return h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)


def _keys(group: pd.DataFrame) -> list[np.ndarray]:
    return [np.cumsum(_unplanes(x), dtype=np.uint64) for x in group["steps"]]


def _merged(group: pd.DataFrame, cutoff: int = 1) -> pd.DataFrame:
    """Counts of one order and shard added up; its filter, and the counts of single words."""
    keys = np.concatenate(_keys(group))
    counts = np.concatenate([_unplanes(x) for x in group["counts"]])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys, counts = keys[starts], np.add.reduceat(counts, starts)
    enough = counts >= cutoff
    chosen, levels = keys[enough], levels_of(counts[enough], cutoff)
    m = max(64, -(-int(levels.sum()) * BITS // 8) * 8)
    bits = np.zeros(m, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        at, step = probes(chosen[levels >= level], level)
        for _ in range(PROBES):
            bits[at % np.uint64(m)] = True
            at = at + step
    words = int(group["order_no"].iloc[0]) == 1
    return pd.DataFrame({
        "order_no": group["order_no"].iloc[:1].to_numpy(), "shard": group["shard"].iloc[:1]
        .to_numpy(), "n_keys": [np.count_nonzero(counts)], "filter": [np.packbits(bits).tobytes()],
        "level_n": [np.bincount(levels, minlength=_LEVELS)],
        "level_sum": [np.bincount(levels, counts[enough], _LEVELS)],
        "keys": [_planes(keys) if words else b""], "counts": [_planes(counts) if words else b""],
    })


@dataclass
class FilterOrder:
    """Shards of one order; ``means[q]`` is what level q stands for."""

    bits: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    shift: int
    means: np.ndarray

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Means of the levels found; that of 0 where level 1 is not in the filter."""
        found = np.zeros(len(keys), np.int64)
        shard = (keys >> np.uint64(self.shift)).astype(np.int64)
        left, level = np.flatnonzero(self.sizes[shard] > 0), 1
        while len(left):
            at, step = probes(keys[left], level)
            for _ in range(PROBES):
                of = shard[left]
                bit = at % self.sizes[of].astype(np.uint64)
                byte = self.bits[self.starts[of] + (bit >> np.uint64(3)).astype(np.int64)]
                hit = (byte >> (np.uint8(7) - (bit & np.uint64(7)).astype(np.uint8))) & 1 > 0
                left, step = left[hit], step[hit]
                at = at[hit] + step
            found[left] = level
            level += 1
        return self.means[found]


ANSWERS = ("block long, order_no int, shard long, levels binary, counts binary, n_keys long,"
           "level_n array<long>, level_sum array<double>, frequent binary")


def _answered(table: pa.Table, bits: int, least: int) -> pa.Table:
    """Levels of the keys of each block in one order and shard, and exact counts of its words but for
    the frequent ones; a row without block has the sums of the shard, and its frequent words."""
    group = table.drop(["block"]).to_pandas()
    shard = _merged(group)
    number, order_no = int(shard["shard"].iloc[0]), int(shard["order_no"].iloc[0])
    held = np.frombuffer(shard["filter"].iloc[0], np.uint8)
    sizes = np.zeros(1 << bits, np.int64)
    sizes[number] = 8 * len(held)
    order = FilterOrder(held, np.zeros_like(sizes), sizes, 64 - bits, np.arange(_LEVELS + 1))
    keys, counts = _unplanes(shard["keys"].iloc[0]), _unplanes(shard["counts"].iloc[0])
    frequent = counts >= least
    rest = np.where(frequent, 0, counts)
    parts = _keys(group)
    none = [None] * len(parts)
    sums = shard.iloc[0]
    return pa.table({
        "block": pa.array([*table["block"].to_pylist(), None], pa.int64()),
        "order_no": pa.array([order_no] * (len(parts) + 1), pa.int32()),
        "shard": pa.array([number] * (len(parts) + 1), pa.int64()),
        "levels": pa.array([*(order.counts(x).astype(np.uint8).tobytes() for x in parts), b""],
                           pa.binary()),
        "counts": pa.array([*(_planes(rest[np.searchsorted(keys, x)]) if order_no == 1 else b""
                              for x in parts), _planes(counts[frequent])], pa.binary()),
        "n_keys": pa.array([*none, int(sums["n_keys"])], pa.int64()),
        "level_n": pa.array([*none, sums["level_n"]], pa.list_(pa.int64())),
        "level_sum": pa.array([*none, sums["level_sum"]], pa.list_(pa.float64())),
        "frequent": pa.array([*none, _planes(keys[frequent])], pa.binary())})


@dataclass
class Model:
    tokens: int
    words: int
    #: mean count of each level, by order
    means: dict[int, np.ndarray]
    frequent: np.ndarray
    frequent_counts: np.ndarray

    def exact(self, hashes: np.ndarray) -> np.ndarray:
        """Counts of frequent words, 0 for all others."""
        if not len(self.frequent):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
        return np.where(self.frequent[at] == hashes, self.frequent_counts[at], 0)


def trained(blocks: DataFrame) -> tuple[Model, DataFrame]:
    """Model of the training texts of blocks, and the answers of its filter to each block."""
    tokens, size = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)),
                              F.coalesce(F.sum("size"), F.lit(0))).first()
    bits = max(8, (size // SHARD).bit_length())
    least = max(1, math.ceil(FREQUENT * tokens))
    answers = settled(
        blocks.select("block", "held_out", "lengths", "words", "places").mapInArrow(
            lambda b: _counted(b, bits),
            "block long, order_no int, shard long, steps binary, counts binary")
        .groupBy("order_no", "shard").applyInArrow(lambda g: _answered(g, bits, least), ANSWERS))
    sums = answers.filter("block is null")
    by_level = sums.select("order_no", F.posexplode(F.arrays_zip("level_n", "level_sum"))
                           .alias("level", "v")).groupBy("order_no", "level").agg(
        F.sum("v.level_n").alias("n"), F.sum("v.level_sum").alias("total")).toPandas()
    means = {}
    for k in range(1, ORDER + 1):
        means[k] = np.zeros(_LEVELS + 1)
        for row in by_level[by_level["order_no"] == k].itertuples():
            means[k][row.level] = row.total / row.n if row.n else 0
        seen = np.flatnonzero(means[k])
        # a level that only a false answer reaches counts as the one below it
        means[k][1:] = means[k][seen[np.maximum(np.searchsorted(
            seen, np.arange(1, len(means[k])), "right") - 1, 0)]] if len(seen) else 0
    words = sums.filter("order_no = 1").agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0]
    top = sums.filter("order_no = 1").select("frequent", "counts").toPandas()  # 1 / FREQUENT words
    keys, counts = (np.concatenate([np.zeros(0, np.uint64), *map(_unplanes, top[c])])
                    for c in ("frequent", "counts"))
    order = np.argsort(keys)
    model = Model(tokens, words, means, keys[order], counts[order].astype(np.int64))
    return model, answers.filter("block is not null").select(
        "block", "order_no", "shard", "levels", "counts")


def _scores(texts: pa.Table, answers: pa.Table, shared) -> pa.Table:
    """Scores of the texts of one block."""
    model: Model = shared.value
    block = {c: texts.column(c)[0] for c in ("doc_id", "held_out", "lengths", "words", "places")}
    lengths = block["lengths"].values.to_numpy()
    starts = np.cumsum(lengths) - lengths
    words, places, before, pairs = _tokens(lengths, block["words"].as_py(), block["places"].as_py())
    _, first, pair = np.unique(pairs, return_index=True, return_inverse=True)
    answers = answers.sort_by([("order_no", "ascending"), ("shard", "ascending")])
    levels = np.frombuffer(b"".join(answers["levels"].to_pylist()), np.uint8)
    c, both = model.means[1][levels[:len(words)]], model.means[2][levels[len(words):]]
    context = c[before[first]]
    # a word that was not seen counts as one occurrence
    one = np.where(c > 0, c, 1.0)[places[first]] / (model.tokens + 1)
    logs = np.log10((np.minimum(both, context) + PRIOR * one) / (context + PRIOR))
    exact = model.exact(words) + np.concatenate(
        [_unplanes(x) for x in answers["counts"].to_pylist() if x]).astype(np.int64)
    base = np.add.reduceat(np.log10(exact + 1)[places], starts)
    n = len(lengths)
    return pa.table({
        "doc_id": block["doc_id"].values, "held_out": block["held_out"].values,
        "n_tokens": pa.array(lengths, pa.int64()),
        "n_known": pa.array(np.add.reduceat((exact > 0).astype(np.int64)[places], starts), pa.int64()),
        "train_tokens": pa.array(np.full(n, model.tokens), pa.int64()),
        "base_score": base - lengths * math.log10(model.tokens + model.words + 1),
        "score": np.add.reduceat(logs[pair], starts)})


def language_scores(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    and score.

    Texts whose crc32(doc_id) leaves 2 modulo 7 are held out; the others train the model. Null
    and empty texts are an end alone. Repeated rows count and are scored each; a null doc_id
    hashes like the empty text. Without training rows nothing is known and every score is 0. No
    rows give no rows; other columns, whatever their names, are not read.
    """
    out = bucket(docs["doc_id"], HELD_OUT[0]) == HELD_OUT[1]
    blocks = settled(docs.select(docs["doc_id"].cast("long").alias("doc_id"), out.alias("held_out"),
                                 docs["text"].cast("binary").alias("text"))
                     .mapInArrow(_blocks, BLOCKS))
    model, answers = trained(blocks)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return blocks.drop("size", "tokens").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        lambda texts, found: _scores(texts, found, shared),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long,"
        "base_score double, score double")

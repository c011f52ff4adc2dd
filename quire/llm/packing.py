"""Documents as token sequences of a fixed length, packed by the sum-of-squares rule.

Texts become ids once; afterwards only lengths are moved. Pieces are dealt at random into groups
of bounded size, and each group is packed alone: a piece goes where the sum over gaps of the
squared number of open sequences with that gap becomes smallest.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quire.plans.durable import settled

LENGTH, END = 4096, 1
#: pieces of one packed group, on average
GROUP = 50_000
#: words that a worker remembers, in each of two generations
REMEMBERED = 150_000
#: bytes of text whose words are held at a time
_SLICE = 2_000_000


class WordIds:
    """Ids of texts by a vocabulary that drops white space, with a memory of words.

    The tokenizer never joins across white space, so a text's ids are those of its words.
    Letters of Latin-1 and the marks after them are encoded apart, as the tokenizer splits them;
    everything else is left to the tokenizer as it is.
    """

    _simple = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-;=?-@\\[-`{-~]*)")

    def __init__(self, vocabulary: bytes):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_buffer(vocabulary)
        self.model = self.whole.model
        spare = iter(range(256, 512))
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        # the byte-level alphabet: printable bytes stand for themselves
        self.alphabet = {b: b if b in shown else next(spare) for b in range(256)}
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) > REMEMBERED:
                self.parts = {"": b""}
            shown = part.encode().decode("latin-1").translate(self.alphabet)
            ids = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
            self.parts[part] = ids
        return ids

    def _new(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            text = word.decode(errors="replace")
            simple = self._simple.fullmatch(text)
            if simple:
                ids = self._part(simple[1].lower()) + self._part(simple[2])
            else:
                found = self.whole.encode(text, add_special_tokens=False).ids
                ids = np.array(found, "<u4").tobytes()
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        self.young[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        out, at = [], 0
        while at < len(text):
            end = at + _SLICE
            if end < len(text):  # cut behind a white space
                tail = max(text.rfind(s, at, end) for s in (b" ", b"\n"))
                end = tail + 1 if tail > at else len(text)
            get, new = self.young.get, self._new
            out += [get(w) or new(w) for w in (text[at:end] if at or end < len(text)
                                               else text).split()]
            at = end
        return b"".join(out)


_WORDS: dict[int, WordIds] = {}


def word_ids(vocabulary: bytes) -> WordIds:
    """The worker's encoder of a vocabulary; it remembers the words of one at a time."""
    key = xxhash.xxh64_intdigest(vocabulary)
    if key not in _WORDS:
        _WORDS.clear()
        _WORDS[key] = WordIds(vocabulary)
    return _WORDS[key]


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END,
           with_ids: bool = False) -> DataFrame:
    """Pieces of every document's ids: row, doc_id, piece, start, length, ids_crc32 (and ids).

    ``row`` differs between all pieces. ``ids`` holds 32-bit little-endian numbers.
    """
    names = ["row", "doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    last = np.array([end], "<u4").tobytes()
    with open(path, "rb") as f:
        vocabulary = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = word_ids(vocabulary)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = of.encode(text.as_py() or b"") + last
                for k, a in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[a:a + 4 * length]
                    found = (row, key, k, a // 4, len(part) // 4, zlib.crc32(part), part)
                    for col, x in zip(cols, found):
                        col.append(x)
                    row += 1
            n = len(names) if with_ids else 6
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols[:n], kinds)],
                                  names=names[:n])

    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        run, schema + ", ids binary" * with_ids)


def sum_of_squares(lengths: np.ndarray, room: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, placed in the order given.

    With n[f] open sequences filled to f, moving one from f to f + s changes the sum of squares
    by 2 * (n[f + s] - n[f]) + 2, by -2 * n[f] + 1 if it becomes full, and opening one by
    2 * n[s] + 1. Of equal changes the fullest sequence is taken.
    """
    n = np.zeros(room + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(room + 1)]
    where, offset, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        fill, cost = 0, (1 if s == room else 2 * int(n[s]) + 1)
        top = room - s
        if top > 0:
            change = 2 * (n[s + 1:room + 1] - n[1:top + 1]) + 2
            change[-1] = 1 - 2 * n[top]
            change[n[1:top + 1] == 0] = np.iinfo(np.int64).max
            best = top - 1 - int(np.argmin(change[::-1]))
            if change[best] <= cost:
                fill = best + 1
        if fill:
            where[i] = open_at[fill].pop()
            n[fill] -= 1
        else:
            where[i], made = made, made + 1
        offset[i] = fill
        if fill + s < room:
            n[fill + s] += 1
            open_at[fill + s].append(int(where[i]))
    return where, offset


def packed(cut: DataFrame, room: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``cut`` (row, length and others, written out) with sequence_id and offset.

    Each group takes the longer half of its pieces first, both halves in random order.
    """
    groups = max(1, round(cut.count() / group))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        dice = (rows["row"].to_numpy().view(np.uint64) + np.uint64(1)) * np.uint64(
            0x9E3779B97F4A7C15)
        small = rows["length"].to_numpy() <= rows["length"].median()
        rows = rows.iloc[np.lexsort([dice, small])]
        where, offset = sum_of_squares(rows["length"].to_numpy(), room)
        return rows.assign(sequence_id=(rows["part"].to_numpy() << 40) + where, offset=offset)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long"))
    return dealt.groupBy("part").applyInPandas(
        place, schema + ", part long, sequence_id long, offset long").drop("part")


def packed_documents(docs: DataFrame, path: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and the end id; null and empty texts are the end id alone. Longer ones
    than a sequence are cut, others stay whole. Repeated rows are packed each, also without
    doc_id. No rows give no rows; other columns, whatever their names, are not read.
    """
    return packed(settled(pieces(docs, path))).drop("row")


def sequences(docs: DataFrame, path: str) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, ids (array of int), pieces in order."""
    cut = settled(pieces(docs, path, with_ids=True))
    placed = packed(cut.drop("ids")).select("row", "sequence_id", "offset")
    one = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most a sequence's length

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(ids=[np.frombuffer(b"".join(p["ids"] for p in parts), "<u4")
                                .astype(np.int32) for parts in f["ids"]])

    return (cut.select("row", "length", "ids").join(placed, "row").groupBy("sequence_id")
            .agg(F.sum("length").alias("n_tokens"), one.alias("ids"))
            .mapInPandas(read, "sequence_id long, n_tokens long, ids array<int>"))

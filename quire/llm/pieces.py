"""SentencePiece BPE with seeded merge-dropout, and its decoding.

Merges run over an agenda of candidates: the best score first, of equal scores the leftmost. A
candidate that comes up is skipped if a hash of seed, variant, the characters around it, its place
and the piece it would make falls below the dropout rate. A seed therefore always gives the same
pieces, another seed others, and the decoded text is the same whatever was skipped. Without
dropout the ids are those of the library.

Documents are dealt to ``VARIANTS`` variants by a hash of their id, so that a word is cut in
several ways within one pass over a corpus, while a worker can still remember what it has cut.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

RATE, SEED, VARIANTS = 0.1, 1, 4
#: words, in each of two generations, and runs that a worker remembers over all variants
REMEMBERED = 700_000
#: bytes of text that are encoded at a time
_BYTES = 4_000_000
_MARK, _OWN_MARK = "▁", "\ud800"  # the sign for a space; stands for that sign in a text
_WORD, _NO_PIECE = (1 << 64) - 1, 1 << 30
#: characters up to which runs are merged many at once, and how many
SHORT, _ROWS = 32, 20_000
_PLACE, _MADE, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03,
                                              0xBF58476D1CE4E5B9))
#: marks that mostly end a word; fixed values
_TAIL = ".,;:!?\"')]"


def skipped(state: int, place: int, made: int, limit: int) -> bool:
    """Whether the candidate that makes a piece at a place is left out."""
    dice = state ^ place * int(_PLACE) ^ made * int(_MADE)
    return (dice * int(_MIX) & _WORD) >> 32 < limit


class Vocabulary:
    """Pieces of a model: ids, scores, bytes, and which characters may meet inside a piece."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.bytes_of: list[bytes] = []
        byte_ids: dict[int, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.scores.append(sp.get_score(i))
            if sp.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.ids[piece] = i
                self.bytes_of.append(piece.replace(_MARK, " ").encode())
        self.byte_ids = [byte_ids[b] for b in range(256)]
        self.meet = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        order = {s: k for k, s in enumerate(sorted({self.scores[i] for i in self.ids.values()},
                                                   reverse=True))}
        self.ranks = {p: order[self.scores[i]] for p, i in self.ids.items()}
        pairs = sorted((self.ids[p[:k]] << 32 | self.ids[p[k:]], self.ranks[p], i)
                       for p, i in self.ids.items() for k in range(1, len(p))
                       if p[:k] in self.ids and p[k:] in self.ids)
        # the last row stands for two symbols that make no piece
        table = np.array([*pairs, (-1, _NO_PIECE, -1)], np.int64).T
        self.pair_keys, self.pair_ranks, self.pair_made = table[0][:-1], table[1], table[2]

    def spelled(self, char: str) -> list[int]:
        """Byte pieces of a character that is no piece."""
        raw = _MARK.encode() if char == _OWN_MARK else char.encode(errors="surrogateescape")
        return [self.byte_ids[b] for b in raw]

    def decode(self, ids: list[int]) -> bytes:
        """The text's bytes; the space before the first word is the model's own."""
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:]

    def merge(self, text: str, rate: float = 0.0, key: int = 0) -> list[int]:
        """Ids of one run of characters by agenda, with candidates skipped at ``rate``."""
        limit = int(rate * (1 << 32))
        state = xxhash.xxh64_intdigest(text.encode(errors="surrogatepass"), key) if limit else 0
        parts = self._in_heap(text, limit, state)
        found = [*map(self.ids.get, parts)]
        if None not in found:
            return found
        return [i for part, one in zip(parts, found)
                for i in ([one] if one is not None else self.spelled(part))]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of the pair table for each two neighbouring symbols."""
        none = len(self.pair_keys)
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), none - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pair_keys[at] == keys), at, none)

    def merge_many(self, runs: list[str], rate: float = 0.0, key: int = 0) -> list[list[int]]:
        """``merge`` for many runs at once: a row of symbols for each, a merge a round."""
        limit = int(rate * (1 << 32))
        out: list = [None] * len(runs)
        known = [k for k, run in enumerate(runs)
                 if run and len(run) <= SHORT and not self.strange(run)]
        for a in range(0, len(known), _ROWS):
            some = known[a:a + _ROWS]
            states = np.array([xxhash.xxh64_intdigest(runs[k].encode(), key) for k in some],
                              np.uint64) if limit else np.zeros(len(some), np.uint64)
            symbols = self._merged_rows([runs[k] for k in some], limit, states)
            sizes = (symbols >= 0).sum(axis=1)
            flat = symbols[symbols >= 0].tolist()
            for k, begin, n in zip(some, (np.cumsum(sizes) - sizes).tolist(), sizes.tolist()):
                out[k] = flat[begin:begin + n]
        return [ids if ids is not None else self.merge(run, rate, key)
                for run, ids in zip(runs, out)]

    def _merged_rows(self, runs: list[str], limit: int, states: np.ndarray) -> np.ndarray:
        """Symbols left of each run, -1 behind them; the agenda of a row is its row of ranks."""
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        width = int(sizes.max(initial=1)) + 1
        symbol = np.full((len(runs), width), -1, np.int64)
        symbol[np.arange(width) < sizes[:, None]] = [self.ids[c] for c in "".join(runs)]
        result = np.full_like(symbol, -1)
        place = np.broadcast_to(np.arange(width, dtype=np.uint64), symbol.shape).copy()
        pair = self._pairs(symbol[:, :-1], symbol[:, 1:])
        rank, row = self.pair_ranks[pair], np.arange(len(runs))
        columns = np.arange(width)
        while len(row):
            k = rank.argmin(axis=1)
            here = np.arange(len(row))
            going = rank[here, k] < _NO_PIECE
            if not going.all():
                result[row[~going]] = symbol[~going]
                symbol, place, pair, rank, row, states, k = (
                    x[going] for x in (symbol, place, pair, rank, row, states, k))
                here = np.arange(len(row))
            made = self.pair_made[pair[here, k]]
            if limit:
                dice = states ^ place[here, k] * _PLACE ^ made.astype(np.uint64) * _MADE
                left_out = dice * _MIX >> np.uint64(32) < limit
                rank[here[left_out], k[left_out]] = _NO_PIECE
                here, k, made = here[~left_out], k[~left_out], made[~left_out]
            # what stands behind the merged pair moves up by one
            symbol[here, k] = made
            behind = np.minimum(columns + (columns > k[:, None]), width - 1)
            symbol[here] = np.take_along_axis(symbol[here], behind, 1)
            place[here] = np.take_along_axis(place[here], behind, 1)
            behind = np.minimum(columns[:-1] + (columns[:-1] >= k[:, None]), width - 2)
            pair[here] = np.take_along_axis(pair[here], behind, 1)
            rank[here] = np.take_along_axis(rank[here], behind, 1)
            for begin in (k, k - 1):  # the last column is never a symbol
                fits = (begin >= 0) & (begin < width - 1)
                h, c = here[fits], begin[fits]
                pair[h, c] = self._pairs(symbol[h, c], symbol[h, c + 1])
                rank[h, c] = self.pair_ranks[pair[h, c]]
        return result

    def strange(self, run: str) -> bool:
        """Whether a character of the run is no piece."""
        return not all(map(self.ids.__contains__, run))

    def _in_heap(self, text: str, limit: int, state: int) -> list[str]:
        """Symbols left of one run; a heap takes no more than n log n for any length."""
        n, ids = len(text), self.ids
        parts = list(text)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        agenda: list[tuple] = []

        def offer(left: int, right: int) -> None:
            made = ids.get(parts[left] + parts[right])
            if made is not None:
                heapq.heappush(agenda, (-self.scores[made], left, right, made,
                                        len(parts[left]) + len(parts[right])))

        for k in range(n - 1):
            offer(k, k + 1)
        while agenda:
            _, left, right, made, size = heapq.heappop(agenda)
            if not parts[left] or not parts[right] or after[left] != right or (
                    len(parts[left]) + len(parts[right]) != size):
                continue  # one of the two has been merged otherwise
            if limit and skipped(state, left, made, limit):
                continue
            parts[left] += parts[right]
            parts[right] = ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        return [part for part in parts if part]


class Encoder:
    """Packed ids of texts; remembers words by variant."""

    def __init__(self, vocabulary: Vocabulary, rate: float, seed: int, variants: int):
        self.vocabulary, self.rate, self.variants = vocabulary, rate, variants
        self.keys = [xxhash.xxh64_intdigest(f"{seed}/{v}") for v in range(variants)]
        self.young: list[dict] = [{} for _ in range(variants)]
        self.old: list[dict] = [{} for _ in range(variants)]
        self.runs: list[dict] = [{} for _ in range(variants)]
        self.count = self.run_count = 0
        self.feeds = any("\n" in pair for pair in vocabulary.meet)

    def _learn(self, words: set[bytes], variant: int) -> None:
        """Remember the ids of words with the space before them; further spaces are their own."""
        known, runs, old = self.young[variant], self.runs[variant], self.old[variant]
        parts: dict[bytes, list[str]] = {}
        for word in words:
            ids = old.get(word)
            if ids is not None:
                known[word] = ids
                continue
            text = word.decode(errors="surrogateescape").replace(_MARK, _OWN_MARK)
            parts[word] = self.cut(_MARK + text.replace(" ", _MARK))
        new = [*{x for found in parts.values() for x in found if x not in runs}]
        merged = self.vocabulary.merge_many(new, self.rate, self.keys[variant])
        runs.update(zip(new, (struct.pack(f"<{len(x)}I", *x) for x in merged)))
        for word, found in parts.items():
            known[word] = b"".join([runs[x] for x in found])
        self.count += len(words)
        self.run_count += len(new)

    def cut(self, text: str) -> list[str]:
        """Runs of a word: cut at line feeds and before the marks at its end, where no piece
        reaches over."""
        lines = [text] if "\n" not in text or self.feeds else [
            x for x in re.split("(\n)", text) if x]
        out = []
        for line in lines:
            core = line.rstrip(_TAIL)
            if core and core != line and line[len(core) - 1:len(core) + 1] not in (
                    self.vocabulary.meet):
                out += [core, line[len(core):]]
            else:
                out.append(line)
        return out

    def encode(self, texts: list[bytes], variants: list[int]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit numbers."""
        if self.count > REMEMBERED:
            self.old, self.young, self.count = self.young, [{} for _ in self.keys], 0
        if self.run_count > REMEMBERED:
            self.runs, self.run_count = [{} for _ in self.keys], 0
        cut = [spaced(t) for t in texts]
        missing: list[set] = [set() for _ in self.keys]
        for words, v in zip(cut, variants):
            missing[v].update(words)
        for v, words in enumerate(missing):
            self._learn(words.difference(self.young[v]), v)
        return [b"".join([*map(self.young[v].__getitem__, words)])
                for words, v in zip(cut, variants)]


def spaced(text: bytes) -> list[bytes]:
    """Words between single spaces; of several spaces all but one stay with the word behind."""
    words = text.split(b" ") if text else []
    if b"" not in words:
        return words
    joined, spaces = [], b""
    for word in words[:-1]:
        if word:
            joined.append(spaces + word)
            spaces = b""
        else:
            spaces += b" "
    return [*joined, spaces + words[-1]]


def slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Neighbouring rows of at most ``_BYTES`` bytes of text together, or a single row."""
    begin = total = 0
    for k, n in enumerate(sizes):
        if total + n > _BYTES and k > begin:
            yield begin, k
            begin, total = k, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


_LOADED: dict[tuple, Encoder] = {}


def encoder(model: bytes, rate: float, seed: int, variants: int) -> Encoder:
    """The worker's encoder for a model and its parameters."""
    key = (xxhash.xxh64_intdigest(model), rate, seed, variants)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(Vocabulary(model), rate, seed, variants)
    return _LOADED[key]


def encoded(docs: DataFrame, path: str, rate: float = RATE, seed: int = SEED,
            variants: int = VARIANTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, variant, n_pieces, ids, lossless.

    ``ids`` cover the whole text, ``lossless`` says that decoding them gave its bytes again. Null
    and empty texts have no pieces; a null doc_id has variant 0; repeated rows get equal ids. Any
    bytes are encoded, the sign for a space and invalid ones by byte pieces. No rows give no rows;
    other columns, whatever their names, are not read.
    """
    with open(path, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(model, rate, seed, variants)

        def batch_of(held: list[tuple]) -> pa.RecordBatch:
            key, variant, ids, good = zip(*held)
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            values = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            return pa.record_batch(
                [pa.array(key, pa.int64()), pa.array(variant, pa.int32()),
                 pa.array(np.diff(ends).astype(np.int64)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
                 pa.array(good, pa.bool_())],
                names=["doc_id", "variant", "n_pieces", "ids", "lossless"])

        for batch in batches:
            keys, variants_of = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sizes = [len(x.as_buffer() or b"") for x in batch.column(2)]
            for a, b in slices(sizes):
                texts = [x.as_py() or b"" for x in batch.column(2).slice(a, b - a)]
                ids = of.encode(texts, variants_of[a:b])
                back = [of.vocabulary.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
                yield batch_of([*zip(keys[a:b], variants_of[a:b], ids, map(eq, back, texts))])

    variant = F.coalesce(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(variants)),
                         F.lit(0)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.when(F.col("doc_id").isNull(), 0).otherwise(variant).alias("variant"),
                       F.col("text").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, variant int, n_pieces long, ids array<int>, "
                                "lossless boolean")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with ids (array of int); null ids are an empty text."""
    with open(path, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(model, 0.0, 0, 1).vocabulary
        for batch in batches:
            texts = [of.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.binary())],
                                  names=["doc_id", "text"])

    return (rows.select(F.col("doc_id").cast("long"), "ids")
            .mapInArrow(run, "doc_id long, text binary")
            .withColumn("text", F.col("text").cast("string")))

"""Alignment of the tokens of two tokenizers over the bytes of a text.

Byte places where tokens of both end cut the tokens into groups. A stretch of a text is a fragment:
the tokens up to its first common end (open to the left), closed groups, the tokens behind its last
common end (open to the right). Fragments compose associatively, an empty one is neutral, so a text
can be cut into byte ranges anywhere, also inside a group: long texts are dealt as ranges to tasks
and their fragments are put together ``FAN`` at a time, in a tree of Spark rounds. Shorter texts
are composed where they are read.

Neither tokenizer joins over a space or line feed that follows another character than white space,
so a text is tokenised in units that begin there, and a worker remembers the fragments of units.
A vocabulary that does not allow this (see ``Aligner``) gets whole texts.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import small_side, text_slices
from quire.plans.durable import settled

#: bytes of a range of a long text; texts of at most that many are not cut
RANGE = 65_536
#: fragments that are put together at a time
FAN = 16
#: units that a worker remembers, in each of two generations
REMEMBERED = 150_000
#: links of a group that are listed one by one
_FEW = 1000
#: a pair of ids as one number: A's id times this and B's id
_PAIR = 1 << 32
_MARK = "▁"

Ids = tuple[int, ...]
Group = tuple[Ids, Ids]


_EMPTY: Group = ((), ())


class Fragment(NamedTuple):
    """Tokens that end in a byte range. Without a common end (``cut``) all are in ``head``; with
    one and an empty ``head`` the range begins at a common end."""

    cut: bool = False
    head: Group = _EMPTY
    groups: tuple[Group, ...] = ()
    tail: Group = _EMPTY


def joined(x: Group, y: Group) -> Group:
    return x[0] + y[0], x[1] + y[1]


def composed(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges."""
    if not x.cut:
        return y._replace(head=joined(x.head, y.head))
    if not y.cut:
        return x._replace(tail=joined(x.tail, y.head))
    between = joined(x.tail, y.head)
    return Fragment(True, x.head, (*x.groups, *[between] * (between != _EMPTY), *y.groups), y.tail)


def fragment(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> Fragment:
    """Fragment of the tokens (ids and where they end) of one range."""
    ends = np.intersect1d(a_ends, b_ends)
    if not len(ends):
        return Fragment(head=(tuple(a.tolist()), tuple(b.tolist())))
    cut_a = [0, *np.searchsorted(a_ends, ends, side="right").tolist(), len(a)]
    cut_b = [0, *np.searchsorted(b_ends, ends, side="right").tolist(), len(b)]
    a, b = a.tolist(), b.tolist()
    parts = [(tuple(a[w:x]), tuple(b[y:z]))
             for w, x, y, z in zip(cut_a, cut_a[1:], cut_b, cut_b[1:])]
    return Fragment(True, parts[0], tuple(parts[1:-1]), parts[-1])


def spelled(groups) -> bytes:
    return ";".join([f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups]).encode()


def pairs(groups) -> tuple[np.ndarray, np.ndarray]:
    """Different linked pairs of ids as numbers, ascending, and their links."""
    single: list[int] = []
    codes, times = [], []
    for a, b in groups:
        if len(a) * len(b) <= _FEW:
            single += [x * _PAIR + y for x in a for y in b]
        else:
            (x, m), (y, n) = (np.unique(np.array(i, np.int64), return_counts=True) for i in (a, b))
            codes.append((x[:, None] * _PAIR + y).reshape(-1))
            times.append((m[:, None] * n).reshape(-1))
    codes.append(np.array(single, np.int64))
    times.append(np.ones(len(single), np.int64))
    return summed(np.concatenate(codes), np.concatenate(times))


def summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, place = np.unique(codes, return_inverse=True)
    return codes, np.bincount(place, times, len(codes)).astype(np.int64)


#: what is remembered of a unit: whether both tokenizers give its bytes again, its tokens of A and
#: of B, its groups, the groups' text, and a number (int64) for each link
Unit = tuple[bool, int, int, int, bytes, bytes]
_BAD: Unit = (False, 0, 0, 0, b"", b"")


class Aligner:
    """Both tokenizers and the units that a worker remembers."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a_file)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b_file)
        spare = iter(range(256, 512))
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        # the byte-level alphabet: printable bytes stand for themselves
        byte = {chr(b if b in shown else next(spare)): b for b in range(256)}
        self.a_bytes = {i: bytes(byte[c] for c in t) if set(t) <= byte.keys() else t.encode()
                        for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.a_sizes = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_sizes[[*self.a_bytes]] = [*map(len, self.a_bytes.values())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i)
                        else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.b_sizes = np.array([*map(len, self.b_bytes)], np.int64)
        self.fast = self._merges(json.loads(a_file), self.a_bytes)
        feed = self.b.encode("\n")
        self.units = (len(feed) == 2 and self.b.is_byte(feed[1])
                      and not any("\n" in p or _MARK in p.lstrip(_MARK) for p in pieces))
        self.young: dict[str, Unit] = {}
        self.old: dict[str, Unit] = {}

    @staticmethod
    def _merges(of: dict, known: dict[int, bytes]):
        """A faster encoder of words for a vocabulary whose ids are the order of its merges."""
        cut = of["pre_tokenizer"] or {}
        if of["normalizer"] or of["model"]["type"] != "BPE" or of["model"].get("dropout") or (
                cut.get("type") != "ByteLevel" or not cut.get("use_regex")):
            return None
        merges, ids = of["model"]["merges"], of["model"]["vocab"]
        pairs_ = (m.split(" ") if isinstance(m, str) else m for m in merges)
        if any(ids.get("".join(m)) != 256 + k for k, m in enumerate(pairs_)):
            return None
        import tiktoken

        ranks = {known[i]: i for i in range(256 + len(merges))}
        return tiktoken.Encoding("words", pat_str=r" ?\p{L}+", mergeable_ranks=ranks,
                                 special_tokens={})

    #: white space and what follows it, to the next space or line feed behind something else
    _unit = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
    #: where a unit may begin
    _start = re.compile(r"(?<=\S)(?=[ \n])")

    def cut(self, text: str) -> list[str]:
        """Units of space + text."""
        return self._unit.findall(text) if self.units else [text]

    def _read(self, units: list[str], a: list[list[int]], b: list[list[int]]) -> None:
        """Remember units, given their ids; all of them are laid one after the other."""
        own = [u.encode() for u in units]
        good = [b"".join([self.b_bytes[i] for i in y]) == o
                and b"".join([self.a_bytes[i] for i in x]) == o for o, x, y in zip(own, a, b)]
        if not all(good):
            self.young.update((u, _BAD) for u, fine in zip(units, good) if not fine)
            units, own, a, b = ([x for x, fine in zip(xs, good) if fine]
                                for xs in (units, own, a, b))
        if not units:
            return
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        a_ids, b_ids = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum()))
                        for x, n in ((a, n_a), (b, n_b)))
        a_ends, b_ends = np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b_sizes[b_ids])
        ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
        cut_a, cut_b = (np.append(0, np.searchsorted(x, ends) + 1) for x in (a_ends, b_ends))
        in_a, in_b = np.diff(cut_a), np.diff(cut_b)
        n = in_a * in_b
        of = np.repeat(np.arange(len(ends)), n)
        at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        links = (a_ids[cut_a[of] + at // in_b[of]] * _PAIR + b_ids[cut_b[of] + at % in_b[of]])
        told_a, told_b = [*map(str, a_ids.tolist())], [*map(str, b_ids.tolist())]
        w, x = cut_a.tolist(), cut_b.tolist()
        told = [f"{','.join(told_a[p:q])}|{','.join(told_b[y:z])}"
                for p, q, y, z in zip(w, w[1:], x, x[1:])]
        unit_ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
        groups = np.append(0, np.searchsorted(ends, unit_ends) + 1)
        link_ends = (8 * np.append(0, np.cumsum(n))[groups]).tolist()
        groups, packed = groups.tolist(), links.tobytes()
        self.young.update(
            (u, (True, m, n, j - i, ";".join(told[i:j]).encode(), packed[y:z]))
            for u, m, n, i, j, y, z in zip(units, n_a.tolist(), n_b.tolist(), groups, groups[1:],
                                           link_ends, link_ends[1:]))

    def ids(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A's and B's ids of each unit."""
        if self.fast:  # a space and letters are one word to A's pattern
            word = [u[1:].isalpha() and u[0] == " " for u in units]
            rest = iter(self.a.encode_batch_fast([u for u, w in zip(units, word) if not w],
                                                 add_special_tokens=False))
            merge = self.fast.encode_ordinary
            a = [merge(u) if w else next(rest).ids for u, w in zip(units, word)]
        else:
            a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        if self.units:  # a line feed is two pieces, and nothing behind depends on it
            b = [i[2:] for i in self.b.encode(["\n" + u for u in units], num_threads=1)]
        else:
            b = self.b.encode([u[1:] for u in units], num_threads=1)
        return a, b

    def learn(self, texts: list[list[str]]) -> None:
        """Remember the units of texts."""
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        new = []
        for u in set().union(*texts).difference(self.young):
            known = self.old.get(u)
            if known:
                self.young[u] = known
            else:
                new.append(u)
        gc.disable()  # many new objects, none of them in a cycle
        try:
            for k in range(0, len(new), 10_000):
                some = new[k:k + 10_000]
                self._read(some, *self.ids(some))
        finally:
            gc.enable()

    def of(self, units: list[str]) -> list[Unit]:
        return [*map(self.young.__getitem__, units)]


_LOADED: dict[tuple, Aligner] = {}


def aligner(a_file: bytes, b_file: bytes) -> Aligner:
    """The worker's aligner of two tokenizers."""
    key = xxhash.xxh64_intdigest(a_file), xxhash.xxh64_intdigest(b_file)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Aligner(a_file, b_file)
    return _LOADED[key]


def ranges(text: str, size: int, units: bool) -> list[tuple[str, int, int]]:
    """A long text (with its space) as (window, lo, hi): the window is whole units, and the range
    is the window's bytes lo to hi. The next range begins where the last one ended; a unit longer
    than a range is not cut.
    """
    if not units:
        return [(text, 0, len(text.encode()))]
    out, at, window = [], 0, 0  # where the range and its window begin
    while at < len(text):
        stop = at + size
        if stop >= len(text):
            stop = until = len(text)
            following = stop
        else:
            hit = Aligner._start.search(text, stop)
            until = hit.start() if hit else len(text)
            following = window  # the unit that holds the end of the range
            for hit in Aligner._start.finditer(text, max(window, stop - size), stop + 1):
                following = hit.start()
            if until - following > size:
                stop = following = until
        lo = len(text[window:at].encode())
        out.append((text[window:until], lo, lo + len(text[at:stop].encode())))
        at, window = stop, following
    return out


_FRAGMENT = ("good boolean, n_a long, n_b long, cut boolean, head_a array<int>, head_b array<int>, "
             "tail_a array<int>, tail_b array<int>, groups binary, n_groups long, codes array<long>, "
             "times array<long>")
_RESULT = ("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "codes array<long>, times array<long>")


def range_fragment(of: Aligner, window: str, lo: int, hi: int) -> dict:
    """Columns of the fragment of one range, without a key."""
    units = of.cut(window)
    of.learn([units])
    found = of.of(units)
    if not all(u[0] for u in found):
        return _row(False, 0, 0, Fragment())
    ends = np.cumsum(np.fromiter((len(u.encode()) for u in units), np.int64, len(units)))
    first = int(np.searchsorted(ends - np.diff(ends, prepend=0), lo))  # units inside the range
    last = max(first, int(np.searchsorted(ends, hi, side="right")))
    parts = [_closed(found[first:last])]
    for k in {first - 1, last} & set(range(len(units))):  # units that it cuts
        a, b = (np.array(x[0], np.int64) for x in of.ids([units[k]]))
        begin = int(ends[k]) - len(units[k].encode())
        a_ends, b_ends = begin + np.cumsum(of.a_sizes[a]), begin + np.cumsum(of.b_sizes[b])
        x, y = (a_ends > lo) & (a_ends <= hi), (b_ends > lo) & (b_ends <= hi)
        part = _row(True, int(x.sum()), int(y.sum()),
                    fragment(a[x], a_ends[x], b[y], b_ends[y]))
        parts.insert(0 if k < first else len(parts), part)
    return together(parts)


def _closed(units: list[Unit]) -> dict:
    """Columns of the fragment of whole units; none at all is the neutral fragment."""
    if not units:
        return _row(True, 0, 0, Fragment())
    _, n_a, n_b, n_groups, groups, links = zip(*units)
    codes, times = np.unique(np.frombuffer(b"".join(links), np.int64), return_counts=True)
    return _row(True, sum(n_a), sum(n_b), Fragment(True)) | {
        "groups": b";".join(groups), "n_groups": sum(n_groups), "codes": codes, "times": times}


def _row(good: bool, n_a: int, n_b: int, of: Fragment) -> dict:
    codes, times = pairs(of.groups)
    return {"good": good, "n_a": n_a, "n_b": n_b, "cut": of.cut, "head_a": of.head[0],
            "head_b": of.head[1], "tail_a": of.tail[0], "tail_b": of.tail[1],
            "groups": spelled(of.groups), "n_groups": len(of.groups), "codes": codes,
            "times": times}


def _open(r: dict, end: str) -> Group:
    a, b = (tuple(np.asarray(r[f"{end}_{x}"], np.int64).tolist()) for x in "ab")
    return a, b


def together(rows: list[dict]) -> dict:
    """Columns of the fragment that neighbouring rows make; groups closed inside stay summaries."""
    if not all(r["good"] for r in rows):
        return _row(False, 0, 0, Fragment())
    of, spell = Fragment(), []
    codes, times = [], []
    n_groups = 0
    for r in rows:
        one = Fragment(r["cut"], _open(r, "head"), (), _open(r, "tail"))
        of = composed(of, one)
        new = _row(True, 0, 0, of)  # the group that this step closed, if any
        for part in (new, r):
            if part["n_groups"]:
                spell.append(part["groups"])
                n_groups += part["n_groups"]
                codes.append(np.asarray(part["codes"]))
                times.append(np.asarray(part["times"]))
        of = of._replace(groups=())
    none = [np.zeros(0, np.int64)]
    codes, times = summed(np.concatenate(codes or none), np.concatenate(times or none))
    return _row(True, sum(r["n_a"] for r in rows), sum(r["n_b"] for r in rows), of) | {
        "groups": b";".join(spell), "n_groups": n_groups, "codes": codes, "times": times}


def finished(r: dict) -> dict:
    """Result of a whole text from its fragment: the first group ends its open head."""
    if not r["good"] or not r["n_a"] or not r["cut"]:
        none = np.zeros(0, np.int64)
        return {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "",
                "codes": none, "times": none}
    first = [g for g in [_open(r, "head")] if g != _EMPTY]
    codes, times = pairs(first)
    codes, times = summed(np.concatenate([codes, r["codes"]]), np.concatenate([times, r["times"]]))
    groups = b";".join([spelled(first)] * len(first) + [r["groups"]] * (r["n_groups"] > 0))
    return {"n_a": r["n_a"], "n_b": r["n_b"], "n_groups": r["n_groups"] + len(first),
            "n_links": int(times.sum()), "groups_sha256": hashlib.sha256(groups).hexdigest(),
            "codes": codes, "times": times}


def short_result(units: list[Unit]) -> dict:
    """Result of a text from the fragments of its units, all of which are closed."""
    good, n_a, n_b, n_groups, groups, links = zip(*units)
    if not all(good):
        return finished(_row(False, 0, 0, Fragment()))
    codes = np.frombuffer(b"".join(links), np.int64)
    n_links = len(codes)
    codes, times = np.unique(codes, return_counts=True)
    return {"n_a": sum(n_a), "n_b": sum(n_b), "n_groups": sum(n_groups), "n_links": n_links,
            "groups_sha256": hashlib.sha256(b";".join(groups)).hexdigest(),
            "codes": codes, "times": times}


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r.get(f.name) for r in rows], f.type) for f in schema],
                           schema=schema)


_ROWS = "row long, doc_id long, " + _RESULT + ", part int, parts int, part_text binary, lo int, hi int"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(),
             "string": pa.string(), "array<int>": pa.list_(pa.int32()),
             "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def _aligned(docs: DataFrame, a_file: bytes, b_file: bytes, size: int) -> DataFrame:
    """Results of texts of at most ``size`` bytes; the ranges of others, with part numbers."""
    schema = _schema(_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = aligner(a_file, b_file)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b in text_slices(batch.column(1), 1_000_000):
                out: list[dict] = []
                units: dict[int, list[str]] = {}
                for key, text in zip(batch.column(0).slice(a, b - a).to_pylist(),
                                     batch.column(1).slice(a, b - a)):
                    text = text.as_py() or b""
                    shown = " " + text.decode(errors="replace")
                    found = {"row": row, "doc_id": key}
                    row += 1
                    if not text or shown.encode() != b" " + text:
                        out.append(found | finished(_row(False, 0, 0, Fragment())))
                    elif len(text) <= size:
                        units[len(out)] = of.cut(shown)
                        out.append(found)
                    else:
                        cut = ranges(shown, size, of.units)
                        out += [found | {"part": k, "parts": len(cut), "part_text": w.encode(),
                                         "lo": lo, "hi": hi} for k, (w, lo, hi) in enumerate(cut)]
                of.learn([*units.values()])
                for k, u in units.items():
                    out[k] |= short_result(of.of(u))
                yield _table(out, schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        run, _ROWS)


def _long(rows: DataFrame, a_file: bytes, b_file: bytes, fan: int) -> DataFrame:
    """row, doc_id and results of the texts that were cut into ranges (row, part, parts, ...)."""
    keys = "row long, doc_id long, part int, parts int"
    schema = _schema(f"{keys}, {_FRAGMENT}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = aligner(a_file, b_file)
        for batch in batches:
            for r in batch.to_pylist():
                key = {k: r[k] for k in ("row", "doc_id", "part", "parts")}
                yield _table([key | range_fragment(of, r["part_text"].decode(), r["lo"], r["hi"])],
                             schema)

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("part").to_dict("records")
        key = {k: rows[0][k] for k in ("row", "doc_id")}
        key |= {"part": rows[0]["part"] // fan, "parts": -(-rows[0]["parts"] // fan)}
        return pd.DataFrame([key | together(rows)])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.name for f in _schema(f"row long, doc_id long, {_RESULT}")]
        for frame in batches:
            done = [{"row": r["row"], "doc_id": r["doc_id"]} | finished(r)
                    for r in frame.to_dict("records")]
            yield pd.DataFrame(done, columns=names)

    level = settled(rows.repartition("row", "part").mapInArrow(read, f"{keys}, {_FRAGMENT}"))
    while (level.agg(F.max("parts")).first()[0] or 0) > 1:
        level = settled(level.groupBy("row", F.floor(F.col("part") / fan)).applyInPandas(
            compose, f"{keys}, {_FRAGMENT}"))
    return level.mapInPandas(finish, f"row long, doc_id long, {_RESULT}")


def alignments(docs: DataFrame, a_path: str, b_path: str, size: int = RANGE,
               fan: int = FAN) -> DataFrame:
    """One row per row of ``docs``: row (a number of its own), doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256, codes (A's id * 2**32 + B's id, ascending) and times (links of each).

    ``a_path`` is a byte-level vocabulary of the tokenizers library, given a space and the text;
    ``b_path`` one of sentencepiece, which adds that space itself. Texts that are null, empty or
    not given back byte for byte by both have no tokens. Repeated rows are worked on each, rows
    without doc_id too. No rows give no rows; other columns, whatever their names, are not read.
    The table is written out: its row numbers stay.
    """
    with open(a_path, "rb") as f, open(b_path, "rb") as g:
        a_file, b_file = f.read(), g.read()
    rows = settled(_aligned(docs, a_file, b_file, size))
    names = [f.name for f in _schema(f"row long, doc_id long, {_RESULT}")]
    short, cut = rows.filter("part is null").select(names), rows.filter("part is not null")
    return short.unionAll(settled(_long(
        cut.select("row", "doc_id", "part", "parts", "part_text", "lo", "hi"), a_file, b_file, fan)))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """code, n (texts that hold the pair linked), best (no other pair of A's id has more)."""
    counts = settled(aligned.select(F.explode("codes").alias("code")).groupBy("code").agg(
        F.count("*").alias("n")))
    of = F.shiftright("code", 32)
    most = counts.groupBy(of.alias("a")).agg(F.max("n").alias("most"))
    return counts.join(most, of == most["a"]).select("code", "n", (F.col("n") == F.col("most"))
                                                     .alias("best"))


def aligned_tokens(docs: DataFrame, a_path: str, b_path: str, size: int = RANGE,
                   fan: int = FAN) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256; ``alignments`` says how nulls, empty texts, repeats and no rows count.

    The counts of pairs are sent to every executor only if they were counted and found few;
    otherwise they are joined by pair.
    """
    found = alignments(docs, a_path, b_path, size, fan)
    counts = small_side(pair_counts(found))
    links = found.select(F.col("row").alias("of"), F.explode(F.arrays_zip("codes", "times"))
                         .alias("link")).select("of", "link.codes", "link.times")
    sums = links.join(counts, links["codes"] == counts["code"]).groupBy("of").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    none = F.lit(0).cast("long")
    return found.join(sums, found["row"] == sums["of"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")

import math
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from quire.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def own(text):
    return np.frombuffer(packing.word_ids(open(PATH, "rb").read()).encode(text.encode()), "<u4").tolist()


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="abzéÀñ'.,!?sdtmlvre<|>/-_()3 \n ç　", max_size=30)
       | st.text(max_size=20))
def test_ids_as_the_library(text):
    assert own(text) == library(text)


def test_special_strings_and_slices(monkeypatch):
    for text in ("<|endoftext|>a <|startoftext|>", "it's 'll DON'T", "Σας İx ß ﬁ Å", "a\x1cb\x85c"):
        assert own(text) == library(text)
    long = "Some words, in a row. " * 200
    monkeypatch.setattr(packing, "_SLICE", 50)
    assert own(long) == library(long)


def check(rows, docs, length=4096):
    want = {}
    for i, t in docs:
        x = library(t or "") + [1]
        for k in range(0, len(x), length):
            part = np.array(x[k:k + length], "<u4").tobytes()
            key = (i, k // length, k, len(part) // 4, zlib.crc32(part))
            want[key] = want.get(key, 0) + 1
    got = {}
    for r in rows:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
    assert got == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return len(sequences), math.ceil(sum(r.length for r in rows) / length)


def test_samples(sample, odd_docs, no_docs):
    for docs in (sample[0], odd_docs):
        rows = packing.packed_documents(docs, PATH).collect()
        used, bound = check(rows, [(r.doc_id, r.text)
                                   for r in docs.select("doc_id", "text").collect()])
        assert used <= bound * 1.05 + 1
    assert packing.packed_documents(no_docs, PATH).collect() == []


def test_groups_have_numbers_of_their_own(sample, monkeypatch):
    cut = packing.pieces(sample[0], PATH).cache()
    rows = packing.packed(cut, group=20).collect()
    check(rows, [(r.doc_id, r.text) for r in sample[0].collect()])


def test_sequences_hold_the_ids(sample):
    docs = sample[0].limit(40).cache()
    rows = packing.sequences(docs, PATH).collect()
    assert all(len(r.ids) == r.n_tokens <= 4096 for r in rows)
    tokens = sorted(x for r in rows for x in r.ids)
    assert tokens == sorted(x for r in docs.collect() for x in library(r.text) + [1])


def sum_of_squares_by_trial(lengths, room):
    """Tries every open sequence and a new one; among equals the fullest."""
    fills, out = [], []

    def squares(levels):
        open_ = [f for f in levels if f < room]
        return sum(open_.count(f) ** 2 for f in set(open_))

    for s in lengths:
        best = None
        for k in [*range(len(fills)), None]:
            fill = fills[k] if k is not None else 0
            if k is not None and (fill + s > room or fill == room):
                continue
            after = [f for j, f in enumerate(fills) if j != k] + [fill + s]
            rank = (squares(after), -fill)
            if best is None or rank < best[0]:
                best = (rank, k)
        k = best[1]
        out.append(fills[k] if k is not None else 0)
        if k is None:
            fills.append(s)
        else:
            fills[k] += s
    return out, fills


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=25))
def test_rule_against_trial(lengths):
    where, offset = packing.sum_of_squares(np.array(lengths, np.int64), 12)
    want, fills = sum_of_squares_by_trial(lengths, 12)
    assert offset.tolist() == want
    total = np.bincount(where, np.array(lengths, float), len(fills)) if lengths else []
    assert sorted(total) == sorted(fills)

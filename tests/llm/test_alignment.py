import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from quire.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Groups of a text from the tokenizers' ids of the whole text."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    spare = iter(range(256, 512))
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    byte = {chr(i if i in shown else next(spare)): i for i in range(256)}

    def groups(text):
        if not text:
            return []
        x = a.encode(" " + text, add_special_tokens=False).ids
        y = b.encode(text)
        p = [bytes(byte[c] for c in a.id_to_token(i)) for i in x]
        q = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
             else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not b"".join(p) == b"".join(q) == (" " + text).encode():
            return []
        ends = [set(np.cumsum([*map(len, z)]).tolist()) for z in (p, q)]
        out, i, j, m, n = [([], [])], 0, 0, 0, 0
        for end in sorted(ends[0] | ends[1]):
            if end in ends[0]:
                out[-1][0].append(x[i])
                i += 1
            if end in ends[1]:
                out[-1][1].append(y[j])
                j += 1
            if end in ends[0] and end in ends[1]:
                out.append(([], []))
        return out[:-1]

    return groups


def plain_rows(texts, groups):
    """Rows without doc_id, by counting over all texts."""
    found = [groups(t) for t in texts]
    links = [collections.Counter((x, y) for a, b in g for x in a for y in b) for g in found]
    count = collections.Counter(p for one in links for p in one)
    most = collections.Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    rows = []
    for g, one in zip(found, links):
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        rows.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g),
                     sum(one.values()), sum(n for p, n in one.items() if count[p] == most[p[0]]),
                     sum(n * count[p] for p, n in one.items()),
                     hashlib.sha256(told.encode()).hexdigest() if g else ""))
    return rows


ODD = ["", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "a\n b \n", "a \n\n  b\t\tc\r\n",
       "one two　three   four", "▁ mark", "x▁y", "<|endoftext|> <s> </s> <unk>",
       "<0x0A> \x00\x01\x1c z", "a\x1c b \x85 c", "日本語 の 文章です\n次の行", "é é ﬁ \U0001f642\U0001f642 ñ",
       "{\r\n};\r\n\t\t}\r", "don't  we'll 12345 6 7.89", "a" * 3000, "ab " * 200 + "\n\n" + "x" * 99]


def mixed(rng, n):
    marks = ["a", "b", "word", "thing", " ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "é", "日本", "1",
             "2024", "'s", ".", ", ", " ", "\U0001f642", "ing", "<s>", "-", "\x1c", "́"]
    return "".join(rng.choice(marks) for _ in range(n))


def test_texts_against_whole_encoding(spark, plain):
    rng = random.Random(4)
    texts = ODD + [mixed(rng, rng.choice([3, 10, 40, 300])) for _ in range(60)]
    texts += ["   ".join(texts), "".join(texts[:50])]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    want = dict(enumerate(plain_rows(texts, plain)))
    for size, fan in ((10 ** 6, 16), (7, 8), (400, 3)):
        got = alignment.aligned_tokens(docs, A, B, size, fan).collect()
        assert {r[0]: tuple(r[1:]) for r in got} == want
        assert len(got) == len(texts)
    assert sum(r[0] > 0 for r in want.values()) > 60


def test_documents(spark, sample, plain):
    docs = sample[0]
    rows = docs.orderBy("doc_id").collect()
    want = plain_rows([r.text for r in rows], plain)
    got = {r[0]: tuple(r[1:]) for r in alignment.aligned_tokens(docs, A, B).collect()}
    assert got == {r.doc_id: w for r, w in zip(rows, want)}


def test_pairs_joined_without_broadcast(spark, sample, monkeypatch):
    docs = sample[0]
    want = sorted(map(tuple, alignment.aligned_tokens(docs, A, B).collect()))
    whole = alignment.small_side
    monkeypatch.setattr(alignment, "small_side", lambda rows: whole(rows, 0))
    assert sorted(map(tuple, alignment.aligned_tokens(docs, A, B).collect())) == want


def test_fragments_are_a_monoid():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a_ends = np.unique(np.append(rng.integers(1, n + 1, 20), n))
        b_ends = np.unique(np.append(rng.integers(1, n + 1, 8), n))
        a, b = rng.integers(0, 9, len(a_ends)), rng.integers(0, 9, len(b_ends))
        cuts = sorted({0, n, *rng.integers(0, n + 1, 4).tolist()})
        parts = []
        for lo, hi in zip(cuts, cuts[1:]):
            x, y = (a_ends > lo) & (a_ends <= hi), (b_ends > lo) & (b_ends <= hi)
            parts.append(alignment.fragment(a[x], a_ends[x], b[y], b_ends[y]))
        whole = alignment.fragment(a, a_ends, b, b_ends)
        left = alignment.Fragment()
        for p in parts:
            left = alignment.composed(left, p)
        right = alignment.Fragment()
        for p in reversed(parts):
            right = alignment.composed(p, right)
        assert left == right == whole


def test_ranges_cover_the_text():
    rng = random.Random(9)
    for _ in range(200):
        text = " " + mixed(rng, 200)
        size = rng.choice([1, 5, 30])
        cut = alignment.ranges(text, size, True)
        assert b"".join(w.encode()[lo:hi] for w, lo, hi in cut) == text.encode()
        assert all("".join(alignment.Aligner._unit.findall(w)) == w for w, _, _ in cut)


def test_odd_rows(spark, odd_docs, no_docs, plain):
    rows = odd_docs.select("doc_id", "text").collect()
    want = plain_rows([r.text for r in rows], plain)
    got = alignment.aligned_tokens(odd_docs, A, B)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(
        str((r.doc_id, *w)) for r, w in zip(rows, want))
    assert alignment.aligned_tokens(no_docs, A, B).collect() == []
    bad = spark.sql("select 1L as doc_id, cast(x'61ff62' as string) as text")
    assert [tuple(r) for r in alignment.aligned_tokens(bad, A, B).collect()] == [
        (1, 0, 0, 0, 0, 0, 0, "")]

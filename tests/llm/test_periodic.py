import hashlib
import random
import zlib

import numpy as np
import pytest

from quire.llm import periodic


def plain_runs(words):
    """All runs by comparing every word with the one a period later."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                found.setdefault((s, i + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    kept = [True] * n
    for s, length, q in found:
        kept[s + q:s + length] = [False] * (length - q)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found).encode()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            hashlib.sha256(lines).hexdigest(),
            hashlib.sha256(b" ".join(w for w, k in zip(words, kept) if k)).hexdigest())


def periodic_words(rng, letters, n):
    """Words with repeated stretches inside repeated stretches."""
    out = []
    while len(out) < n:
        kind = rng.random()
        if kind < 0.3 or not out:
            out += [rng.randrange(letters) for _ in range(rng.randint(1, 30))]
        else:
            size = min(len(out), rng.randint(1, max(1, n // 6)))
            at = rng.randrange(len(out) - size + 1)
            out += (out[at:at + size] * rng.randint(2, 6))[:rng.randint(size, 6 * size)]
    return [b"%d" % w for w in out[:n]]


@pytest.mark.parametrize("letters", [1, 2, 3, 50, 10 ** 6])
def test_runs_against_all_periods(letters):
    rng = random.Random(letters)
    texts = [periodic_words(rng, letters, rng.choice([0, 1, 5, 6, 7, 8, 31, 32, 33, 100, 400]))
             for _ in range(150)]
    assert periodic.document_runs(texts) == [plain_runs(t) for t in texts]
    if 1 < letters <= 50:
        assert sum(q >= 8 for t in texts for _, _, q in plain_runs(t)) > 3


def test_long_words_and_one_word_only():
    text = [b"a"] * 20_000
    many = [b"%d" % (k % 700) for k in range(9000)]
    assert periodic.document_runs([text, many]) == [[(0, 20_000, 1)], [(0, 9000, 700)]]
    # a short period that the long one holds again and again
    nested = ([b"x"] * 40 + [b"%d" % k for k in range(60)]) * 12
    assert periodic.document_runs([nested]) == [plain_runs(nested)]


def test_chosen_positions_are_consistent_and_dense():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, 4000)
    for width in (8, 16, 64):
        names = periodic._mixed(words.astype(np.uint64))
        for k in range(width.bit_length() - 1):
            names = periodic._doubled(names, 1 << k)
        at = set(periodic.synchronising(names, width).tolist())
        seen = {}
        for i in range(len(words) - 2 * width + 1):
            assert seen.setdefault(words[i:i + 2 * width].tobytes(), i in at) == (i in at)
        assert all(any(j in at for j in range(i, i + width))
                   for i in range(len(words) - 3 * width))


def test_documents(spark, sample):
    docs = sample[0]
    rows = [tuple(r) for r in periodic.run_digests(periodic.planted(docs)).collect()]
    want = [plain_row(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(rows) == sorted(want)
    assert sum(r[1] > 0 for r in rows) > len(rows) / 20


def test_odd_rows(spark, odd_docs, no_docs):
    got = periodic.run_digests(periodic.planted(odd_docs)).collect()
    want = [plain_row(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert periodic.run_digests(periodic.planted(no_docs)).collect() == []
    whole = {r.doc_id: r for r in periodic.periodic_runs(odd_docs).collect()}
    assert whole[5].runs == [] and whole[5].collapsed == b"" and whole[7].n_words == 1

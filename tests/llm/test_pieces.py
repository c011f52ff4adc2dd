import public_tokenizers
import sentencepiece
import xxhash
from hypothesis import given, settings, strategies as st

from quire.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = open(PATH, "rb").read()
VOCABULARY = pieces.Vocabulary(MODEL)
PLAIN = pieces.Encoder(VOCABULARY, 0.0, 1, 1)
DROPPED = pieces.Encoder(VOCABULARY, 0.3, 1, 2)
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def ids(encoder, text, variant=0):
    import numpy as np

    return np.frombuffer(encoder.encode([text], [variant])[0], "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab zéÀ'.,!?  \n\t日ﬁ🙂3<>_\x00theingor", max_size=40))
def test_without_dropout_as_the_library(text):
    assert ids(PLAIN, text.encode()) == LIBRARY.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=30) | st.text(max_size=30).map(str.encode))
def test_any_bytes_come_back(data):
    for encoder in (PLAIN, DROPPED):
        assert VOCABULARY.decode(ids(encoder, data)) == data


def test_dropout_is_seeded_and_varied():
    text = b"international understanding of extraordinary circumstances"
    a, b = ids(DROPPED, text, 0), ids(DROPPED, text, 1)
    assert a == ids(pieces.Encoder(VOCABULARY, 0.3, 1, 2), text, 0)
    assert a != b
    assert a != ids(pieces.Encoder(VOCABULARY, 0.3, 2, 2), text, 0)
    assert len(a) > len(ids(PLAIN, text))
    everything = ids(pieces.Encoder(VOCABULARY, 1.0, 1, 1), b"abc")
    assert [VOCABULARY.bytes_of[i] for i in everything] == [b" ", b"a", b"b", b"c"]


def agenda_by_scan(text, rate, key):
    """The same merges by looking for the best remaining candidate each time."""
    parts, places, skipped = list(text), list(range(len(text))), set()
    state = xxhash.xxh64_intdigest(text.encode(), key)
    while True:
        best = None
        for k in range(len(parts) - 1):
            made = VOCABULARY.ids.get(parts[k] + parts[k + 1])
            if made is None or (places[k], places[k + 1], made) in skipped:
                continue
            rank = (-VOCABULARY.scores[made], places[k])
            if best is None or rank < best[0]:
                best = (rank, k, made)
        if best is None:
            return [i for p in parts
                    for i in ([VOCABULARY.ids[p]] if p in VOCABULARY.ids else VOCABULARY.spelled(p))]
        _, k, made = best
        dice = state ^ (places[k] * 0x9E3779B97F4A7C15) ^ (made * 0xD1B54A32D192ED03)
        if dice * 0xBF58476D1CE4E5B9 % 2 ** 64 >> 32 < int(rate * 2 ** 32):
            skipped.add((places[k], places[k + 1], made))
            continue
        parts[k:k + 2] = [parts[k] + parts[k + 1]]
        del places[k + 1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="▁theingorasd.é\n日", min_size=1, max_size=40), max_size=20),
       st.integers(0, 99))
def test_many_runs_as_each_alone(runs, key):
    for rate in (0.0, 0.1, 0.5, 1.0):
        assert VOCABULARY.merge_many(runs, rate, key) == [
            VOCABULARY.merge(x, rate, key) for x in runs]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="▁theingorasd", min_size=1, max_size=14), st.integers(0, 99))
def test_agenda_against_scan(text, key):
    for rate in (0.1, 0.5):
        want = agenda_by_scan(text, rate, key)
        assert VOCABULARY.merge(text, rate, key) == want


def test_frames(odd_docs, no_docs):
    out = pieces.encoded(odd_docs, PATH)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and all(r.lossless for r in rows)
    assert all(r.n_pieces == len(r.ids) for r in rows)
    empty = [r for r in rows if r.doc_id in (4, 5)]
    assert [r.ids for r in empty] == [[], []]
    twice = [r for r in rows if r.doc_id == 1]
    assert twice[0] == twice[1]
    back = {r.doc_id: r.text for r in pieces.decoded(out, PATH).collect()}
    for r in odd_docs.filter("doc_id is not null").collect():
        assert back[r.doc_id] == (r.text or "")
    assert pieces.encoded(no_docs, PATH).collect() == []

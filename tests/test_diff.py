import random
import time

import pytest

from quire.operators import compare


def walked(a, b):
    """The full table, walked back from the end; ties take the insertion."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            t[i][j] = t[i - 1][j - 1] + 1 if x == y else max(t[i - 1][j], t[i][j - 1])
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            op, token, i, j = "equal", a[i - 1], i - 1, j - 1
        elif i == 0 or (j and t[i][j - 1] >= t[i - 1][j]):
            op, token, j = "insert", b[j - 1], j - 1
        else:
            op, token, i = "delete", a[i - 1], i - 1
        if out and out[-1][0] == op:
            out[-1][1].insert(0, token)
        else:
            out.append((op, [token]))
    return [(op, "".join(x)) for op, x in reversed(out)]


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "abcdefghijklmnop"])
def test_both_ways_equal_the_table(letters):
    rng = random.Random(len(letters))
    for _ in range(400):
        a = [rng.choice(letters) for _ in range(rng.randint(0, 30))]
        b = list(a) if rng.random() < 0.5 else [rng.choice(letters) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            b[at:at + rng.randint(0, 2)] = [rng.choice(letters) for _ in range(rng.randint(0, 3))]
        want = walked(a, b)
        assert compare.diff_runs(a, b) == want
        assert compare.diff_runs(a, b, 0) == want


def test_rows_made_again():
    """More edits than rows that are kept at a time."""
    rng = random.Random(3)
    a = [rng.choice("abcdefgh") for _ in range(600)]
    b = [rng.choice("abcdefgh") if rng.random() < 0.2 else x for x in a]
    want = compare.diff_runs(a, b)
    assert want == walked(a, b) == compare.diff_runs(a, b, 0)


def test_long_texts_with_few_changes():
    rng = random.Random(4)
    a = [f"w{rng.randrange(5000)} " for _ in range(200_000)]
    b = list(a)
    for at in rng.sample(range(len(b)), 300):
        b[at] = "new "
    started = time.time()
    runs = compare.diff_runs(a, b)
    assert time.time() - started < 30
    assert "".join(t for op, t in runs if op != "insert") == "".join(a)
    assert "".join(t for op, t in runs if op != "delete") == "".join(b)
    assert sum(t.count(" ") for op, t in runs if op != "equal") <= 600


def test_long_texts_without_a_common_token():
    a, b = ["a"] * 3000, ["b"] * 3000
    assert compare.diff_runs(a, b, 0) == compare.diff_runs(a, b) == [
        ("delete", "a" * 3000), ("insert", "b" * 3000)]


def test_long_texts_with_little_in_common():
    """Their whole table has 900 million cells."""
    rng = random.Random(5)
    a, b = ([f"w{int(rng.paretovariate(0.7)) % 3000} " for _ in range(30_000)] for _ in range(2))
    started = time.process_time()
    runs = compare.diff_runs(a, b)
    assert time.process_time() - started < 8
    assert "".join(t for op, t in runs if op != "insert") == "".join(a)
    assert "".join(t for op, t in runs if op != "delete") == "".join(b)

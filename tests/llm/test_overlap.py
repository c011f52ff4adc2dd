import time

import numpy as np

from quire.llm import overlap


def plain(cell, component, n, bits, share, most):
    """The nearest sets of each set of a cell, one after the other."""
    out = {}
    for i in range(len(n)):
        far = np.bitwise_count(bits ^ bits[i]).sum(axis=1, dtype=np.int64)
        hits = [k for k in range(len(n)) if cell[k] == cell[i] and component[k] != component[i]
                and 100 * min(n[k], n[i]) >= share * max(n[k], n[i])
                and (100 + share) * far[k] <= (100 - share) * (n[k] + n[i])]
        for k in sorted(hits, key=lambda k: far[k])[:most]:
            pair = (min(i, k), max(i, k))
            out[pair] = out.get(pair, False) or len(hits) > most
    return out


def test_pairs_of_cells():
    rng = np.random.default_rng(1)
    for most in (1, 2, 5, 100):
        cell = np.repeat(np.arange(12), rng.integers(2, 30, 12))
        base = rng.integers(0, 2 ** 63, (3, 8)).astype(np.uint64)
        bits = base[rng.integers(0, 3, len(cell))] ^ (
            np.uint64(1) << rng.integers(0, 63, (len(cell), 8)).astype(np.uint64))
        n, component = rng.integers(100, 140, len(cell)), rng.integers(0, 20, len(cell))
        a, b, more = overlap.near_pairs(cell, component, n, bits, 80, most)
        assert dict(zip(zip(a.tolist(), b.tolist()), more.tolist())) == plain(
            cell, component, n, bits, 80, most)


def test_small_cells_side_by_side():
    """Many cells of few sets do not take calls of their own."""
    rng = np.random.default_rng(2)
    cell = np.repeat(np.arange(50_000), 2)
    bits = rng.integers(0, 2 ** 63, (len(cell), 8)).astype(np.uint64)
    n = rng.integers(50, 500, len(cell))
    began = time.perf_counter()
    a, b, _ = overlap.near_pairs(cell, np.arange(len(cell)), n, bits, 85, 4)
    assert len(a) == len(b) < len(cell) and time.perf_counter() - began < 1

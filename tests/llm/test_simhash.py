import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quire.llm import components, simhash


def print_of(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values, distance=4):
    top = list(range(len(values)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return [find(x) for x in range(len(values))]


def compare(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    ids = sorted({(i, print_of(t)) for i, t in rows if i is not None})
    group = linked([p for _, p in ids])
    least = {}
    for (i, _), g in zip(ids, group):
        least[g] = min(least.get(g, i), i)
    of = {p: least[g] for (_, p), g in zip(ids, group)}
    want = sorted((str(i), f"{print_of(t):016x}", str(of.get(print_of(t)))) for i, t in rows)
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id))
                 for r in simhash.near_duplicates(docs).collect())
    assert got == want


def test_against_brute_force(odd_docs, sample):
    compare(odd_docs)
    compare(sample[0])


def test_long_texts_are_counted_in_blocks(monkeypatch):
    text = " ".join(str(k % 997) for k in range(5000))
    monkeypatch.setattr(simhash, "_HASHES", 7)
    assert simhash.fingerprint(simhash.shingle_hashes(text.encode())) == print_of(text)


def clustered(seed, n):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = set()
    while len(out) < n:
        p = rng.choice(centres)
        for _ in range(rng.randint(0, 9)):
            p ^= 1 << rng.randrange(64)
        out.add(p)
    return sorted(out)


def test_links_of_crowded_buckets(spark):
    values = clustered(2, 900)
    rows = [(p - 2 ** 64 if p >= 2 ** 63 else p, k) for k, p in enumerate(values)]
    classes = spark.createDataFrame(rows, "print long, node long")
    want = {}
    for k, g in enumerate(linked(values)):
        want.setdefault(g, set()).add(k)
    for n, members in ((900, 1000), (900, 7), (10 ** 9, 20)):
        links = simhash.near_links(classes, n, members).cache()
        for r in links.distinct().collect():
            assert (values[r.u] ^ values[r.v]).bit_count() <= 4
        found = {k: k for k in range(900)}
        found |= {r.node: r.component for r in components.components(links).collect()}
        got = {}
        for k, g in found.items():
            got.setdefault(g, set()).add(k)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
        assert links.count() < 16 * 900 * (1 if members == 1000 else 40)


def test_every_pair_within_the_distance_shares_a_name():
    from quire.llm.common import pigeonhole_masks

    rng = random.Random(1)
    for blocks in (6, 7, 9):
        masks = pigeonhole_masks(64, blocks, 4)
        for _ in range(500):
            flips = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(flips & m == 0 for m in masks)


def test_forest():
    values = np.array(clustered(3, 200), np.uint64)
    a, b = simhash.forest(values)
    assert len(a) == 200 - len(set(linked([int(v) for v in values])))
    assert all(int(values[x] ^ values[y]).bit_count() <= 4 for x, y in zip(a, b))


def test_components_of_chains(spark):
    rng = random.Random(4)
    names = list(range(300))
    rng.shuffle(names)
    edges = [(names[k], names[k + 1]) for k in range(299) if k % 50] + [(7, 7)]
    links = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in components.components(links).collect()}
    for k in range(0, 300, 50):
        part = names[k + 1:k + 51] if k < 250 else names[k + 1:]
        assert {got[x] for x in part} == {min(part)}
    assert components.components(links.limit(0)).collect() == []


def test_one_of_each(odd_docs, no_docs):
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = simhash.near_duplicates(odd_docs).collect()
    # the text that only a row without doc_id has stays, copies without one and repeated rows go
    want = sorted([*{str(r.doc_id) for r in rows
                     if r.doc_id is not None and r.doc_id == r.component_id}, "None"])
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    assert simhash.near_duplicates(no_docs).collect() == []
    assert simhash.one_of_each(no_docs).collect() == []


def test_large_group_of_copies(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(
        F.col("id") % 2 == 0, F.lit("one two three four five")).otherwise(
        F.concat_ws(" ", F.col("id"), F.col("id") * 7, F.col("id") * 3)).alias("text"))
    out = simhash.near_duplicates(docs)
    assert out.filter("component_id = 0").count() >= 1500

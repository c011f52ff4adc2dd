import random
import re

from quire.llm import lines

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(rows, words):
    """Lines of every run of at least ``words`` words that has an earlier copy."""
    docs = {}
    for i, t in rows:
        docs[i, t or ""] = [x for x in (t or "").split("\n") if WORD.search(x)]
    order = sorted(docs, key=lambda k: (k[0] is None, k[0] or 0, k[1]))
    first, gone = {}, {k: set() for k in docs}
    for place, k in enumerate(order):
        for i in range(len(docs[k])):
            n = 0
            for j in range(i, len(docs[k])):
                n += len(WORD.findall(docs[k][j]))
                if n >= words:
                    run = tuple(docs[k][i:j + 1])
                    if first.setdefault(run, (place, i)) != (place, i):
                        gone[k] |= set(range(i, j + 1))
    out = []
    for i, t in rows:
        k, n, text = (i, t or ""), 0, []
        for x in (t or "").split("\n"):
            if not WORD.search(x):
                text.append(x)
            else:
                if n not in gone[k]:
                    text.append(x)
                n += 1
        out.append((str(i), n, sorted(gone[k]), "\n".join(text)))
    return sorted(out)


def compare(docs, words):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((str(r.doc_id), r.n_lines, list(r.removed), r.clean_text)
                 for r in lines.without_repeated_runs(docs, words).collect())
    assert got == brute(rows, words)
    return got


def test_against_brute_force(spark):
    rng = random.Random(11)
    pool = [" ".join("abcdefg"[rng.randrange(7)] for _ in range(rng.randint(1, 6)))
            for _ in range(14)]
    rows = []
    for i in range(60):
        text = [rng.choice(pool) for _ in range(rng.randint(0, 12))]
        text = [x if rng.random() > 0.1 else "" for x in text]
        rows.append((i, "\n".join(text)))
    rows.append((60, "\n".join(["x y z"] * 40)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for words in (1, 6, 10):
        assert any(r[2] for r in compare(docs, words))


def test_long_runs_and_ragged_ends(spark):
    passage = [f"line {k} of the passage" for k in range(20)]
    rows = [(1, "\n".join(["first", *passage, "end"])),
            (2, "\n".join(["other", *passage, "else"])),
            (3, "\n".join(passage[3:12])), (4, "\n".join(passage[:9] + ["break"] + passage[9:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r[0]: r for r in compare(docs, 50)}
    assert out["1"][2] == [] and out["2"][2] == list(range(1, 21))
    assert out["2"][3] == "other\nelse" and out["3"][2] == []  # 45 words


def test_samples(sample):
    compare(sample[0], 50)


def test_odd_rows(odd_docs, no_docs):
    compare(odd_docs.filter("doc_id is null or doc_id <> 10"), 50)
    out = lines.without_repeated_runs(odd_docs).collect()
    assert len(out) == odd_docs.count()
    assert all(r.n_lines == 0 for r in out if r.doc_id in (4, 5, 6))
    assert lines.without_repeated_runs(no_docs).collect() == []


def test_ranks_are_those_of_the_sorted_suffixes(spark):
    rows = [(1, "a\nb\na\nb\na"), (2, "a\nb\nc\na\nb\na\nb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    levels = lines.suffix_ranks(docs, 4)
    assert len(levels) == 3
    keys = {}
    for r in docs.select("doc_id", lines.document_key(docs).alias("k")).collect():
        keys[r.k] = r.doc_id
    text = {i: t.split("\n") for i, t in rows}
    for reach, level in zip((1, 2, 4), levels):
        groups = {}
        for i, t in text.items():
            for k in range(len(t) - reach + 1):
                groups.setdefault(tuple(t[k:k + reach]), set()).add((i, k))
        want = {frozenset(g) for g in groups.values() if len(g) > 1}
        got = {}
        for r in level.collect():
            got.setdefault(r["rank"], set()).add((keys[r.doc], r.line_no))
        assert {frozenset(g) for g in got.values()} == want
        below = 0
        for rank in sorted(got):  # a group's rank is the number of suffixes before it
            assert rank == below
            below += len(got[rank])


def test_no_python_in_the_plan(odd_docs):
    plan = lines.without_repeated_runs(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

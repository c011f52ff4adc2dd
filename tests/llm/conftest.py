import random

import pytest

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
#: extra columns named like the operators' own
CLASH = ["print", "rank", "row", "kept", "keep_id", "group_size", "score", "line_verdict", "part",
         "n", "words", "sha", "component", "component_id", "fingerprint", "held_out", "removed",
         "gone", "gone_id", "key", "every", "ids", "variant", "filter", "verdict"]


def prose(seed, n, words=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 8)))
                  for _ in range(words)]
    out = []
    for i in range(n):
        w = rng.choice(vocabulary)
        out.append(w.capitalize() if i % 9 == 0 else w + ("." if i % 9 == 8 else ""))
    return " ".join(out)


def odd_rows():
    long = "\n".join(prose(k, 400) for k in range(100))
    rows = [
        (1, prose(1, 120), "en", "a"), (2, prose(1, 120), "de", None), (3, prose(2, 80), None, "a"),
        (4, None, "en", "a"), (5, "", "en", "a"), (6, " \n\t \n", None, None), (7, "word", "en", ""),
        (8, prose(8, 60) + "\n" + prose(9, 70), "fr", "b"), (9, prose(9, 70), "fr", "b"),
        (10, long, "en", "a"), (11, "é ß İ 日本 ▁ \x0b \x85 ﬁ \U0001f642" * 3, "es", "c"),
        (12, prose(1, 120).replace(" a", " a", 1), "en", "a"),
        (None, prose(1, 120), "en", "a"), (None, prose(77, 60), None, None), (None, None, None, None),
        (1, prose(1, 120), "en", "a"),
    ]
    return [(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows]


@pytest.fixture(scope="session")
def odd_docs(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_rows(), FIELDS)
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASH})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], FIELDS)


@pytest.fixture(scope="session")
def sample(spark):
    """Documents and labels of the smallest tables."""
    root = "/root/testdata/sf0.001"
    return (spark.read.parquet(f"{root}/documents.parquet"),
            spark.read.parquet(f"{root}/labels.parquet"))

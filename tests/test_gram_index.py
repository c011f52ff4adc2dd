import random

from pyspark.sql import functions as F

from quire.operators import gram_index
from quire.operators.gram_index import GramIndex
from quire.plans.durable import settled


def plain(texts, queries):
    out = set()
    for doc, text in texts:
        words = (text or "").lower().split()
        for q, query in queries:
            needles = query.lower().split()
            n = len(needles)
            for at in range(len(words) - n + 1):
                part = words[at:at + n]
                if n == 1 and needles[0] in part[0] or n > 1 and (
                        part[0].endswith(needles[0]) and part[1:-1] == needles[1:-1]
                        and part[-1].startswith(needles[-1])):
                    out.add((q, doc, at))
    return out


def random_texts(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "beta", "alphabet", "be", "a", "Gamma", "gam", "ma", "é", "日本語", "x.y", "(alpha)"]
    return [(k, rng.choice([" ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 30))))
            for k in range(n)] + [(n, None), (n + 1, ""), (n + 2, " \n ")]


QUERIES = [(1, "alpha"), (2, "A"), (3, "bet"), (4, "alpha beta"), (5, "ha be g"), (6, "  "), (7, "zzz"),
           (8, "beta zzz"), (9, "日本"), (10, "a a"), (11, "pha\nalpha  alp"), (12, "é"), (13, "")]


def test_search_against_brute_force(spark, tmp_path):
    texts = random_texts(1, 60)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    index = GramIndex(spark, f"{tmp_path}/i")
    for batch in range(3):
        for _ in range(2):  # a repeated batch counts once
            index.add(docs.where(F.col("doc_id") % 3 == batch), batch)
    queries = spark.createDataFrame(QUERIES, "query_id int, query string")
    got = [tuple(r) for r in index.search(queries).collect()]
    assert sorted(got) == sorted(plain(texts, QUERIES)) and len(got) > 100


def test_many_values_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(gram_index, "WRITTEN", 3)
    texts = random_texts(2, 30)
    index = GramIndex(spark, f"{tmp_path}/i")
    index.add(spark.createDataFrame(texts, "doc_id long, text string"), 0)
    queries = spark.createDataFrame(QUERIES, "query_id int, query string")
    assert {tuple(r) for r in index.search(queries).collect()} == plain(texts, QUERIES)


def test_only_the_asked_row_groups_are_read(spark, tmp_path):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("w"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("text"))
    index = GramIndex(spark, f"{tmp_path}/i")
    index.add(docs, 0)
    wanted = spark.createDataFrame([("w000123",), ("w019999",)], "word string")
    rows = gram_index.one_of(index.words.read(), "word", wanted)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(word" in plan or "PushedFilters: [Or" in plan
    assert rows.count() == 2
    found = index.search(spark.createDataFrame([(1, "w01234")], "query_id int, query string"))
    assert found.count() == 10


def test_other_words_are_read_for_candidates_alone(spark, tmp_path, monkeypatch):
    """Phrases of frequent words around one rare word make no row for each frequent occurrence."""
    texts = [(k, " ".join(["oft"] * 200)) for k in range(50)] + [(50, "oft oft rare oft oft")]
    index = GramIndex(spark, f"{tmp_path}/i")
    index.add(spark.createDataFrame(texts, "doc_id long, text string"), 0)
    words = index.words.read()
    assert words.where("word = 'oft'").count() < 50  # a row a block
    written = []
    monkeypatch.setattr(gram_index, "settled", lambda rows: written.append(rows) or settled(rows))
    found = index.search(spark.createDataFrame([(1, "oft oft rare oft oft")], "query_id int, query string"))
    assert [tuple(r) for r in found.collect()] == [(1, 50, 0)]
    assert max(rows.count() for rows in written) < 100

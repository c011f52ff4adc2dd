import re

import pytest

from quire.llm import quality

WORD = re.compile("[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, covered = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered), base)


def test_counts_against_brute_force(odd_docs, sample):
    for docs in (odd_docs, sample[0]):
        want = sorted(((r.doc_id is None, r.doc_id or 0) + counts(r.text))
                      for r in docs.select("doc_id", "text").collect())
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols,
                      r.n_dup_lines, r.n_repeat_words, r.base_failed)
                     for r in quality.line_quality(docs).collect())
        assert got == want


@pytest.mark.parametrize("line, rule", [
    ("", None), (" \t", None), ("A plain sentence, with a few words.", None), ("Of.", None),
    ("Home | News | Sport | Weather", "navigation"), ("  Next page ", "navigation"),
    ("Read more", "navigation"), ("We read more than one book.", None),
    ("WORD!! WORD!! WORD!! WORD!! WORD!! WORD!!", "punctuation"),
    ("a### b$$$ c%%% d&&& e***", "punctuation"), ("-----------", "punctuation"),
    ("one two three four five six seven eight nine ten eleven twelve", "punctuation"),
    ("one two three four five six, seven eight nine ten eleven twelve", None),
    ("Copyright 2020 Someone, all rights reserved.", "boilerplate"),
    ("This site uses cookies to work.", "boilerplate"),
    ("© 2021 Éditions X. TOUS DROITS RÉSERVÉS.", "boilerplate"),
    ("Alle Rechte vorbehalten, Verlag X.", "boilerplate"),
    ("Este sitio utiliza cookies.", "boilerplate"), ("Lire la suite", "navigation"),
    ("S'inscrire", "navigation"), ("» Nächste Seite", "navigation"), ("Página anterior", "navigation"),
    ("Die nächste Seite ist leer.", None),
    ("A law on any privacy policy was passed last week, after two years of talks in both houses.", None),
    ("Le débat sur les mentions légales a duré trois heures, sans le moindre résultat pour eux.", None),
])
def test_rules(spark, line, rule):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(line,)], "x string").select(quality.failed_rule(F.col("x")))
    assert got.first()[0] == rule


def test_failed_lines_go_first_and_decide(spark):
    good = "\n".join(" ".join(f"{w}{k}{j}" for j, w in enumerate("some words in a row".split() * 3))
                     + "." for k in range(9))
    menu = "Home | News | Sport | Weather\n"
    docs = spark.createDataFrame(
        [(1, menu + good, 7), (2, menu * 30 + good, None), (3, good, 1)],
        "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in quality.line_quality(docs).collect()}
    assert out[1].clean_text == good and out[1].n_navigation == 1 and out[1].kept
    assert out[2].clean_text == good and not out[2].kept
    kept = {r.doc_id: r for r in quality.clean_documents(docs).collect()}
    assert sorted(kept) == [1, 3]
    assert kept[1].text == good and kept[1].n_chars == len(good) and kept[3].text == good


def test_a_long_line_may_name_a_phrase(spark):
    text = " ".join(f"word{k}" + "," * (k % 9 == 0) for k in range(200)) + " and the privacy policy of the shop."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert quality.clean_documents(docs).first().text == text


def test_odd_rows(odd_docs, no_docs):
    out = quality.line_quality(odd_docs).collect()
    assert len(out) == odd_docs.count()
    assert all(r.base_failed and not r.kept for r in out if r.doc_id in (4, 5, 6, 7))
    kept = quality.clean_documents(odd_docs)
    assert kept.columns == odd_docs.columns and kept.dtypes == odd_docs.dtypes
    assert {r.line_verdict for r in kept.collect()} == {"own line_verdict"}
    want = sorted(str(r.doc_id) for r in out if r.kept)
    assert sorted(str(r.doc_id) for r in kept.collect()) == want and "1" in want
    assert quality.line_quality(no_docs).collect() == []
    assert quality.clean_documents(no_docs).collect() == []


def test_no_python_in_the_plan(odd_docs):
    plan = quality.line_quality(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan

import random

import pytest

from quire.llm import licences

SCANNER = licences.Scanner()


def notices(text):
    return sorted((n["license"], text[n["begin"]:n["end"]], n["differences"])
                  for n in SCANNER.notices(text))


@pytest.mark.parametrize("k", range(len(licences.TEMPLATES)))
def test_every_template_is_found_in_prose(k):
    name, text = licences.TEMPLATES[k]
    rng = random.Random(k)
    prose = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300))
    found = notices(f"{prose}\n{text} {prose}")
    assert [(n, d) for n, _, d in found] == [(name, 0)]
    assert found[0][1].split() == text.split()


def test_wording():
    assert notices("The word license alone is no notice.") == []
    assert notices("Licensed under CC BY-NC-SA 4.0.") == []
    assert notices("licensed under the gnu general public license, version 7.") == []
    long = licences.TEMPLATES[3][1].replace("publish, ", "print, ")
    assert [(n, d) for n, _, d in notices(long)] == [("MIT", 1)]


HEADERS = [
    ("GPL-2.0-or-later", """This program is free software; you can redistribute it and/or modify it
 under the terms of the GNU General Public License as published by the Free Software Foundation;
 either version 2 of the License, or (at your option) any later version."""),
    ("GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it
 under the terms of the GNU General Public License as published by the Free Software Foundation,
 either version 3 of the License, or (at your option) any later version."""),
    ("LGPL-2.1-or-later", """This library is free software; you can redistribute it and/or modify it
 under the terms of the GNU Lesser General Public License as published by the Free Software
 Foundation; either version 2.1 of the License, or (at your option) any later version."""),
    ("LGPL-2.0-or-later", """This library is free software; you can redistribute it and/or modify it
 under the terms of the GNU Library General Public License as published by the Free Software
 Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("LGPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it
 under the terms of the GNU Lesser General Public License as published by the Free Software
 Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("AGPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it
 under the terms of the GNU Affero General Public License as published by the Free Software
 Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the
 terms of the GNU General Public License version 2 as published by the Free Software Foundation."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the
 terms of the GNU General Public License as published by the Free Software Foundation, version 3."""),
    ("AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the
 terms of the GNU Affero General Public License as published by the Free Software Foundation,
 version 3 of the License."""),
    ("GPL-2.0-only", """This program is free software; you can redistribute it and/or modify it under
 the terms of the GNU General Public License as published by the Free Software Foundation; version 2
 only."""),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("EPL-2.0", """This program and the accompanying materials are made available under the terms of
 the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"""),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
]


@pytest.mark.parametrize("name, text", HEADERS)
def test_headers_get_their_own_name(name, text):
    prose = "some words that are no notice " * 20
    assert [n for n, _, _ in notices(prose + text + "\n" + prose)] == [name]
    # as a comment, with a mark on every line
    found = [n for n, _, _ in notices("\n".join(" * " + x for x in text.split("\n")))]
    assert found == [name]


def test_other_versions_and_families_have_no_row():
    for text in ("This work is licensed under the GNU General Public License, version 4.",
                 "This work is licensed under the GNU Free Documentation License, version 3.",
                 HEADERS[0][1].replace("version 2", "version 7"),
                 HEADERS[5][1].replace("Affero", "Imaginary")):
        assert notices(text) == []


def test_several_notices_in_one_text():
    text = ("Released under the MIT License. Some words between. Licensed under CC BY-NC 4.0.\n"
            + "x " * 500 + "\n" + "Released under the MIT License.\n" * 150)
    found = notices(text)
    assert len(found) == 152 and {d for _, _, d in found} == {0}


def test_closest_span_against_brute_force():
    rng = random.Random(5)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(300):
        a = [rng.choice("abc") for _ in range(rng.randint(1, 5))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 7))]
        best = min(edits(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        n, i, j = licences.closest_span(a, b)
        assert n == best == edits(a, b[i:j])


def test_samples_against_a_plain_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    shown = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.",
             "Licensed under the Apache License, Version 2.0.",
             "This work is licensed under the GNU General Public License, version 3."]
    want = sorted((r.doc_id, r.text.index(x, at), x) for r in docs.collect() for x in shown
                  for at in [k for k in range(len(r.text)) if r.text.startswith(x, k)])
    got = sorted((r.doc_id, r.begin, r.wording) for r in licences.licence_notices(docs).collect())
    assert got == want


def test_odd_rows(spark, odd_docs, no_docs):
    assert licences.licence_notices(odd_docs).collect() == []
    assert licences.licence_notices(no_docs).collect() == []
    docs = spark.createDataFrame([(None, "Released under the MIT License.", "x")] * 2,
                                 "doc_id long, text string, license string")
    assert [(r.doc_id, r.license) for r in licences.licence_notices(docs).collect()] == [
        (None, "MIT")] * 2

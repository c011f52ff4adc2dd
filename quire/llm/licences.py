"""Licence notices by conditional compression.

A block of words around a licence's vocabulary is compressed twice: alone, and with each template
as a raw zstandard dictionary. The template that saves most bytes names the licence, and the exact
differences in wording between the template and the closest span of the block confirm it. What a
confirmed notice covers is taken out of the block, and the rest is ranked again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

#: small-letter strings one of which every block has; fixed values
CUES = ("licen", "copyright", "permission is hereby", "redistribution and use", "public domain",
        "cc by", "creativecommons", "express or implied warrant", "neither the name of")
#: notices and their names; fixed values, the licences' own words
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files (the \"Software\"), to deal in the "
            "Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
            "and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose "
            "with or without fee is hereby granted, provided that the above copyright notice and "
            "this permission notice appear in all copies."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not "
                   "use this file except in compliance with the License. You may obtain a copy of "
                   "the License at"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are "
            "permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors "
                     "may be used to endorse or promote products derived from this software "
                     "without specific prior written permission."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no "
             "event will the authors be held liable for any damages arising from the use of this "
             "software."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made "
                "available under the terms of the Eclipse Public License v1.0 which accompanies "
                "this distribution"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of "
                "the Eclipse Public License 2.0 which is available at"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, "
                "v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International "
                  "License."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced without "
                    "the prior written permission of the copyright holder."),
)
#: the GNU licences: short name, name, versions and what a header calls the work; fixed values
GNU = (("GPL", "General", ("1", "2", "3"), "program"), ("LGPL", "Library General", ("2",), "library"),
       ("LGPL", "Lesser General", ("2.1", "3"), "library"), ("AGPL", "Affero General", ("3",), "program"))


def gnu_templates() -> list[tuple[str, str]]:
    """Headers and short notices of the GNU licences, by version and by what is said of later ones.

    A notice that says neither "only" nor "any later version" has the version's plain name.
    """
    out = []
    for short, name, versions, work in GNU:
        for v in versions:
            spdx = f"{short}-{v if '.' in v else v + '.0'}"
            gnu = f"GNU {name} Public License"
            begin = (f"This {work} is free software: you can redistribute it and/or modify it under "
                     f"the terms of the {gnu} as published by the Free Software Foundation, ")
            out += [
                (f"{spdx}-or-later", f"{begin}either version {v} of the License, or (at your "
                                     "option) any later version."),
                (f"{spdx}-only", f"{begin}version {v} only."),
                (f"{spdx}-only", f"{begin}only version {v} of the License."),
                (spdx, f"{begin}version {v}."),
                (spdx, f"{begin}version {v} of the License."),
                (spdx, f"This {work} is free software; you can redistribute it and/or modify it "
                       f"under the terms of the {gnu} version {v} as published by the Free Software "
                       "Foundation."),
                *[(spdx + option, f"{who} under the {gnu}, version {v}{words}.")
                  for who in ("This work is licensed", "Licensed")
                  for option, words in (("", ""), ("-or-later", " or later"), ("-only", " only"))],
                (f"{spdx}-only", f"SPDX-License-Identifier: {spdx}-only"),
                (f"{spdx}-or-later", f"SPDX-License-Identifier: {spdx}-or-later"),
            ]
    return out


TEMPLATES = (*TEMPLATES, *gnu_templates())
#: words that name a licence or limit it: a span has those of its template and no others
NAMING = frozenset(
    "later only lesser affero eclipse mozilla apache boost mit isc bsd attribution noncommercial "
    "sharealike noderivatives noderivs".split())
#: share of a template's words that may differ, but for versions and naming words
MAX_DIFFERENT = 0.1
LEVEL = 9
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _plain(word: str) -> str:
    return word.lower().strip(".,;:\"'()[]{}<>*/#!-")


def _names(words: list[str]) -> tuple[frozenset[str], frozenset[tuple[str, ...]]]:
    """What names a licence: versions and naming words, and what stands before "public license"."""
    named = frozenset(w for w in words if w in NAMING or any(c.isdigit() for c in w))
    gnu = frozenset(tuple(words[k + 1:words.index("public", k)])
                    for k, w in enumerate(words) if w == "gnu" and "public" in words[k:k + 4])
    return named, gnu


def closest_span(template: list[str], words: list[str]) -> tuple[int, int, int]:
    """Fewest word edits between the template and any span of words, and that span.

    Of spans with equally few edits the one that ends first is taken, and of its beginnings the
    last.
    """
    n = len(words)
    edits = np.zeros(n + 1, np.int64)
    begin = np.arange(n + 1)
    text = np.array(words, object)
    steps = np.arange(n + 1)
    for i, word in enumerate(template, 1):
        swap = edits[:-1] + (text != word) if n else edits[:0]
        best, came = edits + 1, begin.copy()  # the template's word is missing
        take = swap <= best[1:]
        best[1:] = np.where(take, swap, best[1:])
        came[1:] = np.where(take, begin[:-1], came[1:])
        # words of the block that the template lacks: a running minimum
        low = np.minimum.accumulate(best - steps)
        source = np.maximum.accumulate(np.where(best - steps == low, steps, 0))
        edits, begin = low + steps, came[source]
    end = int(np.argmin(edits))
    return int(edits[end]), int(begin[end]), end


class Scanner:
    """Compressors and words of the templates."""

    def __init__(self) -> None:
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.given = []
        for _, text in TEMPLATES:
            known = zstandard.ZstdCompressionDict(text.lower().encode(),
                                                  dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False))
        self.words = [[w for w in map(_plain, _WORD.findall(text)) if w] for _, text in TEMPLATES]
        self.names = [_names(w) for w in self.words]
        self.reach = max(map(len, self.words))

    def ranked(self, block: str) -> list[tuple[int, int]]:
        """Saved bytes and template, best first; equal savings by the longer template."""
        raw = block.lower().encode(errors="replace")
        plain = len(self.alone.compress(raw))
        saved = [(plain - len(c.compress(raw)), k) for k, c in enumerate(self.given)]
        return sorted(saved, key=lambda x: (-x[0], -len(self.words[x[1]]), x[1]))

    def blocks(self, text: str) -> Iterator[list[tuple[int, int]]]:
        """Word spans around the cues; those that overlap are one block."""
        low = text.lower()
        if len(low) != len(text):  # some capitals change their length
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        cues = sorted({m.start() for m in re.finditer("|".join(map(re.escape, CUES)), low)})
        if not cues:
            return
        # marks alone, as at the beginning of a comment's lines, are no words
        words = [m.span() for m in _WORD.finditer(text) if _plain(m[0])]
        starts = np.array([a for a, _ in words])
        if not words:
            return
        at = np.maximum(np.searchsorted(starts, cues, "right") - 1, 0)
        low_edge = np.maximum(at - self.reach, 0)
        high_edge = np.minimum(at + self.reach + 1, len(words))
        begin, end = int(low_edge[0]), int(high_edge[0])
        for a, b in zip(low_edge[1:].tolist(), high_edge[1:].tolist()):
            if a > end:
                yield words[begin:end]
                begin = a
            end = b
        yield words[begin:end]

    def notices(self, text: str) -> Iterator[dict]:
        """Confirmed notices of a text in the order of their blocks."""
        seen: set[tuple[int, int]] = set()
        for block in self.blocks(text):
            # a block of many notices is ranked window by window; windows overlap
            step = 3 * self.reach
            for a in range(0, max(1, len(block) - self.reach), step):
                for n in self._within(text, block[a:a + step + self.reach]):
                    if (n["begin"], n["end"]) not in seen:
                        seen.add((n["begin"], n["end"]))
                        yield n

    def _within(self, text: str, spans: list[tuple[int, int]]) -> Iterator[dict]:
        rest = [spans]
        while rest:
            part = rest.pop()
            if not part:
                continue
            block = text[part[0][0]:part[-1][1]]
            if not any(c in block.lower() for c in CUES):
                continue
            plain = [_plain(text[a:b]) for a, b in part]
            for rank, (saved, k) in enumerate(self.ranked(block), 1):
                if saved <= 0:
                    break
                differ, a, b = closest_span(self.words[k], plain)
                after = plain[b:b + 6]
                option = {"only"} & {*after[:2]} | {"later"} & {*after}
                if (differ <= MAX_DIFFERENT * len(self.words[k])
                        and _names(plain[a:b]) == self.names[k]
                        and (option <= self.names[k][0] or {"only", "later"} & self.names[k][0])):
                    yield {"license": TEMPLATES[k][0], "template": k, "saved_bytes": saved,
                           "rank": rank, "differences": differ, "begin": part[a][0],
                           "end": part[b - 1][1]}
                    rest += [part[:a], part[b:]]
                    break


def has_cue(text: Column) -> Column:
    low = F.lower(text)
    found = F.contains(low, F.lit(CUES[0]))
    for cue in CUES[1:]:
        found = found | F.contains(low, F.lit(cue))
    return found


def licence_notices(docs: DataFrame) -> DataFrame:
    """Confirmed notices: doc_id, license, begin, end (code points), wording, template,
    saved_bytes, rank, differences.

    Texts without a notice, null and empty ones have no row. A notice that stands several times
    has a row for each; repeated rows are scanned each, rows without doc_id too. No rows give no
    rows; other columns, whatever their names, are not read.
    """
    names = ["license", "begin", "end", "wording", "template", "saved_bytes", "rank",
             "differences"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            keys, rows = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                whole = text.as_py().decode(errors="replace")
                for n in scanner.notices(whole):
                    keys.append(key)
                    rows.append(n | {"wording": whole[n["begin"]:n["end"]]})
            cols = [pa.array(keys, pa.int64())]
            for name in names:
                kind = pa.string() if name in ("license", "wording") else pa.int64()
                cols.append(pa.array([r[name] for r in rows], kind))
            yield pa.record_batch(cols, names=["doc_id", *names])

    rows = docs.filter(has_cue(F.col("text"))).select(F.col("doc_id").cast("long"),
                                                      F.col("text").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, license string, begin long, end long, "
                                "wording string, template long, saved_bytes long, rank long, "
                                "differences long")

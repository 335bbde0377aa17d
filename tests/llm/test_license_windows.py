import random

from wirespark.llm import license_scan as L
from wirespark.plans.inspect import python_nodes, shuffles

from .conftest import EDGES, prose, table

GPL = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
 */"""
CASES = [
    ("All our sample code is free for reuse. Released under the MIT License. See the site for details.", "MIT"),
    ("Copyright 2020 Jane Doe. Licensed under the Apache License, Version 2.0. All rights reserved.", "Apache-2.0"),
    (GPL, "GPL-3.0"),
    (prose(1, 300) + " Licensed under CC BY-NC 4.0. " + prose(2, 300), "CC-BY-NC-4.0"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
    ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
    ("Released under the BSD 2-Clause License.", "BSD-2-Clause"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("This work is licensed under the GNU General Public License, version 5.", None),
    (prose(3, 400), None),
]


def found(spark, texts, **more):
    rows = L.licenses(table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), **more).orderBy("doc_id").collect()
    return [[(x.license, round(x.dice, 9)) for x in r.licenses] for r in rows]


def test_windows_and_variants(spark):
    for (t, name), got in zip(CASES, found(spark, [t for t, _ in CASES]), strict=True):
        assert [i for i, _ in got] == ([name] if name else []), t


def brute(t, templates, threshold=0.8):
    best = {}
    for name, x in templates:
        w, want, n = L.words(t), set(L.bigrams(x)), len(L.words(x))
        pieces = [w[s : s + n] for s in range(max(1, len(w) - n + 1))] + [L.words(y) for y in t.split("\n")]
        for v in pieces:
            g = set(L.bigrams(" ".join(v)))
            if v and L.MARKS & set(v) == L.MARKS & set(L.words(x)) and (d := 2 * len(g & want) / (len(g) + len(want))) >= threshold:
                best[name] = max(best.get(name, 0), round(d, 9))
    return sorted(best.items())


def test_equals_every_window(spark):
    r, some = random.Random(2), L.all_templates()[::5]
    texts = []
    for _, x in some:
        w = x.split()
        for _ in range(2):
            at = r.randrange(len(w))
            texts.append(" ".join([*prose(r.randrange(99), 12).split(), *w[:at], *r.choice([[], ["odd"], ["one", "two"]]), *w[at + r.randrange(2) :], *prose(r.randrange(99), 12).split()]))
    assert found(spark, texts, templates=some) == [brute(t, some) for t in texts]


def test_edges(edges, nothing):
    got = L.licenses(edges)
    assert got.count() == len(EDGES) and L.licenses(nothing).count() == 0
    assert python_nodes(got) == [] and shuffles(got) == 0

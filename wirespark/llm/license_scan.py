"""Licence scan: Dice coefficient over word bigrams against licence notices; DataFrame and SQL functions only.

A text's segments are its lines and its paragraphs (parted by empty lines); a segment counts for its best template. A segment is normalised: lower case, words
are runs of ASCII letters and digits and of all characters beyond ASCII. Its set is that of its word bigrams (of one
word: that word). With b and t bigrams, Dice is 2 * common / (b + t), which can reach the threshold d only if
d / (2 - d) * t <= b <= (2 - d) / d * t: those bounds choose the templates that a segment is compared with, and most
segments fit none. Everything happens within a row, so there is no shuffle.

`scan` looks at segments alone. `licenses` looks at windows of each template's length as well, at every word of the text,
over more templates, and takes a template only where the words that tell licences' versions and variants apart (MARKS)
are the same. A Dice of d needs d / (2 - d) * t of a template's bigrams, so of any t - that + 1 of them one occurs in the
text: the rarest so many are its anchors, and windows are compared where they hold one. Nothing is missed by that.

Defined results: a null or empty text has no licence; a text may have several, each named once with its best Dice;
repeated rows get equal results; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import re

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_notices import NOTICES

#: Notices that are searched, by licence identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work has been dedicated to the public domain under CC0 1.0 Universal."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
]
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams; for templates, on the driver."""
    words = [w for w in re.split(SEPARATORS, text.lower()) if w]
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])} or set(words))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.8, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """key, licenses array<struct<license, dice>> sorted by license, license (the best), dice (its), of every row."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    known = [(i, bigrams(t)) for i, t in templates]
    least, most = min(low * len(g) for _, g in known), max(high * len(g) for _, g in known)
    table = "array(" + ", ".join(f"named_struct('id', '{i}', 'grams', array({', '.join(repr(x) for x in g)}))" for i, g in known) + ")"
    separators = SEPARATORS.replace("\\", "\\\\")
    steps = [
        r"array_distinct(concat(split(t, '\n'), split(t, '\n[ \t\r]*\n')))",
        f"filter(transform({{}}, s -> array_remove(split(lower(s), '{separators}'), '')), w -> size(w) > 0)",
        f"filter(transform({{}}, w -> IF(size(w) = 1, w, array_distinct(zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1), (a, b) -> concat(a, ' ', b))))), g -> size(g) BETWEEN {least!r}D AND {most!r}D)",
        f"transform({{}}, g -> array_max(transform(filter({table}, t -> size(g) BETWEEN {low!r}D * size(t.grams) AND {high!r}D * size(t.grams)), t -> named_struct('dice', 2.0D * size(array_intersect(g, t.grams)) / (size(g) + size(t.grams)), 'license', t.id))))",
        f"filter({{}}, x -> x.dice >= {threshold!r}D)",
    ]
    expression = ""
    for s in steps:
        expression = s.format(expression) if expression else s
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).select("k", F.expr(expression).alias("found"))
    best = "transform(array_sort(array_distinct(transform(found, x -> x.license))), l -> named_struct('license', l, 'dice', array_max(transform(filter(found, x -> x.license = l), x -> x.dice))))"
    rows = rows.select(F.col("k").alias(key), F.expr(best).alias("licenses"))
    top = F.expr("array_max(transform(licenses, x -> named_struct('dice', x.dice, 'license', x.license)))")
    return rows.select(key, "licenses", top["license"].alias("license"), top["dice"].alias("dice"))


#: Words that tell versions and variants of licences apart: a text must have those of the template, and no others.
MARKS = {"1", "2", "3", "4", "5", "v1", "v2", "v3", "v4", "affero", "lesser", "library", "nc", "nd", "sa", "noncommercial", "noderivatives", "noderivs", "sharealike", "simplified", "new", "endorse", "mit", "isc", "apache", "mozilla", "eclipse", "boost", "artistic", "zlib", "gnu"}
COMMON = set("the of to in and a an is this for under with or be by that are as any it on at you can may not all its which from work terms use used".split())
#: The opening of the BSD licences doesn't tell them apart.
RENAMED = {"Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "BSD-2-Clause OR BSD-3-Clause"}


def words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


def all_templates() -> list[tuple[str, str]]:
    return list(dict.fromkeys([*((RENAMED.get(t, i), t) for i, t in TEMPLATES), *NOTICES]))


def anchors(text: str, threshold: float) -> list[str]:
    """As many of a template's bigrams as any text with that Dice has one of; those with the fewest common words."""
    grams = bigrams(text)
    rare = sorted(grams, key=lambda g: (sum(w in COMMON for w in g.split()), g))
    return rare[: len(grams) - ceil(threshold / (2 - threshold) * len(grams) - 1e-9) + 1]


def licenses(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.8, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """The columns of `scan`, by segments and by windows."""
    known = all_templates() if templates is None else templates
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold

    def strings(xs) -> str:
        return f"array({', '.join(map(repr, xs))})" if xs else "CAST(array() AS array<string>)"

    def let(name: str, value: str, body: str) -> str:
        return f"element_at(transform(array({value}), {name} -> {body}), 1)"

    found: dict[str, list[int]] = {}
    for k, (_, t) in enumerate(known):
        for g in anchors(t, threshold):
            found.setdefault(g, []).append(k)
    marks = ", ".join(map(repr, sorted(MARKS)))
    rows = [f"named_struct('id', '{i}', 'n', {len(words(t))}, 'grams', {strings(bigrams(t))}, 'marks', {strings(sorted(MARKS & set(words(t))))})" for i, t in known]
    table = f"array({', '.join(rows)})"
    at = "map_from_arrays(" + strings(found) + ", array(" + ", ".join(f"array({', '.join(map(str, ks))})" for ks in found.values()) + "))"
    separators = SEPARATORS.replace("\\", "\\\\")

    def split(x: str) -> str:
        return f"array_remove(split(lower({x}), '{separators}'), '')"

    def pairs(w: str) -> str:
        return f"IF(size({w}) < 2, {w}, zip_with(slice({w}, 1, size({w}) - 1), slice({w}, 2, greatest(size({w}) - 1, 0)), (a, b) -> concat(a, ' ', b)))"

    def marked(w: str) -> str:
        return f"array_sort(array_distinct(filter({w}, x -> x IN ({marks}))))"

    def dice(g: str) -> str:
        return f"2.0D * size(array_intersect({g}, t.grams)) / (size({g}) + size(t.grams))"

    # One hash lookup for each bigram of the text; all else only where there is an anchor.
    hits = f"filter(transform(g, (x, i) -> IF(x IN ({', '.join(map(repr, found))}), named_struct('g', x, 'i', i + 1), NULL)), x -> x IS NOT NULL)"
    # Places of windows: template << 40 | first word.
    starts = "array_distinct(flatten(transform(hits, h -> flatten(transform(element_at(at, h.g), k -> transform(sequence(greatest(1, h.i - tt[k].n + 2), h.i), s -> shiftleft(CAST(k AS BIGINT), 40) + greatest(1, least(s, size(w) - tt[k].n + 1))))))))"
    window = let("t", "tt[CAST(shiftright(p, 40) AS INT)]", let("v", "slice(w, CAST(p & 1099511627775 AS INT), t.n)", let("gg", f"array_distinct({pairs('v')})", f"named_struct('dice', IF({marked('v')} = t.marks, {dice('gg')}, 0D), 'license', t.id)")))
    segments = r"array_distinct(concat(split(t0, '\n'), split(t0, '\n[ \t\r]*\n')))"
    near = f"filter(tt, t -> size(gg) BETWEEN {low!r}D * size(t.grams) AND {high!r}D * size(t.grams) AND m = t.marks)"
    segment = let("v", split("s"), let("gg", f"array_distinct({pairs('v')})", let("m", marked("v"), f"transform({near}, t -> named_struct('dice', {dice('gg')}, 'license', t.id))")))
    both = f"concat(transform({starts}, p -> {window}), flatten(transform({segments}, s -> {segment})))"
    none = "CAST(array() AS array<struct<dice: double, license: string>>)"
    full = let("tt", table, let("at", at, f"filter({both}, x -> x.dice >= {threshold!r}D)"))
    expression = let("w", split("t0"), let("g", pairs("w"), let("hits", hits, f"IF(size(hits) = 0, {none}, {full})")))
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t0")).select("k", F.expr(expression).alias("found"))
    best = "transform(array_sort(array_distinct(transform(found, x -> x.license))), l -> named_struct('license', l, 'dice', array_max(transform(filter(found, x -> x.license = l), x -> x.dice))))"
    rows = rows.select(F.col("k").alias(key), F.expr(best).alias("licenses"))
    top = F.expr("array_max(transform(licenses, x -> named_struct('dice', x.dice, 'license', x.license)))")
    return rows.select(key, "licenses", top["license"].alias("license"), top["dice"].alias("dice"))
